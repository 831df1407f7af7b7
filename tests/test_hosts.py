import pytest
from pyspark.sql import functions as F

from crawl_analytics.functions import hosts
from crawl_analytics.functions.urls import normalize_url
from crawl_analytics.operators.labelling import label_requests
from crawl_analytics.operators.rules import parse_rules

# the examples by which public suffix lists are usually tested
SITES = {
    "com": "com", "example.com": "example.com", "a.b.example.com": "example.com", "uk": "uk", "co.uk": "co.uk", "x.co.uk": "x.co.uk",
    "b.x.co.uk": "x.co.uk", "ck": "ck", "test.ck": "test.ck", "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck", "www.ck": "www.ck",
    "www.www.ck": "www.ck", "c.kobe.jp": "c.kobe.jp", "b.c.kobe.jp": "b.c.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp",
    "www.city.kobe.jp": "city.kobe.jp", "a.github.io": "a.github.io", "x.a.github.io": "a.github.io", "nothing.known": "nothing.known",
    "a.nothing.known": "nothing.known", "192.168.0.1": "192.168.0.1", "[::1]": "[::1]", "": "", None: None, "A.Example.COM.": "example.com",
}
HOSTS = {
    "Example.COM": "example.com", "bücher.example": "xn--bcher-kva.example", "BÜCHER.example.": "xn--bcher-kva.example", "münchen。de": "xn--mnchen-3ya.de",
    "faß.de": "xn--fa-hia.de", "日本語.jp": "xn--wgv71a119e.jp", "ex%61mple.org": "example.org", "xn--bcher-kva.ch": "xn--bcher-kva.ch",
    "0x7f.1": "127.0.0.1", "0300.0250.01.012": "192.168.1.10", "3232235777": "192.168.1.1", "1.2.3": "1.2.0.3", "256.1.1.1": None, "1.2.3.4.5": None,
    "[2001:DB8:0:0:0:0:0:1]": "[2001:db8::1]", "[::g]": None, "[::1": None, "a b.c": None, "a..b": None, "": None, None: None, "x" * 64 + ".de": None,
    "ｅｘａｍｐｌｅ.com": "example.com", "09.example": "09.example",
}


def test_registrable_domains():
    trie = hosts.SuffixTrie(hosts.SUFFIXES)
    assert {h: trie.site(h) for h in SITES} == SITES
    assert hosts.SuffixTrie([]).site("a.b.c") == "b.c"


@pytest.mark.parametrize("function,cases", [(hosts.registrable_domain, SITES), (hosts.canonical_host, HOSTS)])
def test_columns(spark, function, cases):
    frame = spark.createDataFrame([(h,) for h in cases] * 2, "h string")
    assert {r.h: r.v for r in frame.select("h", function(F.col("h")).alias("v")).collect()} == cases


def test_list_file(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// comment\n\ncom\nco.uk  trailing words\n*.ck\n!www.ck\n")
    rules = hosts.read_suffixes(spark, str(tmp_path / "list.dat"))
    assert sorted(rules) == ["!www.ck", "*.ck", "co.uk", "com"]


def test_seed_urls_with_international_and_numeric_hosts(spark):
    cases = {"Bücher.example:443/ä": "https://xn--bcher-kva.example/ä", "http://u@0x7f.1:80": "http://u@127.0.0.1/", "[::0:1]:8080": "https://[::1]:8080/", "a b": "https://a b/"}
    frame = spark.createDataFrame([(c,) for c in cases], "u string")
    assert {r.u: r.n for r in frame.select("u", normalize_url(F.col("u")).alias("n")).collect()} == cases


def test_third_parties_by_registrable_domain(spark):
    rules = parse_rules(spark.createDataFrame([(0, "l", "-ad$third-party")], "list_ord int, list_name string, line string"))
    requests = [("https://a.github.io/-ad", "https://b.github.io/"), ("https://x.a.github.io/-ad", "https://a.github.io/"), ("https://a.co.uk/-ad", "https://b.co.uk/"), ("https://s.y.zz/-ad", "https://t.y.zz/")]
    frame = spark.createDataFrame([(*r, "script") for r in requests], "url string, frame_url string, resource_type string")
    got = {r.url: r.blocked_by for r in label_requests(frame, rules).collect()}
    assert [got[u] for u, _ in requests] == ['["l"]', "[]", '["l"]', "[]"]
    own = {r.url: r.blocked_by for r in label_requests(frame, rules, suffixes=["y.zz"]).collect()}
    assert [own[u] for u, _ in requests] == ["[]", "[]", "[]", '["l"]']
