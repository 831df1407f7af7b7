import json
import random
import re

from pyspark.sql import functions as F

from crawl_analytics.operators.joins import salted_join
from crawl_analytics.operators import labelling
from crawl_analytics.operators.labelling import label_requests
from crawl_analytics.operators.rules import parse_rules
from crawl_analytics.sources.lists import chosen_lists, list_name, read_filter_lists

REQUEST = "url string, frame_url string, resource_type string"


def rules_of(spark, lists):
    rows = [(i, name, line) for i, (name, lines) in enumerate(lists.items()) for line in lines]
    return parse_rules(spark.createDataFrame(rows, "list_ord int, list_name string, line string"))


def label(spark, lists, requests):
    frame = spark.createDataFrame(requests, REQUEST)
    out = label_requests(frame, rules_of(spark, lists), as_array=True).collect()
    return {(r.url, r.frame_url, r.resource_type): r.blocked_by for r in out}


def test_matching_list_is_named(spark):
    request = ("https://tracker.com/pixel.gif", "https://example.com", "image")
    assert label(spark, {"easylist": ["||tracker.com^"]}, [request])[request] == '["easylist"]'


def test_rules_one_by_one(spark):
    cases = [
        ("||example.com^", "http://example.com/ads", "http://page.com", "script", True),
        ("||example.com^", "http://sub.example.com:80/ads", "", "script", True),
        ("||example.com^", "http://notexample.com/ads", "", "script", False),
        ("||example.com^", "http://example.com.evil.org/", "", "script", False),
        ("||example.com^", "http://example.com/", "", "document", False),
        ("||example.com^$document", "http://example.com/", "", "document", True),
        ("||example.com/path", "https://a.example.com/path/x", "", "xhr", True),
        ("||example.com/path", "https://a.example.com/other", "", "xhr", False),
        ("|https://x.org/", "https://x.org/a", "", "other", True),
        ("|https://x.org/", "http://y.org/?u=https://x.org/", "", "other", False),
        ("swf|", "http://x.org/a.swf", "", "object", True),
        ("swf|", "http://x.org/a.swf?x", "", "object", False),
        ("/banner/*/img^", "http://x.org/banner/foo/img?q", "", "image", True),
        ("/banner/*/img^", "http://x.org/banner/foo/imgraph", "", "image", False),
        ("utm_source=feed", "http://x.org/?utm_source=feeder", "", "image", True),
        ("AdServer", "http://x.org/adserver.js", "", "script", True),
        ("AdServer$match-case", "http://x.org/adserver.js", "", "script", False),
        ("AdServer$match-case", "http://x.org/AdServer.js", "", "script", True),
        ("/ads[0-9]+/", "http://x.org/ADS17.js", "", "script", True),
        ("/ads[0-9]+/", "http://x.org/ads.js", "", "script", False),
        ("/ads($script", "http://x.org/ads(1", "", "script", True),
        ("ad.$script,~third-party", "http://ad.x.org/", "http://www.x.org/", "script", True),
        ("ad.$third-party", "http://ad.x.org/", "http://www.x.org/", "script", False),
        ("ad.$third-party", "http://ad.x.co.uk/", "http://y.co.uk/", "script", True),
        ("$script,domain=a.com|~b.a.com", "http://x.org/", "http://w.a.com/", "script", True),
        ("$script,domain=a.com|~b.a.com", "http://x.org/", "http://b.a.com/", "script", False),
        ("$script,domain=a.com", "http://x.org/", "http://c.com/", "script", False),
        ("-ad$~image", "http://x.org/-ad", "", "image", False),
        ("-ad$~image", "http://x.org/-ad", "", "script", True),
        ("-ad$xmlhttprequest", "http://x.org/-ad", "", "fetch", True),
        ("-ad$csp=x", "http://x.org/-ad", "", "script", False),
        ("*$websocket", "wss://x.org/", "", "websocket", True),
        ("! -ad", "http://x.org/-ad", "", "script", False),
        ("x.org##.ad", "http://x.org/-ad", "", "script", False),
        ("/([/", "http://x.org/([", "", "script", False),
    ]
    lists = {f"l{i}": [rule] for i, (rule, *_) in enumerate(cases)}
    out = label(spark, lists, [tuple(c[1:4]) for c in cases])
    for i, (rule, url, frame, kind, hit) in enumerate(cases):
        assert (f"l{i}" in json.loads(out[(url, frame, kind)])) is hit, (rule, url, frame, kind)


def test_exceptions_stay_in_their_list_and_important_wins(spark):
    lists = {
        "one": ["||t.com^", "@@||t.com/ok^"],
        "two": ["||t.com^"],
        "three": ["||t.com^$important", "@@||t.com^"],
    }
    ok, bad = ("http://t.com/ok", "", "script"), ("http://t.com/bad", "", "script")
    out = label(spark, lists, [ok, bad])
    assert out[ok] == '["two", "three"]'
    assert out[bad] == '["one", "two", "three"]'


def test_empty_url_and_no_rules_give_an_empty_list(spark):
    out = label(spark, {"one": ["*"]}, [("", "", "script"), (None, "f", "script"), ("http://x/", None, None)])
    assert out == {("", "", "script"): "[]", (None, "f", "script"): "[]", ("http://x/", None, None): '["one"]'}
    frame = spark.createDataFrame([("http://x/", "", "script")], REQUEST)
    assert label_requests(frame, rules_of(spark, {"c": ["! only a comment"]})).first().blocked_by == "[]"


def plain_loop(lists, request):
    """What the lists say about a request, rule by rule."""
    url, frame, kind = request
    host = re.match(r"[a-z]+://([^/:?#]+)", url).group(1)
    found = []
    for name, rules in lists.items():
        hit = excepted = False
        for rule in rules:
            body = rule.removeprefix("@@")
            pattern, _, option = body.partition("$")
            if option and option != kind:
                continue
            if pattern.startswith("||"):
                name_part, _, rest = pattern[2:].partition("^")
                match = (host == name_part or host.endswith("." + name_part)) and not rest
            elif "*" in pattern:
                match = re.search(".*".join(map(re.escape, pattern.split("*"))), url) is not None
            else:
                match = pattern in url
            if match and rule.startswith("@@"):
                excepted = True
            elif match:
                hit = True
        if hit and not excepted:
            found.append(name)
    return json.dumps(found)


def test_random_rules_equal_a_plain_loop(spark, monkeypatch):
    rng = random.Random(3)
    words = ["ad", "ads", "track", "pixel", "img", "a1", "news", "shop", "x"]
    hosts = [f"{rng.choice(words)}.{rng.choice(words)}.{t}" for t in ("com", "de", "org") for _ in range(6)]

    def rule():
        kind = rng.randrange(4)
        if kind == 0:
            text = "||" + rng.choice(hosts).split(".", rng.randrange(2))[-1] + "^"
        elif kind == 1:
            text = "/" + rng.choice(words) + rng.choice(["_", ".", "-", ""])  # two slashes would be a regex
        elif kind == 2:
            text = rng.choice(words) + "*" + rng.choice(words)
        else:
            text = rng.choice(["_", "-", "="]) + rng.choice(words)
        option = rng.choice(["", "", "", "$script", "$image"])
        return ("@@" if rng.random() < 0.2 else "") + text + option

    lists = {f"list{i}": [rule() for _ in range(5)] for i in range(6)}
    requests = list(
        {
            (
                f"https://{rng.choice(hosts)}/{rng.choice(words)}{rng.choice(['/', '_', '-', '.', ''])}{rng.choice(words)}?k={rng.choice(words)}",
                f"https://{rng.choice(hosts)}/",
                rng.choice(["script", "image"]),
            )
            for _ in range(400)
        }
    )
    expected = {r: plain_loop(lists, r) for r in requests}
    assert len(set(expected.values())) > 5
    assert label(spark, lists, requests) == expected
    # the same through the way for rule tables that are too large to broadcast
    monkeypatch.setattr(labelling, "LOOKUP_ROWS", 0)
    monkeypatch.setattr(labelling, "TEXT_CHARS", 5)  # several automata
    monkeypatch.setattr(labelling, "ANY_RULES", 1)
    monkeypatch.setattr(labelling, "salted_join", lambda *a, **k: salted_join(*a, **{**k, "min_rows": 5}))
    assert label(spark, lists, requests) == expected


def test_rules_without_a_key_meet_no_constant(spark):
    """Rules for any URL, for types and for pieces of text: right answers, and no join on one value for all rows."""
    lists = {"a": ["*$websocket", "-ad", "_x*y"], "b": ["/[0-9]{3}x/", "*$third-party"]}
    requests = [("wss://p.org/", "https://p.org/", "websocket"), ("https://p.org/-ad", "https://p.org/", "script"), ("https://q.org/a_x1y", "https://p.org/", "image"), ("https://p.org/123x", "", "other")]
    out = label(spark, lists, requests)
    assert [out[r] for r in requests] == ['["a"]', '["a"]', '["a", "b"]', '["b"]']
    frame = spark.createDataFrame(requests, REQUEST)
    rules = rules_of(spark, lists)
    assert {r.key_kind: r["count"] for r in rules.groupBy("key_kind").count().collect()} == {"type": 1, "text": 2, "any": 2}
    plan = label_requests(frame, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan


def test_labelling_twice_changes_nothing(spark):
    frame = spark.createDataFrame([("http://t.com/", "", "script"), ("http://u.com/", "", "image")], REQUEST)
    rules = rules_of(spark, {"l": ["||t.com^"]})
    once = label_requests(frame, rules)
    again = label_requests(once.drop("blocked_by"), rules)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_filter_list_files(spark, tmp_path):
    (tmp_path / "easylist.txt").write_text("! c\n\n  ||a.com^  \n")
    (tmp_path / "second.txt").write_text("||b.com^\n")
    paths = chosen_lists(f"{tmp_path}/easylist.txt, {tmp_path}/missing.txt,,{tmp_path}/second.txt")
    rows = sorted(map(tuple, read_filter_lists(spark, paths).collect()))
    assert rows == [(0, "easylist", "! c"), (0, "easylist", "||a.com^"), (2, "second", "||b.com^")]
    assert list_name("https://x.org/a/easy.list.txt") == "easy.list"
    assert list_name("https://x.org/plain/") == "plain"
    assert len(chosen_lists()) == 12
    assert read_filter_lists(spark, []).count() == 0


def test_plan_of_the_label_has_no_python(spark):
    frame = spark.createDataFrame([("http://t.com/", "", "script")], REQUEST).withColumn("url", F.lower("url"))
    plan = label_requests(frame, rules_of(spark, {"l": ["||t.com^"]}))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_a_rule_with_many_domains_stands_once(spark):
    sizes = []
    for n in (100, 500):
        domains = "|".join(f"site{i}.example" for i in range(n))
        rules = rules_of(spark, {"l": [f"*x$domain={domains}", "||t.com^"]})
        sizes.append(sum(len(str(r)) for r in rules.collect()))
    assert rules.count() == 2 and sizes[1] < 6 * sizes[0]


def test_requests_to_label_hold_no_text_twice(spark):
    """NULL, empty and one-byte keys come back as they were, and the joined rows carry the three key columns once."""
    columns = "request_id string, url string, frame_url string, resource_type string"
    data = [("1", "https://ads.example/x", None, "image"), ("2", None, None, None), ("3", "\0", "\0", "\0"), ("4", "https://ok.example/", "", None)]
    lines = spark.createDataFrame([(0, "easylist", "||ads.example^")], "list_ord int, list_name string, line string")
    out = label_requests(spark.createDataFrame(data, columns), parse_rules(lines))
    assert sorted(tuple(r) for r in out.select("request_id", "url", "frame_url", "resource_type").collect()) == sorted(data)
    assert {r.request_id: r.blocked_by for r in out.collect()} == {"1": '["easylist"]', "2": "[]", "3": "[]", "4": "[]"}
    assert not {"__url", "__frame_url", "__resource_type"} & set(re.findall(r"__\w+", out._jdf.queryExecution().analyzed().toString()))
