import os
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from crawl_analytics.fixtures import Fixture
from crawl_analytics.functions.elements import VOID, elements, parse

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def some(html, *names):
    return parse(html, lambda name, attrs: name in names)


def short(html, *names):
    return [(e[2], e[3], e[4].split(), e[5]) for e in some(html, *names)]


def test_raw_text_comments_and_text_only_elements():
    html = """<title>a &lt;b <a href=no></title><!-- <a href=c> --><script>if (a<b) "<a href=s>"</script ><!--><a href=1>x</a>
    <style><a href=t></style><textarea><a href=u></textarea><!doctype html><?php <a ?><a href=2>y<!-- z -->w</a></ a><noscript><a href=n></noscript>"""
    assert short(html, "a") == [("a", {"href": "1"}, ["x"], False), ("a", {"href": "2"}, ["yw"], False)]
    assert short(html, "title")[0][2] == ["a", "<b", "<a", "href=no>"]


def test_attributes():
    html = """<a HREF='x"y' href=second data-a = "1 > 2" disabled title=a&#98;c&amp;d/ x='&copy;'>t</a><a/b=1/>u<input value=last"""
    assert [e[3] for e in some(html, "a", "input")] == [
        {"href": 'x"y', "data-a": "1 > 2", "disabled": "", "title": "abc&d/", "x": "©"},
        {"b": "1/"},
        {"value": "last"},
    ]


def test_references_are_named_and_numeric():
    assert some("<p>&#x41;&#66;&eacute;&notanything;&hellip;</p>", "p")[0][4].strip() == "ABé¬anything;…"


def test_hidden_is_inherited():
    html = """<div style="color:red; DISPLAY : none"><p><button>a</button></p></div><button>b</button><template><button>c</button></template>
    <div hidden><img><button>d</button></div><section aria-hidden=true><div><button>e</button></div></section><button>f</button>"""
    assert [(e[4], e[5]) for e in some(html, "button")] == [("a", True), ("b", False), ("c", True), ("d", True), ("e", True), ("f", False)]


def test_parents_and_ends_that_are_implied():
    html = "<ul><li>1<li>2<ul><li>3</ul><li>4</ul><p>a<div>b</div><table><tr><td>x<td>y<tr><td>z</table><a>p<a>q"
    found = some(html, "ul", "li", "p", "td", "a")
    numbers = {e[0]: i for i, e in enumerate(found)}
    assert [(e[2], numbers.get(e[1]), e[4].split()) for e in found[:6]] == [
        ("ul", None, list("1234")), ("li", 0, ["1"]), ("li", 0, ["2", "3"]), ("ul", 2, ["3"]), ("li", 3, ["3"]), ("li", 0, ["4"])
    ]
    assert [(e[2], e[4].split()) for e in found[6:]] == [("p", ["a"]), ("td", ["x"]), ("td", ["y"]), ("td", ["z"]), ("a", ["p"]), ("a", ["q"])]


def test_broken_markup_ends():
    for html in ("<", "<a", "<a href", "<a href=", "<a href='x", "</", "</a", "<!--", "<!", "<script>", "<title>x", "a<1 <b>", "</p></x></", "<" * 50, "<a " * 50, None):
        parse(html or "", lambda name, attrs: True)


class Plain(HTMLParser):
    """Links and button texts by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open = [], []

    def handle_starttag(self, tag, attrs):
        first = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        if tag in ("a", "button", "input", "meta"):
            self.found.append([tag, first, ""])
            if tag not in VOID:
                self.open.append(self.found[-1])

    def handle_endtag(self, tag):
        if any(e[0] == tag for e in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        for e in self.open:
            e[2] += data


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("table", ["pages", "consent_pages", "described_pages"])
def test_equals_the_standard_parser_on_the_pages(spark, table):
    fx = Fixture(spark, SF)
    rows = (fx.source("pages") if table == "pages" else fx[table]).select("html").collect()
    found = spark.createDataFrame([(r.html,) for r in rows], "html string").select(elements(F.col("html"), ["a", "button", "input", "meta"]).alias("e")).collect()
    for row, r in zip(rows, found, strict=True):
        parser = Plain()
        parser.feed(row.html)
        parser.close()
        assert [(e["name"], e["attrs"], e["text"].split()) for e in r.e] == [(t, a, x.split()) for t, a, x in parser.found]


def test_column_of_nulls_and_roles(spark):
    frame = spark.createDataFrame([(None,), ("",), ("<div ROLE=Button>x</div><span role=link>y</span>",)], "h string")
    got = [r.e for r in frame.select(elements(frame["h"], ["a"], ["button"]).alias("e")).collect()]
    assert got[:2] == [[], []] and [(e["name"], e["text"].strip()) for e in got[2]] == [("div", "x")]
