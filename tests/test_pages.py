import hashlib
import random

from pyspark.sql import functions as F

from crawl_analytics.constants import ACCEPT_PHRASES
from crawl_analytics.functions.urls import normalize_url
from crawl_analytics.operators import pages


def links(spark, url, html):
    frame = spark.createDataFrame([(url, html)], "url string, html string")
    return [r.link for r in pages.extract_links(frame).orderBy("link").collect()]


def test_links_of_the_own_host_without_repeats(spark):
    html = """<a href="/b">b</a><a href='http://h.org/a'>a</a><A class=x HREF=/b>again</A>
      <a href="https://other.org/c">c</a><a href="mailto:x@h.org">m</a><a href="javascript:void(0)">j</a><a name="n">n</a>
      <!-- <a href="/hidden">h</a> --><script>var s = '<a href="/js">';</script><a title="a > b" href="/q?x=1&amp;y=2">q</a>"""
    assert links(spark, "http://h.org/dir/page?z=1", html) == ["http://h.org/a", "http://h.org/b", "http://h.org/q?x=1&y=2"]


def test_relative_links_are_resolved_like_in_a_browser(spark):
    base = "HTTP://H.org:80/dir/page?z=1#f"
    cases = {
        "x": "http://h.org/dir/x",
        "./x": "http://h.org/dir/x",
        "../x": "http://h.org/x",
        "../../../x": "http://h.org/x",
        "a/./b/../c/": "http://h.org/dir/a/c/",
        "..": "http://h.org/",
        "?y": "http://h.org/dir/page?y",
        "#g": "http://h.org/dir/page?z=1#g",
        "": "http://h.org/dir/page?z=1",
        "//h.org": "http://h.org/",
        "http://H.ORG:80/K": "http://h.org/K",
        " /sp ace ": "http://h.org/sp%20ace",
        "/für\"x": "http://h.org/f%C3%BCr%22x",
        "/a%20b": "http://h.org/a%20b",
    }
    for href, expected in cases.items():
        quote = "'" if '"' in href else '"'
        assert links(spark, base, f"<a href={quote}{href}{quote}>") == [expected], href


def test_mock_pages(spark):
    html = '<html><body><a href="/one">1</a><a href="/two">2</a><a href="/one">1</a></body></html>'
    assert links(spark, "http://h/basic", html) == ["http://h/one", "http://h/two"]


def test_description(spark):
    rows = [
        (1, 0, '<meta charset="utf-8"><meta name="description" content="A &amp; B"><meta name="description" content="no">'),
        (2, 0, "<META content='" + "x" * 600 + "' name='description'/>"),
        (3, 0, '<meta name="keywords" content="k"><!-- <meta name="description" content="c"> -->'),
        (4, 1, '<meta name="description" content="subpage">'),
        (5, 0, "<meta name=description>"),
    ]
    frame = spark.createDataFrame(rows, "page_id int, crawl_depth int, html string")
    out = {r.page_id: r.description for r in pages.site_description(frame).collect()}
    assert out == {1: "A & B", 2: "x" * 500, 3: "", 5: ""}


def consent(spark, htmls, phrases=None):
    frame = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")
    return {r.page_id: (r.tag, r.text, r.phrase) for r in pages.match_consent(frame, phrases).collect()}


def test_consent_candidates(spark):
    out = consent(
        spark,
        [
            "<button>Accept</button>",
            "<button>decline</button><a href='/p'>accept</a>",
            "<a href=' # '>OK</a>",
            "<a href='javascript:x()'>got it</a>",
            "<a target=_blank href='#'>ok</a>",
            "<button disabled>ok</button><button aria-disabled='true'>ok</button><button aria-hidden=true>ok</button>",
            "<input type=submit value='I  agree'><input type=text value=ok>",
            "<div role='button'><span>Tout\n accepter</span></div>",
            "<span role=button title='ok'> </span>",
            "<button>unacceptable</button><button>okay</button>",
            "<button>ok</button><button>Accept all</button><button>accept all</button>",
            "<button style='display: none'>ok</button><button hidden>ok</button>",
            "<div role=button>wrap <a href='#'>Zustimmen</a></div>",
            "<button data-disabled='x'>ok</button>",
        ],
    )
    assert out == {
        0: ("button", "accept", "accept"),
        2: ("a", "ok", "ok"),
        3: ("a", "got it", "got it"),
        6: ("input", "i agree", "i agree"),
        7: ("div", "tout accepter", "tout accepter"),
        8: ("span", "ok", "ok"),
        10: ("button", "accept all", "accept all"),
        12: ("div", "wrap zustimmen", "zustimmen"),
        13: ("button", "ok", "ok"),
    }


def test_consent_equals_a_plain_loop(spark):
    rng = random.Random(5)
    words = ["accept", "all", "cookies", "ok", "alle", "akzeptieren", "please", "and", "close", "i", "agree"]
    texts = [[" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 6))] for _ in range(60)]
    expected = {}
    for page, buttons in enumerate(texts):
        for phrase in ACCEPT_PHRASES:
            hit = next((t for t in buttons if f" {phrase} " in f" {t} "), None)
            if hit:
                expected[page] = ("button", hit, phrase)
                break
    assert consent(spark, ["".join(f"<button>{t}</button>" for t in buttons) for buttons in texts]) == expected


def test_phrases_are_distinct_places():
    assert len(ACCEPT_PHRASES) == 91


def python_choice(seed, depth, found):
    return random.Random(hashlib.sha256(f"{seed}:{depth}".encode()).digest()).choice(sorted(set(found)))


def test_link_choice_is_that_of_the_generator(spark):
    found = [f"https://h.org/{i}" for i in range(50)]
    rows = [(f"https://seed{i}.org", found + found[:3]) for i in range(3)] + [("x", [])]
    frame = spark.createDataFrame(rows, "seed string, links array<string>")
    for depth in (0, 2):
        out = frame.select("seed", pages.choose_link(F.col("links"), F.col("seed"), F.lit(depth)).alias("c"))
        got = {r.seed: r.c for r in out.collect()}
        assert got == {s: python_choice(s, depth, l) if l else None for s, l in rows}
        assert len(set(got.values())) > 2


def python_walk(seed, graph, max_depth):
    visits, queue, seen, depth = [], [seed], set(), 0
    while queue and depth <= max_depth:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        found = graph.get(url)
        visits.append((seed, depth, url, found is not None))
        if found is None and depth == 0:
            break
        if found and depth < max_depth:
            queue.append(python_choice(seed, depth, found))
        depth += 1
    return visits


def test_walk_equals_a_plain_loop(spark):
    rng = random.Random(11)
    urls = [f"http://h.org/{i}" for i in range(12)]
    graph = {u: rng.sample(urls, rng.randrange(0, 4)) for u in urls[:9]}
    table = spark.createDataFrame(list(graph.items()), "url string, links array<string>")
    tasks = spark.createDataFrame([("e", u) for u in urls], "experiment_id string, url string")
    for max_depth in (0, 1, 3):
        got = sorted((r.seed, r.depth, r.url, r.ok) for r in pages.walk(tasks, table, max_depth).collect())
        assert got == sorted(v for u in urls for v in python_walk(u, graph, max_depth))


def test_walk_never_returns_to_the_seed(spark):
    table = spark.createDataFrame([("s", ["s"])], "url string, links array<string>")
    tasks = spark.createDataFrame([("e", "s")], "experiment_id string, url string")
    assert pages.walk(tasks, table, 3).count() == 1


def test_seed_normalisation(spark):
    cases = {
        "google.com": "https://google.com/",
        "HTTP://Example.COM:80": "http://example.com/",
        "https://a.b:443/P?q=1#f": "https://a.b/P?q=1#f",
        "//x.org/a": "https://x.org/a",
        "u@Host.org:8080/x": "https://u@host.org:8080/x",
        " spaced.org ": "https://spaced.org/",
    }
    frame = spark.createDataFrame([(c,) for c in cases], "u string")
    got = {r.u: r.n for r in frame.select("u", normalize_url(F.col("u")).alias("n")).collect()}
    assert got == cases
