import random

import pytest

from crawl_analytics.operators import automaton
from crawl_analytics.operators.automaton import Automaton, literals_in


def plain(literals, texts):
    known = sorted({t for t in literals if t})
    return [[i for i, t in enumerate(known) if t in text] for text in texts]


@pytest.mark.parametrize("alphabet,cells", [("ab", 1 << 22), ("abc/.é", 64), ("abcdefghijkl", 7)])
def test_equals_a_search_for_each_literal(monkeypatch, alphabet, cells):
    monkeypatch.setattr(automaton, "CELLS", cells)
    rng = random.Random(alphabet)
    some = lambda n: "".join(rng.choice(alphabet) for _ in range(n)).encode()
    literals = [some(rng.randrange(0, 6)) for _ in range(200)]
    texts = [some(rng.randrange(0, 40)) for _ in range(300)] + [b"", b"zzz", b"\xff\x00"]
    assert Automaton(literals).found(texts) == plain(literals, texts)


def test_nested_literals_and_bytes_outside():
    machine = Automaton([b"he", b"she", b"hers", b"e", b"rs"])
    assert [machine.literals[i] for i in machine.found([b"ushers"])[0]] == [b"e", b"he", b"hers", b"rs", b"she"]
    assert machine.found([b"u-u", b""]) == [[], []]
    assert Automaton([]).found([b"abc"]) == [[]] and Automaton([b"\x00"]).found([b"a", b"a\x00"]) == [[], [0]]


def test_work_grows_with_the_text_not_with_the_literals(monkeypatch):
    steps = []

    class Counted(Automaton):
        def _run(self, texts, width):
            steps.append(width)
            return super()._run(texts, width)

    texts = [b"abcde" * 20]
    for n in (10, 3000):
        Counted([f"k{i}x".encode() for i in range(n)]).found(texts)
    assert steps == [100, 100]


def test_column(spark):
    frame = spark.createDataFrame([("xädß",), (None,), ("",), ("ab ab",)], "t string")
    rows = frame.select(literals_in(frame["t"], ["ä", "ab", "dß", ""], "g:").alias("f")).collect()
    assert [r.f for r in rows] == [["g:dß", "g:ä"], [], [], ["g:ab"]]
