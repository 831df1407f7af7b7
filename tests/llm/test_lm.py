import math
import re
import zlib
from collections import Counter

import pytest
from cases import no_documents, odd_documents

from crawl_analytics.llm import lm, queries


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ("end",)]


class Plain:
    """Interpolated modified Kneser-Ney bigrams by the book, on dictionaries."""

    def __init__(self, texts):
        self.pairs, self.seen = Counter(), Counter()
        for text in texts:
            line = [("begin",), *tokens(text)]
            self.pairs.update(zip(line, line[1:], strict=False))
            self.seen.update(line[1:])
        self.total = Counter()
        self.kinds, self.before = {}, Counter()
        for (u, v), n in self.pairs.items():
            self.total[u] += n
            self.kinds.setdefault(u, []).append(n)
            self.before[v] += 1
        self.dp, self.dw = self.discounts(self.pairs.values()), self.discounts(self.before.values())
        self.n, self.v = sum(self.seen.values()), len(self.seen)
        self.bigrams = sum(self.before.values())
        self.left = sum(self.dw[min(n, 3) - 1] for n in self.before.values()) / max(1, self.bigrams)

    @staticmethod
    def discounts(counts):
        n = Counter(counts)
        if all(n[k] for k in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            if all(0 < x <= k for k, x in zip((1, 2, 3), d, strict=True)):
                return d
        return [0.5, 0.75, 0.75]

    @staticmethod
    def less(n, d):
        return max(0.0, n - d[min(n, 3) - 1]) if n else 0.0

    def low(self, v):
        return self.less(self.before[v], self.dw) / self.bigrams + self.left / (self.v + 1)

    def p(self, u, v):
        if not self.total[u]:
            return self.low(v)
        back = sum(self.dp[min(n, 3) - 1] for n in self.kinds[u]) / self.total[u]
        return self.less(self.pairs[u, v], self.dp) / self.total[u] + back * self.low(v)


def check(docs, rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    model = Plain(t for i, t in docs if not held(i))
    want = []
    for doc_id, text in docs:
        line = [("begin",), *tokens(text)]
        base = sum(math.log10((model.seen[t] + 1) / (model.n + model.v + 1)) for t in line[1:])
        score = sum(math.log10(model.p(u, v)) for u, v in zip(line, line[1:], strict=False))
        want.append((doc_id, held(doc_id), len(line) - 1, sum(model.seen[t] > 0 for t in line[1:]), model.n, base, score))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows]
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return model


def test_query_against_dictionaries(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 50_000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.registry()["op10_language_model"](spark, sf).collect()
    model = check(docs, rows)
    words = list(model.seen)
    for u in [("begin",), *words[:20], "never seen"]:  # it is a distribution, with one place for unseen words
        assert sum(model.p(u, v) for v in words) + model.p(u, "never seen") == pytest.approx(1)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(lm, "TOKENS_AT_ONCE", 20)
    docs = odd_documents(spark, ("shard", "blob", "score"))
    check([(r.doc_id, r.text) for r in docs.collect()], lm.scores(docs).collect())
    assert lm.scores(no_documents(spark)).count() == 0


def test_counts_beyond_a_byte(spark):
    docs = spark.createDataFrame([(1, "a b " * 700), (3, "a b"), (4, "b a c")], "doc_id long, text string")
    check([(r.doc_id, r.text) for r in docs.collect()], lm.scores(docs).collect())


def test_no_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_a_frequent_first_word_fills_no_shard(spark, monkeypatch):
    """One word before 200,000 different ones: its bigrams are spread, and the scores stay what dictionaries say."""
    import numpy as np

    monkeypatch.setattr(lm, "SHARD_BYTES", 200_000)
    docs = [(i, " ".join(f"the w{i}x{j}" for j in range(1000))) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    model = lm.train(frame)
    path = model.root.removeprefix("file:")
    sizes = [int(np.fromfile(f"{path}/pairs-{k}", "<i8", 1)[0]) for k in range(model.deal.shards)]
    assert len(sizes) > 5 and sum(sizes) > 400_000 and max(sizes) < 2 * sum(sizes) / len(sizes)
    some = frame.where("doc_id < 20")
    spread = {r.doc_id: r.score for r in lm.scored(some, model, ["doc_id"]).collect()}
    monkeypatch.setattr(lm, "SHARD_BYTES", 1 << 30)
    whole = lm.train(frame)
    assert whole.deal.shards == 1 and whole.sums == model.sums
    assert spread == pytest.approx({r.doc_id: r.score for r in lm.scored(some, whole, ["doc_id"]).collect()})
