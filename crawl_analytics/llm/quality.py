"""Quality classification by co-training a text view and a page-metadata view."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.joins import is_small
from .common import share, small_batches, stored, unused

TEXT_BUCKETS = 1 << 11
LONGEST_GRAM = 3
PAGE_BUCKETS = 160
LABELLED_ROWS = 1500  # of each quality, about
ROUNDS = 4
GROWTH = 150  # pseudo-labels of each quality that a view may hand over in a round
SURE = 0.97
KEEP_FROM = 0.5
AT_ONCE = 256  # documents whose features are held at once


def _text_features(text: str) -> np.ndarray:
    """Shares of hashed character n-grams, roots taken; the whole text."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out = np.zeros(TEXT_BUCKETS, dtype=np.float32)
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        at = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 11)).astype(np.int64)
        out += np.bincount(at, minlength=TEXT_BUCKETS) / (LONGEST_GRAM * len(at))
    return np.sqrt(out)


def _page_features(source: str | None, lang: str | None, n_chars: int | None, lines: int) -> np.ndarray:
    """One-hot source, language and length class, and the layout: lines and characters per line. Nothing the text says."""
    import zlib

    out = np.zeros(PAGE_BUCKETS, dtype=np.float32)
    out[zlib.crc32((source or "-").encode()) % 64] = 1
    out[64 + zlib.crc32((lang or "-").encode()) % 16] = 1
    size = max(n_chars or 0, 0)
    out[80 + min(int(np.log2(size + 1)), 31)] = 1
    out[112 + min(int(np.log2(lines + 1)), 15)] = 1
    out[128 + min(int(2 * np.log2(size / (lines + 1) + 1)), 31)] = 1
    return out


def _views(texts: list, sources: list, langs: list, sizes: list) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([_text_features(t) for t in texts]).reshape(-1, TEXT_BUCKETS)
    pages = [_page_features(s, lang, n, (t or "").count("\n")) for t, s, lang, n in zip(texts, sources, langs, sizes, strict=True)]
    return text, np.array(pages).reshape(-1, PAGE_BUCKETS)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge-penalised logistic regression with classes of equal weight, by accelerated descent."""
    each = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    step = 1 / (0.25 * float((each * (x * x).sum(axis=1)).sum() + 1) + ridge)
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb, last_w, last_b = w, b, w, b
    for k in range(1, steps + 1):
        error = each * (_sigmoid(x @ vw + vb) - y)
        w, b = vw - step * (x.T @ error + ridge * vw), vb - step * error.sum()
        pull = (k - 1) / (k + 2)
        vw, vb, last_w, last_b = w + pull * (w - last_w), b + pull * (b - last_b), w, b
    return w, b


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make a margin the log odds of the held-out labels; the slope is never negative."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    scale = margin.std() or 1.0
    w, b = _logistic((margin / scale)[:, None], y, ridge=1e-2, steps=400)
    return max(0.0, float(w[0]) / scale), float(b)


class Model:
    """Weights, bias, slope and offset of each view, and the log odds of good documents among the labelled."""

    def __init__(self, views: list[tuple[np.ndarray, float, float, float]], prior: float):
        self.views, self.prior = views, prior

    def log_odds(self, features: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        return [slope * (x @ w + b) + offset for x, (w, b, slope, offset) in zip(features, self.views, strict=True)]


def _packed_views(rows: DataFrame, label: str) -> list:
    """(pick, label, text, page): feature vectors of a bounded number of documents, one row per id, made on the executors."""

    def featured(batches: Iterator) -> Iterator:
        for batch in batches:
            cells = [batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")]
            text, page = _views(*cells)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("pick").cast(pa.float64()),
                    batch.column("label").cast(pa.float64()),
                    pa.array([r.astype("<f2").tobytes() for r in text], pa.binary()),
                    pa.array([r.astype("<f2").tobytes() for r in page], pa.binary()),
                ],
                names=["pick", "label", "text", "page"],
            )

    # rows that repeat an id are one document, the smallest: combined on the map side
    one = rows.groupBy("doc_id", F.col(label).cast("double").alias("label")).agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("d"))
    columns = [share("doc_id", seed=6).alias("pick"), "label", "d.text", "d.source", "d.lang", "d.n_chars"]
    found = one.select(*columns).mapInArrow(featured, "pick double, label double, text binary, page binary")
    return found.orderBy("pick", "label", "text").collect()


def _matrices(found: list) -> list[np.ndarray]:
    sizes = (TEXT_BUCKETS, PAGE_BUCKETS)
    return [np.array([np.frombuffer(bytes(r[c]), "<f2") for r in found], np.float64).reshape(-1, n) for c, n in zip(("text", "page"), sizes, strict=True)]


def _handed_over(free: DataFrame, views: list[tuple], taken: list[set[int]], growth: int) -> list:
    """(view, quality, doc_id): the unlabelled documents each view is surest of, ``growth`` of each quality, for the other view.

    Every unlabelled document is scored by both views; a task keeps its own first, a window over those takes the
    first of all. ``taken`` holds what each view has been handed before. Ties go to the smaller id.
    """
    gone = [np.array(sorted(t), dtype=np.int64) for t in taken]

    def surest(batches: Iterator) -> Iterator:
        best: dict[tuple[int, int], list] = {(v, q): [] for v in (0, 1) for q in (0, 1)}
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            cells = [batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")]
            ids = batch.column("doc_id").to_numpy()
            features = _views(*cells)
            for view, (w, b, slope, offset) in enumerate(views):
                sure = _sigmoid(slope * (features[view].astype(np.float16).astype(np.float64) @ w + b) + offset)
                free_ = ~np.isin(ids, gone[1 - view])
                for quality, trust in ((1, sure), (0, 1 - sure)):
                    at = np.flatnonzero(free_ & (trust >= SURE))
                    held = dict(best[view, quality])  # one entry per id
                    for i, t in zip(ids[at].tolist(), trust[at].tolist(), strict=True):
                        held[i] = max(t, held.get(i, 0.0))
                    best[view, quality] = sorted(held.items(), key=lambda e: (-e[1], e[0]))[:growth]
        rows = [(v, q, i, t) for (v, q), mine in best.items() for i, t in mine]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["view", "quality", "doc_id", "trust"])

    found = free.mapInArrow(surest, "view long, quality long, doc_id long, trust double")
    found = found.groupBy("view", "quality", "doc_id").agg(F.max("trust").alias("trust"))
    place = F.row_number().over(W.partitionBy("view", "quality").orderBy(F.desc("trust"), "doc_id"))
    first = found.withColumn("place", place).where(F.col("place") <= growth)
    return sorted((r["view"], r["quality"], r["doc_id"]) for r in first.collect())


def _clean(docs: DataFrame) -> DataFrame:
    casts = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(*[F.col(c).cast(t).alias(c) for c, t in casts.items()])


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """Co-training (doc_id, quality) labels over the two views; None unless both qualities occur.

    Both views learn from a bounded sample of the labelled documents of each quality. In every round both views score all
    unlabelled documents in Spark, and each hands those it is most sure of, a few of each quality, to the other one's training set.
    At the end a quarter of the labelled sample, never trained on, calibrates each view to log odds.
    The sample is chosen by a hash of the id, its size is a parameter; the driver gets feature vectors of the sample and of what is
    handed over, never texts. Rows without a doc_id are scored at the end, but not handed over.
    """
    small_batches(docs.sparkSession)
    docs = _clean(docs)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    if len(counts) < 2:
        return None
    pick = share("doc_id", seed=5)
    rate = F.when(F.col("quality") == 1, F.lit(min(1.0, LABELLED_ROWS / counts[1]))).otherwise(F.lit(min(1.0, LABELLED_ROWS / counts[0])))
    seeds = F.broadcast(known.where(pick < rate))  # about 2 * LABELLED_ROWS rows
    rows = _packed_views(docs.join(seeds, "doc_id"), "quality")
    y = np.array([r["label"] for r in rows])
    held = np.array([r["pick"] < 0.25 for r in rows], dtype=bool)
    if len(set(y[~held].tolist())) < 2:
        return None
    whole = _matrices(rows)
    own_x = [x[~held] for x in whole]
    own_y = [y[~held], y[~held]]
    ids = known.select("doc_id")
    numbered = docs.where("doc_id is not null")
    # with few labels no text moves; with many the unlabelled texts are written once
    free = numbered.join(F.broadcast(ids), "doc_id", "left_anti") if is_small(ids) else stored(numbered.join(ids, "doc_id", "left_anti"), "unlabelled")
    taken: list[set[int]] = [set(), set()]
    fitted = [_logistic(x, t) for x, t in zip(own_x, own_y, strict=True)]
    for _ in range(rounds):
        views = []
        for x, (w, b) in zip(whole, fitted, strict=True):
            views.append((w, b, *(_calibrated(x[held] @ w + b, y[held]) if held.any() else (1.0, 0.0))))
        handed = _handed_over(free, views, taken, GROWTH)
        if not handed:
            break
        # the label column carries view and quality, so that one job fetches all
        wanted = docs.sparkSession.createDataFrame([(i, float(2 * v + q)) for v, q, i in handed], "doc_id long, kind double")
        new = _packed_views(free.join(F.broadcast(wanted), "doc_id"), "kind")
        kinds, features = np.array([int(r["label"]) for r in new]), _matrices(new)
        for view in (0, 1):
            mine = kinds // 2 == view
            own_x[1 - view] = np.concatenate([own_x[1 - view], features[1 - view][mine]])
            own_y[1 - view] = np.concatenate([own_y[1 - view], (kinds[mine] % 2).astype(np.float64)])
            taken[1 - view] |= {i for v, _, i in handed if v == view}
        fitted = [_logistic(x, t) for x, t in zip(own_x, own_y, strict=True)]
    views = []
    for x, (w, b) in zip(whole, fitted, strict=True):
        slope, offset = _calibrated(x[held] @ w + b, y[held])
        views.append((w.astype(np.float32), b, slope, offset))
    return Model(views, float(np.log(counts[1] / counts[0])))


def scored(model: Model | None) -> Column:
    """struct(score, text_score, page_score): the probability of good quality, from both calibrated views and from each.

    The views are calibrated on samples with as many good as bad documents, so their log odds add up with those of
    good documents among the labelled. 1/2 without a model.
    """
    if model is None:
        return F.struct(*[F.lit(0.5).alias(c) for c in ("score", "text_score", "page_score")])

    @F.arrow_udf("score double, text_score double, page_score double")
    def score(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        cells = [texts.to_pylist(), sources.to_pylist(), langs.to_pylist(), sizes.to_pylist()]
        found = []
        for at in range(0, len(cells[0]), AT_ONCE):
            text, page = model.log_odds(_views(*[c[at : at + AT_ONCE] for c in cells]))
            found.append(np.stack([_sigmoid(text + page + model.prior), _sigmoid(text + model.prior), _sigmoid(page + model.prior)]))
        values = np.concatenate(found, axis=1) if found else np.zeros((3, 0))
        return pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in values], names=["score", "text_score", "page_score"])

    cast = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return score(*[F.col(c).cast(t) for c, t in cast.items()])


def qualities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, text_score, page_score, kept of every row of ``docs``.

    NULL texts are empty, NULL metadata is a class of its own, labels that contradict each other go by their mean. Repeated rows get
    the same result; other columns are ignored; an empty table gives an empty result.
    """
    found = _clean(docs).withColumn("s", scored(fit(docs, labels)))
    return found.select("doc_id", "s.score", "s.text_score", "s.page_score", (F.col("s")["score"] >= KEEP_FROM).alias("kept"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    found = unused(docs, "quality_score")
    return docs.withColumn(found, scored(fit(docs, labels))).where(F.col(found)["score"] >= KEEP_FROM).drop(found)
