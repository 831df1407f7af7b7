"""Language identification by a string kernel: blended-spectrum presence, Nystroem landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share, small_batches, unused

LONGEST_GRAM = 4
BUCKETS = 1 << 17
LANDMARKS = 40  # documents of each language that span the kernel's feature space, about
TRAINING_ROWS = 500  # documents of each language that the regression is fitted on, about
RIDGE = 1e-3
UNKNOWN = "und"
HELD_OUT = (4, 2)


def held_out(doc_id: Column | str, parts: int, part: int) -> Column:
    """crc32 of the id as text falls into ``part``; rows without an id count as the empty text."""
    key = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % parts == part


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


class Grams:
    """The set of a text's n-grams of 1 to 4 characters as hash buckets; all that is not a letter counts as one space."""

    def __init__(self):
        self.letters = _letters()

    def __call__(self, text: str) -> np.ndarray | None:
        """Sorted bucket numbers, None if the text has no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        beyond = codes > 0xFFFF
        letter = self.letters[np.where(beyond, 0, codes)]
        if beyond.any():
            kinds, at = np.unique(codes[beyond], return_inverse=True)
            letter[beyond] = np.array([chr(k).isalpha() for k in kinds])[at]
        if not letter.any():
            return None
        letter_or_space = np.where(letter, codes, 32).astype(np.uint64)
        kept = letter | np.concatenate([[True], letter[:-1]])
        c = letter_or_space[kept]
        seen = np.zeros(BUCKETS, dtype=bool)
        h = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, LONGEST_GRAM + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
            seen[(h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)] = True
        return np.flatnonzero(seen)


def _rows_times(matrix: np.ndarray, sets: list[np.ndarray], place: np.ndarray | None = None) -> np.ndarray:
    """Presence vectors of a batch times ``matrix``, one row per set, scaled by the root of the set's size; ``place`` says where a bucket's row is."""
    lengths = np.array([len(s) for s in sets])
    buckets = np.concatenate(sets)
    parts = np.add.reduceat(matrix[buckets if place is None else place[buckets]], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)
    return parts / np.sqrt(lengths)[:, None]


def _blocks(texts: list, most: int = 1 << 20) -> Iterator[list[int]]:
    """Row numbers in runs of about ``most`` characters."""
    run, size = [], 0
    for i, text in enumerate(texts):
        run.append(i)
        size += len(text or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _sampled(rows: DataFrame, counts: dict[str, int], each: int, seed: int) -> DataFrame:
    """About ``each`` rows of every language, chosen by a hash of the id and text; all rows of rarer ones."""
    pairs = [F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))]
    return rows.where(share("doc_id", "text", seed=seed) < F.create_map(*pairs)[F.col("lang")])


class Model:
    """langs, weights (one row of the hashed feature space per bucket, one column per language) and bias."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray):
        self.langs, self.weights, self.bias = langs, weights, bias


def fit(docs: DataFrame, landmarks: int = LANDMARKS, training_rows: int = TRAINING_ROWS) -> Model | None:
    """Learn from ``text`` and ``lang`` of all rows of ``docs`` with both; None if there are none.

    The kernel of two texts is the number of n-grams they share by the root of the product of the numbers each has.
    Landmarks span the feature space; the regression is fitted on a bounded sample of each language,
    and both bounds are parameters. The driver gets the landmarks' bucket numbers and one short row of
    kernel values per sampled document, never a text. As kernel rows are products with the landmark
    matrix, it is multiplied with the regression's weights once, and scoring a batch is one product.
    """
    small_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    langs = sorted(counts)

    def gram_sets(batches: Iterator) -> Iterator:
        grams = Grams()
        for batch in batches:
            for run in _blocks(texts := batch.column("text").to_pylist()):
                found = [(grams(texts[i]), i) for i in run]
                sets = [(s.astype("<i4").tobytes(), i) for s, i in found if s is not None]
                langs = batch.column("lang").take(pa.array([i for _, i in sets], pa.int64()))
                yield pa.RecordBatch.from_arrays([langs.cast(pa.string()), pa.array([s for s, _ in sets], pa.binary())], names=["lang", "grams"])

    marks = _sampled(known, counts, landmarks, 1).select("lang", "text").mapInArrow(gram_sets, "lang string, grams binary")
    sets = [np.frombuffer(bytes(r["grams"]), dtype="<i4") for r in marks.orderBy("lang", "grams").collect()]
    if not sets:
        return None
    spread = np.zeros((BUCKETS, len(sets)), dtype=np.float32)
    for k, s in enumerate(sets):
        spread[s, k] = 1 / np.sqrt(len(s))
    used = np.flatnonzero(spread.any(axis=1))
    narrow = spread[used]

    def kernel_rows(batches: Iterator) -> Iterator:
        # rows of the buckets that landmarks have, and one of zeros for all others
        grams, matrix = Grams(), np.concatenate([narrow, np.zeros((1, narrow.shape[1]), dtype=np.float32)])
        place = np.full(BUCKETS, len(narrow), dtype=np.int32)
        place[used] = np.arange(len(narrow))
        for batch in batches:
            for run in _blocks(texts := batch.column("text").to_pylist(), 1 << 17):  # a row of the matrix per n-gram
                found = [(s, i) for i in run if (s := grams(texts[i])) is not None]
                if found:
                    rows = _rows_times(matrix, [s for s, _ in found], place).astype("<f4")
                    langs = batch.column("lang").take(pa.array([i for _, i in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([langs.cast(pa.string()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "row"])

    sample = _sampled(known, counts, training_rows, 2).select("lang", "text").mapInArrow(kernel_rows, "lang string, row binary")
    taken = sample.orderBy("lang", "row").collect()  # bounded: a row of kernel values per sampled document
    if not taken:
        return None
    kernel = np.array([np.frombuffer(bytes(r["row"]), dtype="<f4") for r in taken], dtype=np.float64)
    own = np.array([langs.index(r["lang"]) for r in taken])
    among = np.array([spread[s].sum(axis=0) / np.sqrt(len(s)) for s in sets], dtype=np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    use = values > 1e-6 * values.max()
    root = vectors[:, use] / np.sqrt(values[use])
    features = kernel @ root
    targets = np.eye(len(langs))[own]
    # classes count alike, however many rows each has
    weight = (1 / np.bincount(own, minlength=len(langs)).clip(1))[own][:, None]
    weight = weight / weight.sum()
    mean_x, mean_y = (weight * features).sum(axis=0), (weight * targets).sum(axis=0)
    x, y = features - mean_x, targets - mean_y
    beta = np.linalg.solve(x.T @ (weight * x) + RIDGE * np.eye(x.shape[1]), x.T @ (weight * y))
    weights = spread @ (root @ beta).astype(np.float32)
    return Model(langs, weights, mean_y - mean_x @ beta)


def predicted(model: Model | None, text: str = "text") -> Column:
    """struct(lang, score): the language with the largest regression value; score is 1/2 plus half the lead over the second.

    ``und`` with score 0 for NULL texts and texts without a letter, or if there is no model.
    """
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    langs, used = model.langs, np.flatnonzero(model.weights.any(axis=1))
    narrow, bias = model.weights[used], model.bias

    @F.arrow_udf("lang string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams, matrix = Grams(), np.zeros((BUCKETS, len(langs)), dtype=np.float32)
        matrix[used] = narrow
        for batch in batches:
            texts = batch.to_pylist()
            found: list = [UNKNOWN] * len(texts)
            scores = [0.0] * len(texts)
            for run in _blocks(texts):
                sets = [(s, i) for i in run if texts[i] and (s := grams(texts[i])) is not None]
                if not sets:
                    continue
                values = _rows_times(matrix, [s for s, _ in sets]) + bias
                order = np.argsort(-values, axis=1, kind="stable")
                at = np.arange(len(sets))
                best = values[at, order[:, 0]]
                second = values[at, order[:, 1]] if len(langs) > 1 else np.zeros(len(sets))
                for (_, i), k, lead in zip(sets, order[:, 0], best - second, strict=True):
                    found[i], scores[i] = langs[k], float(min(1.0, max(0.0, 0.5 + 0.5 * lead)))
            yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return predict(F.col(text))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from rows that are not held out.

    Rows are held out by their id alone. lang, source and doc_id are no inputs of a prediction. Repeated rows get the same
    result; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows.where(~held_out("doc_id", *HELD_OUT)))
    found = rows.select("doc_id", held_out("doc_id", *HELD_OUT).alias("held_out"), predicted(model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p")["lang"].alias("lang_pred"), F.col("p")["score"].alias("score"))


def identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more; texts without a letter go.

    Where no row has a language to learn from, nothing can be told apart and every text with a letter stays.
    """
    model = fit(docs.where(~held_out("doc_id", *HELD_OUT)))
    if model is None:
        return docs.where(F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)))
    found = unused(docs, "predicted_language")
    marked = docs.withColumn(found, predicted(model))
    return marked.where((F.col(found)["lang"] != UNKNOWN) & (F.col(found)["score"] >= least)).drop(found)
