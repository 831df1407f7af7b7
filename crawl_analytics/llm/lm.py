"""Language-model scoring: interpolated modified Kneser-Ney bigrams in memory-mapped sorted hash arrays."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attempt_name, blocks_for, file_system, folder, share, whole_file
from .langid import held_out

HELD_OUT = (7, 2)
BEGIN, END = np.uint64(1), np.uint64(2)  # hashes of the text's begin and end; words have larger ones
SHARD_BYTES, LARGEST_SHARD_BYTES = 8 << 20, 256 << 20  # bytes of text whose bigrams make one shard, about
SHARDS = 4096  # before their number, the shards' size grows with the text, up to the largest
HOT_SAMPLE_BYTES = 32 << 20  # of text that says which first words are frequent; this only deals out work
HOT_SHARE = 0.05  # a first word with more of a shard's tokens than this is dealt out by whole bigrams
MOST_HOT = 200_000
PAIRS_AT_ONCE = 3_000_000
TOKENS_AT_ONCE = 500_000
FULL = 255  # counts from here on are kept beside the array of small ones


def _tokens(text: bytes) -> np.ndarray:
    """Hashes of begin, the words and end."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()  # bytes: exactly A-Z, exactly space and 0x09-0x0D
    out = np.empty(len(words) + 2, dtype=np.uint64)
    out[0], out[-1] = BEGIN, END
    out[1:-1] = np.maximum(np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words)), np.uint64(3))
    return out


def _pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The hash of a bigram."""
    h = u * np.uint64(0x9E3779B97F4A7C15) + v * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(31))


class Deal:
    """The shard of each bigram: that of its first word, or, behind a frequent first word, of the pair."""

    def __init__(self, shards: int, hot: np.ndarray):
        self.shards, self.hot = shards, np.sort(hot.astype(np.uint64))

    def of(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        own = u
        if len(self.hot):
            place = np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)
            own = np.where(self.hot[place] == u, _pair(u, v), u)
        return (own % np.uint64(self.shards)).astype(np.int64)


def _hot_words(texts: DataFrame, size: int, shards: int) -> np.ndarray:
    """Hashes of the words that alone would fill a good part of a shard, from a bounded sample of the texts.

    The sample decides where a bigram is counted, never whether or how often.
    """
    chosen = texts.where(share("text", seed=8) < F.lit(min(1.0, HOT_SAMPLE_BYTES / max(1, size))))

    def count(batches: Iterator) -> Iterator:
        for batch in batches:
            tokens = [_tokens(t or b"")[:-1] for t in batch.column("text").to_pylist()]
            words, n = np.unique(np.concatenate(tokens or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    words = chosen.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = words.where(F.col("n") * shards > HOT_SHARE * total).orderBy(F.desc("n"), "word").limit(MOST_HOT)
    return np.array([r["word"] for r in hot.collect()], dtype=np.int64).view(np.uint64)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys, the first place of each, and the sums of ``values`` over equal keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], order[first], *[np.add.reduceat(x[order], first) if len(keys) else x for x in values]


def _cut(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of one length each that ``b"".join`` of their bytes made."""
    n = len(blob) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


PAIRS = ["<u8", "<u8", "<u4"]  # first word, second word, count inside one task's share
CONTEXTS = ["<u8", "<u8", "<u4", "<u4", "<u4"]  # word, tokens after it, kinds of them seen once, twice, more often
FOLLOWERS = ["<u8", "<u4"]  # word, kinds of words before it


def _joined(blobs, kinds: list[str]) -> list[np.ndarray]:
    parts = [_cut(b, kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kinds[i]) for i in range(len(kinds))]


def _counted(texts: DataFrame, deal: Deal) -> DataFrame:
    """(shard, blob): bigram counts, summed inside a task."""

    def emit(u: np.ndarray, v: np.ndarray) -> Iterator:
        _, at, n = _summed(_pair(u, v), np.ones(len(u), dtype=np.int64))
        u, v = u[at], v[at]
        shard = deal.of(u, v)
        order = np.lexsort((v, u, shard))
        u, v, n, shard = u[order], v[order], n[order].astype("<u4"), shard[order]
        ids, begin = np.unique(shard, return_index=True)
        ends = [*begin[1:], len(shard)]
        blobs = [u[a:b].tobytes() + v[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(begin, ends, strict=True)]
        for at in range(0, len(ids), 16):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 16]), pa.array(blobs[at : at + 16], pa.binary())], names=["shard", "blob"])

    def count(batches: Iterator) -> Iterator:
        held, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                held.append(_tokens(text.as_py() or b""))
                size += len(held[-1])
                if size >= PAIRS_AT_ONCE:
                    yield from emit(np.concatenate([t[:-1] for t in held]), np.concatenate([t[1:] for t in held]))
                    held, size = [], 0
        if held:
            yield from emit(np.concatenate([t[:-1] for t in held]), np.concatenate([t[1:] for t in held]))

    return texts.mapInArrow(count, "shard long, blob binary")


def _pair_shards(counted: DataFrame, shards: int, root: str) -> DataFrame:
    """Write each shard's bigrams; (shard, kind, blob) with what the word tables need: contexts, followers, kinds by count."""

    def merge(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        u, v, n = _joined((b.as_py() for b in rows.column("blob")), PAIRS)
        keys, at, counts = _summed(_pair(u, v), n.astype(np.int64))
        u, v = u[at], v[at]
        large = np.flatnonzero(counts >= FULL)
        with whole_file(f"{root}/pairs-{shard}", attempt_name()) as out:
            for part in (np.array([len(keys), len(large)], "<i8"), keys.astype("<u8"), large.astype("<i8"), counts[large].astype("<i8"), np.minimum(counts, FULL).astype("<u1")):
                out.write(part.tobytes())
        once, twice, more = (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64)
        words, _, total, n1, n2, n3 = _summed(u, counts, once, twice, more)
        next_words, _, before = _summed(v, np.ones(len(v), dtype=np.int64))
        kinds = np.array([(counts == k).sum() for k in (1, 2, 3, 4)], "<i8")
        found = [(shard, 2, kinds.tobytes())]
        for kind, columns, types in ((0, (words, total, n1, n2, n3), CONTEXTS), (1, (next_words, before), FOLLOWERS)):
            target = (columns[0] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            ids, begin = np.unique(target[order], return_index=True)
            for i, a, b in zip(ids, begin, [*begin[1:], len(order)], strict=True):
                found.append((int(i), kind, b"".join(c[order[a:b]].astype(t).tobytes() for c, t in zip(columns, types, strict=True))))
        return pa.table({"shard": pa.array([f[0] for f in found], pa.int64()), "kind": pa.array([f[1] for f in found], pa.int32()), "blob": pa.array([f[2] for f in found], pa.binary())})

    return counted.groupBy("shard").applyInArrow(merge, "shard long, kind int, blob binary")


SUMS = ["tokens", "texts", "words", "bigrams", *[f"p{k}" for k in (1, 2, 3, 4)], *[f"w{k}" for k in (1, 2, 3, 4)], "kinds1", "kinds2", "kinds3"]


def _word_shards(parts: DataFrame, root: str) -> DataFrame:
    """Write each shard's words; one row of sums a shard."""

    def merge(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        blobs: list[list[bytes]] = [[], [], []]
        for kind, blob in zip(rows.column("kind").to_pylist(), rows.column("blob"), strict=True):
            blobs[kind].append(blob.as_py())
        words, total, n1, n2, n3 = _joined(blobs[0], CONTEXTS)
        after, before = _joined(blobs[1], FOLLOWERS)
        every = np.concatenate([words, after])
        pad = lambda x, first: np.concatenate([x, np.zeros(len(after), np.int64)] if first else [np.zeros(len(words), np.int64), x]).astype(np.int64)
        ids, _, total, n1, n2, n3, before = _summed(every, pad(total, True), pad(n1, True), pad(n2, True), pad(n3, True), pad(before, False))
        with whole_file(f"{root}/words-{shard}", attempt_name()) as out:
            for part, kind in ((np.array([len(ids)]), "<i8"), (ids, "<u8"), (total, "<i8"), (n1, "<u4"), (n2, "<u4"), (n3, "<u4"), (before, "<u4")):
                out.write(part.astype(kind).tobytes())
        pairs = np.array([np.frombuffer(b, "<i8") for b in blobs[2]]).reshape(-1, 4).sum(axis=0)
        seen = [int((before == k).sum()) for k in (1, 2, 3, 4)]
        sums = [total.sum(), total[ids == BEGIN].sum(), (before[ids != END] > 0).sum(), before.sum(), *pairs, *seen, seen[0], seen[1], (before > 2).sum()]
        return pa.table({c: pa.array([int(x)], pa.int64()) for c, x in zip(SUMS, sums, strict=True)})

    return parts.groupBy("shard").applyInArrow(merge, ", ".join(f"{c} long" for c in SUMS))


def _discounts(n: list[int]) -> list[float]:
    """Discounts for counts of one, two and more, from the numbers of kinds seen 1, 2, 3 and 4 times.

    Where a number is zero or a discount leaves its range, as in tiny corpora, absolute discounts of 1/2, 3/4 and 3/4 are taken.
    """
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        found = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        if all(0 < d <= k for k, d in zip((1, 2, 3), found, strict=True)):
            return found
    return [0.5, 0.75, 0.75]


class Shards:
    """A worker's view of the model: arrays mapped into memory when first asked for."""

    def __init__(self, root: str, deal: Deal):
        self.root, self.deal, self.shards, self.pairs, self.words = root, deal, deal.shards, {}, {}

    def _local(self, name: str) -> str | None:
        system, path = file_system(f"{self.root}/{name}")
        from pyarrow import fs

        if isinstance(system, fs.LocalFileSystem):
            return path if os.path.exists(path) else None
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        import tempfile

        # a store that cannot be mapped: one copy for this worker, whose name goes once it is mapped
        handle, copy = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out, system.open_input_stream(path) as source:
            while part := source.read(1 << 22):
                out.write(part)
        return copy

    def _mapped(self, name: str, layout) -> list[np.ndarray] | None:
        path = self._local(name)
        if path is None:
            return None
        whole = np.memmap(path, dtype="<u1", mode="r")
        if not path.endswith(name):
            os.unlink(path)
        out, at = [], 0
        for kind, count in layout(whole):
            size = np.dtype(kind).itemsize * count
            out.append(whole[at : at + size].view(kind))
            at += size
        return out

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shard, kind="stable")
        ids, begin = np.unique(shard[order], return_index=True)
        for i, a, b in zip(ids, begin, [*begin[1:], len(order)], strict=True):
            yield int(i), order[a:b]

    def pair_counts(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        def layout(whole):
            n, m = whole[:16].view("<i8").tolist()
            return [("<i8", 2), ("<u8", n), ("<i8", m), ("<i8", m), ("<u1", n)]

        keys, at = np.unique(_pair(u, v), return_index=True)
        back = np.searchsorted(keys, _pair(u, v))
        counts = np.zeros(len(keys), dtype=np.int64)
        for shard, rows in self._by_shard(self.deal.of(u[at], v[at])):
            if shard not in self.pairs:
                self.pairs[shard] = self._mapped(f"pairs-{shard}", layout)
            if (found := self.pairs[shard]) is None or not len(found[1]):
                continue
            _, known, large, values, small = found
            place = np.minimum(np.searchsorted(known, keys[rows]), len(known) - 1)
            n = np.where(known[place] == keys[rows], small[place], 0).astype(np.int64)
            full = n == FULL
            n[full] = values[np.searchsorted(large, place[full])]
            counts[rows] = n
        return counts[back]

    def word_rows(self, ids: np.ndarray) -> np.ndarray:
        """tokens after the word, kinds of them seen once, twice, more often, and kinds of words before it: a column per id."""

        def layout(whole):
            n = int(whole[:8].view("<i8")[0])
            return [("<i8", 1), ("<u8", n), ("<i8", n), *[("<u4", n)] * 4]

        out = np.zeros((5, len(ids)), dtype=np.int64)
        for shard, rows in self._by_shard((ids % np.uint64(self.shards)).astype(np.int64)):
            if shard not in self.words:
                self.words[shard] = self._mapped(f"words-{shard}", layout)
            if (found := self.words[shard]) is None or not len(found[1]):
                continue
            _, known, *columns = found
            place = np.minimum(np.searchsorted(known, ids[rows]), len(known) - 1)
            hit = known[place] == ids[rows]
            for k, column in enumerate(columns):
                out[k, rows] = np.where(hit, column[place], 0)
        return out


class Model:
    """Where the arrays are, and the sums over all of them."""

    def __init__(self, root: str, deal: Deal, sums: dict[str, int]):
        self.root, self.deal, self.sums = root, deal, sums
        self.pair_discounts = _discounts([sums[f"p{k}"] for k in (1, 2, 3, 4)])
        self.word_discounts = _discounts([sums[f"w{k}"] for k in (1, 2, 3, 4)])
        self.kinds = sums["words"] + (1 if sums["texts"] else 0)  # distinct tokens, the end included
        self.all_kinds = [sums[f"kinds{k}"] for k in (1, 2, 3)]


def train(docs: DataFrame) -> Model:
    """Count the bigrams of all texts and write the model's arrays to the shared folder.

    Every map task sums its own bigrams before anything moves; blocks of sorted arrays are then gathered by shard. A shard
    holds the bigrams whose first word's hash falls into it; those of a frequent first word are spread over all shards by the
    pair's hash, so no shard fills up with one word's followers. What a shard knows of a word, the tokens and kinds
    after it and the kinds before it, adds up over shards in a second, smaller exchange. Nothing is pruned; the driver
    gets the frequent words of a bounded sample and one row of sums.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = blocks_for(size, min(max(SHARD_BYTES, size // SHARDS), LARGEST_SHARD_BYTES))
    deal = Deal(shards, _hot_words(texts, size, shards) if shards > 1 else np.zeros(0, np.uint64))
    root = folder(spark, "bigrams")
    sums = _word_shards(_pair_shards(_counted(texts, deal), shards, root), root)
    found = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]).first().asDict()
    return Model(root, deal, found)


def _scored(model: Model, shards: Shards, texts: list[bytes]) -> list[tuple[int, int, float, float]]:
    """(tokens, known tokens, base score, score) of each text."""
    sums = model.sums
    tokens = [_tokens(t) for t in texts]
    u, v = np.concatenate([t[:-1] for t in tokens]), np.concatenate([t[1:] for t in tokens])
    begin = np.concatenate([[0], np.cumsum([len(t) - 1 for t in tokens])[:-1]])
    ids = np.unique(np.concatenate([u, v]))
    rows = shards.word_rows(ids)
    at_u, at_v = np.searchsorted(ids, u), np.searchsorted(ids, v)
    total, once, twice, more, _ = rows[:, at_u].astype(np.float64)
    seen = np.where(v == END, sums["texts"], rows[0, at_v])
    before = rows[4, at_v]
    pairs = shards.pair_counts(u, v)

    def less(counts: np.ndarray, discounts: list[float]) -> np.ndarray:
        d = np.choose(np.minimum(counts, 3), [0.0, *discounts])
        return np.maximum(counts - d, 0.0)

    bigrams = sums["bigrams"]
    left = sum(d * n for d, n in zip(model.word_discounts, model.all_kinds, strict=True)) / bigrams if bigrams else 1.0
    low = (less(before, model.word_discounts) / bigrams if bigrams else 0.0) + left / (model.kinds + 1)
    d1, d2, d3 = model.pair_discounts
    some = np.maximum(total, 1.0)
    back = np.where(total > 0, (d1 * once + d2 * twice + d3 * more) / some, 1.0)
    score = np.log10(np.where(total > 0, less(pairs, model.pair_discounts) / some, 0.0) + back * low)
    base = np.log10((seen + 1.0) / (sums["tokens"] + model.kinds + 1.0))
    add = lambda x: np.add.reduceat(x, begin)
    lengths = [len(t) - 1 for t in tokens]
    return list(zip(lengths, add((seen > 0).astype(np.int64)).tolist(), add(base).tolist(), add(score).tolist(), strict=True))


RESULT = "n_tokens long, n_known long, base_score double, score double"


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the log10 probabilities of the whole texts under the model."""
    spark_type = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def score(batches: Iterator) -> Iterator:
        shards = Shards(model.root, model.deal)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text_bytes").to_pylist()]
            found, run, size = [], [], 0
            for text in texts:
                run.append(text)
                size += len(text) // 5 + 1
                if size >= TOKENS_AT_ONCE:
                    found += _scored(model, shards, run)
                    run, size = [], 0
            if run:
                found += _scored(model, shards, run)
            if found:
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], names=[*keep, "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("text_bytes"))
    return rows.mapInArrow(score, f"{spark_type}, {RESULT}")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    The model learns from the rows that are not held out. NULL texts are empty: one token, the end. Repeated rows count
    as often as they stand there; rows without a doc_id count as id ''; other columns are ignored; with no training
    rows every token has probability 1 / 1.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", *HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    model = train(rows.where(~F.col("held_out")))
    found = scored(rows, model, ["doc_id", "held_out"])
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    tokens = F.lit(model.sums["tokens"]).cast("long")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", tokens.alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
