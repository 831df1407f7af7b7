"""SimHash near-duplicates by anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import small_batches, stored, unused
from .components import components

SHINGLE = 3
HASH_SEED = 42
LIMIT = 2
HALF = 32


def _fingerprints(texts: list[bytes], width: int, seed: int) -> list[int]:
    import xxhash

    out, digest = [], xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()  # bytes: exactly A-Z, exactly space and 0x09-0x0D
        if not words:
            out.append(0)
            continue
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words]).tolist()
        ends = (ends - 1).tolist()
        if len(words) <= width:
            hashes = [digest(line, seed)]
        else:
            hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]
        counts = np.zeros(64, dtype=np.int64)
        values = np.array(hashes, dtype="<u8")
        for at in range(0, len(values), 1 << 16):
            part = values[at : at + (1 << 16)]
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = (counts * 2 > len(values)).astype(np.uint8)
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return out


def with_fingerprint(docs: DataFrame, into: str, width: int = SHINGLE, seed: int = HASH_SEED) -> DataFrame:
    """Add the 64-bit SimHash of ``text`` as a long: row by row, no shuffle. NULL and empty texts have 0."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array(_fingerprints([t or b"" for t in texts.to_pylist()], width, seed), pa.int64())

    small_batches(docs.sparkSession)
    # never NULL, and said so: a filter for it would compute the fingerprint a second time
    return docs.withColumn(into, F.coalesce(fingerprint(F.col("text").cast("binary")), F.lit(0).cast("long")))


def _anchors(values, visitors: bool):
    """(positions, codewords) of 32-bit words against the code: Hamming [31, 26] on bits 0-30, bit 31 as it is.

    The code is perfect with covering radius 1, so a word has one home within
    the radius. Visitors get every codeword within radius + 1: the home, 15 more at distance
    2 and the home with bit 31 flipped (a word that is a codeword: itself and the flip).
    """
    place = np.arange(1, 32, dtype=np.uint64)
    low = values & np.uint64(0x7FFFFFFF)
    syndrome = np.zeros(len(values), dtype=np.uint64)
    for k in place:
        syndrome ^= ((low >> (k - np.uint64(1))) & np.uint64(1)) * k
    bit = lambda k: np.where(k > 0, np.uint64(1) << (np.maximum(k, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    home = values ^ bit(syndrome)
    at = np.arange(len(values))
    if not visitors:
        return at, home
    words, rows = [home, home ^ np.uint64(1 << 31)], [at, at]
    for i in place:
        j = syndrome ^ i
        ok = (syndrome > 0) & (j > i)
        rows.append(at[ok])
        words.append(values[ok] ^ bit(np.full(ok.sum(), i, dtype=np.uint64)) ^ bit(j[ok]))
    return np.concatenate(rows), np.concatenate(words)


def _replicated(fingerprints: DataFrame, visitors: bool) -> DataFrame:
    def replicate(batches: Iterator) -> Iterator:
        for batch in batches:
            whole = batch.column("fp").to_numpy().astype(np.int64)
            for begin in range(0, len(whole), 1 << 14):
                part = whole[begin : begin + (1 << 14)]
                for half in (0, 1):
                    values = (part.view(np.uint64) >> np.uint64(HALF * half)) & np.uint64(0xFFFFFFFF)
                    at, words = _anchors(values, visitors)
                    anchor = (words | np.uint64(half << HALF)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[at])], names=["anchor", "fp"])

    return fingerprints.select("fp").mapInArrow(replicate, "anchor long, fp long")


def near_links(fingerprints: DataFrame) -> DataFrame:
    """(a, b) for every pair of different values of ``fp`` that differ in at most two bits. ``fp`` must be distinct.

    Two fingerprints at distance 2 have a half of 32 bits in which they differ in at most one
    bit. On each half the anchors are the words of a covering code with radius 1; a fingerprint
    is at home at the one anchor within the radius and visits all anchors within radius + 1
    (17 a half at most), so that the other one of such a pair visits its home. Only homes meet visitors,
    at one of 2^27 anchors a half; the smaller one of a pair is taken at home.
    Spark sizes both sides by ``fingerprints``, as if Python returned a row for a row, and would broadcast the up to 34
    visits of each from the driver; so the join is a shuffle join by hint.
    """
    home = _replicated(fingerprints, False).withColumnRenamed("fp", "a").hint("merge")
    visit = _replicated(fingerprints, True).withColumnRenamed("fp", "b").hint("merge")
    near = F.expr(f"a < b and bit_count(a ^ b) <= {LIMIT}")
    return home.join(visit, (home["anchor"] == visit["anchor"]) & near).select("a", "b")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def classes(narrow: DataFrame) -> DataFrame:
    """(doc_id, fp) -> (fp, component_id, component_fp), one row per distinct fingerprint.

    component_id is the smallest doc_id reachable (NULL if no document of the component has one),
    component_fp the smallest fingerprint with a document of that id.
    """
    distinct = stored(narrow.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "fingerprints")
    member = components(near_links(distinct)).withColumnRenamed("id", "fp")
    placed = distinct.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = stored(placed, "members")
    # min over (NULL flag, id, fp): documents without an id lose to those with one
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("low_id").isNull(), "low_id", "fp")).alias("m"))
    first = first.select("root", F.col("m.low_id").alias("component_id"), F.col("m.fp").alias("component_fp"))
    return placed.join(first, "root").select("fp", "component_id", "component_fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row per row of ``docs``.

    Copies share a fingerprint and become one vertex before anything is joined, so a group of copies costs
    one row after the map-side combine. Two documents are linked if their fingerprints differ
    in at most two bits. NULL and empty texts have fingerprint zero and are linked like any other.
    A NULL doc_id counts as larger than all others. Other columns are ignored, an empty table gives an empty result.
    The last join is a shuffle join by hint: copies compress to a byte a row, so Spark would take a table of many for small.
    """
    fp = unused(docs, "fp")
    narrow = with_fingerprint(docs.select("doc_id", "text"), fp).select("doc_id", F.col(fp).alias("fp"))
    narrow = stored(narrow, "doc-fingerprints")
    return narrow.hint("merge").join(classes(narrow), "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of every component one row, of the smallest id.

    Where several rows have that id (or none has an id) the smallest fingerprint decides, then the text with the
    smallest XXH64, then the remaining columns that can be ordered; repeated rows count once. Repeats are
    combined on the map side, so texts move once, and Python sees them only for the fingerprint.
    """
    narrow = with_fingerprint(docs.select("doc_id", "text"), "fp").select("doc_id", "fp", F.xxhash64("text").alias("h"))
    narrow = stored(narrow, "doc-fingerprints")
    least = narrow.groupBy(F.col("doc_id").alias("component_id"), F.col("fp").alias("component_fp")).agg(F.min("h").alias("h"))
    roots = classes(narrow).select("component_id", "component_fp").distinct()
    same = least["component_id"].eqNullSafe(roots["component_id"]) & (least["component_fp"] == roots["component_fp"])
    chosen = least.join(roots, same, "left_semi")
    keys = lambda doc_id, h: (F.coalesce(doc_id, F.lit(0)).alias("__id"), F.isnull(doc_id).alias("__none"), F.col(h).alias("__h"))
    ranks = [f.name for f in docs.schema.fields if f.name != "text" and not isinstance(f.dataType, (MapType, VariantType))]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("__row"), F.xxhash64("text").alias("__hash"))
    first = F.min_by("__row", F.struct("__row.text", *[F.col(f"__row.`{c}`") for c in ranks]))
    rows = rows.groupBy(*keys(F.col("__row.doc_id"), "__hash")).agg(first.alias("__row"))
    # an inner join: a semi join would be pushed below the aggregation and bring all repeats of a row to one task
    return rows.join(chosen.select(*keys(F.col("component_id"), "h")), ["__id", "__none", "__h"]).select("__row.*")
