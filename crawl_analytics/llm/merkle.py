"""Document fingerprints: a Merkle tree over blocks of paragraphs and sections. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import blocks_for, stored

BLOCK_CHARS = 64
SECTION_BLOCKS = 32
SECTION_DIGITS, LEAF_DIGITS = 16, 8
ROWS_PER_RANGE = 100_000


def blocks(text: Column) -> Column:
    """The leaves: every line with its line break, cut after each 64 characters. Together they are the whole text."""
    return F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{BLOCK_CHARS}}}\n?|\n"), F.lit(0))


def tree(text: Column) -> Column:
    """struct(root, sections, leaves) of a text: SHA-256 of each leaf, of every 32 leaves' digests, and of these.

    leaves holds the first 32 bits of each leaf's digest as a number.
    """
    digests = F.transform(blocks(text), lambda b: F.sha2(b, 256))
    count = F.ceil(F.size(digests) / SECTION_BLOCKS).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    sections = F.transform(at, lambda i: F.sha2(F.array_join(F.slice(digests, i * SECTION_BLOCKS + 1, SECTION_BLOCKS), ""), 256))
    root = F.sha2(F.concat(F.lit("root:"), F.array_join(sections, "")), 256)
    leaves = F.transform(digests, lambda d: F.conv(F.substring(d, 1, LEAF_DIGITS), 16, 10).cast("long"))
    return F.struct(root.alias("root"), sections.alias("sections"), leaves.alias("leaves"))


def as_text(node: Column) -> Column:
    """The tree in hexadecimal digits, root:sections:leaves with 64, 16 and 8 digits each; equal for equal texts."""
    sections = F.array_join(F.transform(node["sections"], lambda s: F.substring(s, 1, SECTION_DIGITS)), "")
    leaves = F.lower(F.array_join(F.transform(node["leaves"], lambda v: F.lpad(F.hex(v), LEAF_DIGITS, "0")), ""))
    return F.concat_ws(":", node["root"], sections, leaves)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else below 1: twice the shared leaves by the leaves of both."""
    both = F.size(F.array_intersect(a["leaves"], b["leaves"]))
    each = F.size(F.array_distinct(a["leaves"])) + F.size(F.array_distinct(b["leaves"]))
    some = F.when(each == 0, F.lit(0.0)).otherwise(F.least(2.0 * both / each, F.lit(0.999999)))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(some)


def edited_sections(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections whose digests differ: the branches to follow to an edit."""
    count = F.greatest(F.size(a["sections"]), F.size(b["sections"]))
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    section = lambda node, i: F.get(node["sections"], i)
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(
        F.filter(at, lambda i: ~section(a, i).eqNullSafe(section(b, i)))
    )


def successors(ids: DataFrame, name: str) -> DataFrame:
    """Distinct ids -> (id, before): each id with the one before it, the first with the last.

    The ids are laid out in ranges by Spark's own range partitioning and stored; inside a range a window finds the
    predecessor, and the first of a range takes the last id of the ranges before.
    """
    ranges = blocks_for(ids.count(), ROWS_PER_RANGE)
    laid = ids.select(F.col(name).alias("id")).repartitionByRange(ranges, "id").withColumn("range", F.spark_partition_id())
    laid = stored(laid, "id-ranges")
    # one row per range
    ends = laid.groupBy("range").agg(F.max("id").alias("last"))
    whole = W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.withColumn("carried", F.coalesce(F.lag("last").over(W.orderBy("range")), F.max("last").over(whole))).drop("last")
    inside = laid.withColumn("lag", F.lag("id").over(W.partitionBy("range").orderBy("id")))
    return inside.join(ends, "range").select("id", F.coalesce("lag", "carried").alias("before"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and node (the tree) of every text, row by row: no shuffle."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", tree(text).alias("node")).select("doc_id", as_text(F.col("node")).alias("fingerprint"), "node")


def compared_with_edit(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_sections.

    The edited text is the text with its last quarter replaced by as many first characters of the next document.
    Texts are shuffled once, by doc_id; each sends what its predecessor needs, the first quarter at most of that one's
    length and its own tree, in a second exchange. Of rows that share a doc_id the smallest text is the
    predecessor's next document, and the next document of all of them is that with the next larger doc_id. Rows without a doc_id
    have an empty next document. NULL texts are empty, other columns are ignored, an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"))  # no alias of the id: both uses then share one exchange
    lengths = base.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("most"))
    lengths = stored(lengths, "doc-lengths")
    order = successors(lengths, "doc_id")
    needed = lengths.select(F.col("doc_id").alias("before"), F.floor(F.col("most") / 4).cast("int").alias("wanted"))
    order = order.join(needed, "before").select(F.col("id").alias("own_id"), "before", "wanted")
    numbered = base.where("doc_id is not null")
    sent = numbered.join(order, numbered["doc_id"] == order["own_id"])
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("text"))
    sent = sent.withColumn("first", first).where("first = 1")
    head = F.substring("text", F.lit(1), F.col("wanted"))
    sent = sent.select(F.col("before").alias("for_id"), head.alias("head"), tree(F.col("text")).alias("next_node"))
    sent = sent.withColumn("next", F.struct("next_node.root", "next_node.leaves")).drop("next_node")
    paired = numbered.join(sent, numbered["doc_id"] == sent["for_id"], "left").select("doc_id", "text", "head", "next")
    none = F.struct(tree(F.lit(""))["root"].alias("root"), F.array().cast("array<bigint>").alias("leaves"))
    alone = base.where("doc_id is null").select("doc_id", "text", F.lit("").alias("head"), none.alias("next"))
    rows = paired.unionByName(alone)
    n = F.length("text")
    edit = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - edit), F.substring(F.coalesce("head", F.lit("")), F.lit(1), edit))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("own"), tree(F.col("edited")).alias("other"), "next")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
        edited_sections(F.col("own"), F.col("other")).alias("edited_sections"),
    )
