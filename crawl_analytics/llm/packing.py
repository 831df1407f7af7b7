"""Packing by power-of-two decomposition: pieces of binary length, one sequence each."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.joins import is_small
from .common import small_batches, stored

LONGEST = 1024
END_ID = 0
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, part long, place long"

def vocabulary() -> tuple[str, str]:
    """The default vocabulary, a public byte-level BPE: its ``tokenizers`` file and the same as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers, the ids the ``tokenizers`` file gives.

    The same vocabulary in its rank form gives the same ids for a quarter of the work. Texts that hold one of the
    vocabulary's special tokens go to the ``tokenizers`` library. The tests compare both with that library.
    """

    def __init__(self, path: str, ranks: str):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, "rb") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(self.path)  # rare
            return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that sum to ``n``, largest first, none above ``longest``."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, files: tuple[str, str] | None = None, longest: int = LONGEST) -> DataFrame:
    """One row per piece with its ids; ``place`` numbers the pieces of a length inside a task."""
    files = files or vocabulary()
    small_batches(docs.sparkSession)

    def cut(batches: Iterator) -> Iterator:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder(*files)
        part = TaskContext.get().partitionId()
        end = np.array([END_ID], dtype="<u4").tobytes()
        seen: dict[int, int] = {}
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens")] + [("ids", pa.binary()), ("part", pa.int64()), ("place", pa.int64())])
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                start, total = 0, len(ids) // 4
                for length in binary_lengths(total, longest):
                    place = seen.get(length, 0)
                    seen[length] = place + 1
                    rows.append((doc_id, start, length, total, ids[4 * start : 4 * (start + length)], part, place))
                    start += length
                size += len(ids)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, files: tuple[str, str] | None = None, longest: int = LONGEST) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: all pieces of all documents.

    A document's ids with the end id are cut at the binary digits of their number, 1024s first. Every piece is
    a sequence of its own: no sequence holds two documents, and as its length is a power of two it needs no
    padding. sequence_id runs gapless through the lengths, longest first, so a bucket of equal lengths is a range of ids
    and a batch is a slice of it.

    The text is read and tokenized once; ids never move through a shuffle. Pieces are written as a table together with
    their place among the pieces of that length in their task; only the number of pieces per task and
    length is added up, and the sums come back by a join on (part, length): broadcast once they are counted
    to be few, a shuffle join beyond that.
    NULL texts are empty (one piece, the end id), repeated rows and NULL ids are documents of their own,
    other columns are ignored, an empty table gives an empty result.
    """
    cut = stored(pieces(docs, files, longest), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # one row per length and task; eleven lengths
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    longer = W.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.groupBy("length").agg(F.sum("n").alias("n"))
    firsts = firsts.select("length", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("first"))
    shifts = shifts.join(F.broadcast(firsts), "length")  # eleven rows
    numbered = cut.join(F.broadcast(shifts) if is_small(shifts) else shifts, ["part", "length"])
    sequence = (F.col("first") + F.col("before") + F.col("place")).cast("long")
    return numbered.select("doc_id", "start", "length", "ids", "doc_tokens", sequence.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
