"""License scans by diagonal voting: word grams meet template positions, offsets vote, spans are verified. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.joins import is_small, repeat_rows

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 3  # words of a vote; a template of two words votes with both
NEAR = 4  # diagonals this far from the strongest belong to it: so many words more or fewer than the template
SHORT = 20  # a template of fewer words must be there whole
SIMILAR = 0.8  # of a longer one: covered words by the words of template or span, whichever is longer
LEAD = 3  # empty words before the text: their gram stands for the document itself
DOCUMENT = -1  # the template number of that gram

# Phrases that each count as a place of their label.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Public license statements and notices, as their owners word them.
NOTICES = [
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("licensed under the GNU General Public License, version 2", "gpl-2.0"),
    ("licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("licensed under the GNU Lesser General Public License", "lgpl"),
    ("Licensed under CC BY 4.0", "cc-by-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("Released under the MIT License", "mit-release"),
    ("All rights reserved", "all-rights-reserved"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.",
        "mit-text",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "isc-text",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd-text",
    ),
    (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied.",
        "apache-2.0-text",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "gpl-3.0-text",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "mpl-2.0-text",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
        "unlicense-text",
    ),
]


def words(text: Column) -> Column:
    """The text's words, A-Z in lower case: letters, digits and everything beyond ASCII."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _grams(words: Column) -> Column:
    """Every word with the two after it, NULL beyond the end."""
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"), F.slice(words, F.lit(3), F.size(words)).alias("c"))


def _hash(gram: str) -> Column:
    return F.xxhash64(f"{gram}.a", f"{gram}.b")


def templates(spark: SparkSession, phrases: list = PHRASES, notices: list = NOTICES) -> DataFrame:
    """(template, label, exact, m, k, least): numbered templates, their words, votes' width and least similarity."""
    rows = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate([*phrases, *notices])]
    known = spark.createDataFrame(rows, "template int, text string, label string, exact boolean").withColumn("words", words(F.col("text")))
    m = F.size("words")
    least = F.when(F.col("exact") | (m < SHORT), F.lit(1.0)).otherwise(F.lit(SIMILAR))
    return known.where(m >= 2).select("template", "label", "exact", "words", m.alias("m"), F.least(m, F.lit(GRAM)).alias("k"), least.alias("least"))


def _positions(known: DataFrame) -> DataFrame:
    """(h, a, b, c, template, p): every gram of every template with its place; c is NULL where two words vote."""
    every = known.select("template", "m", "k", F.posexplode(_grams(F.col("words"))).alias("p", "g")).where("p + k <= m")
    third = F.when(F.col("k") >= GRAM, F.col("g.c"))
    own = every.select(_hash("g").alias("h"), F.col("g.a").alias("a"), F.col("g.b").alias("b"), third.alias("c"), "template", "p")
    document = known.sparkSession.range(1).select(
        F.xxhash64(F.lit(""), F.lit("")).alias("h"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.lit(DOCUMENT).alias("template"), F.lit(0).alias("p")
    )
    return own.union(document)


def hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, copy_a, copy_b, n_words, template, d, ps, rows): the votes of each diagonal d = word - p of a document and template.

    Two hashes of the text tell rows of one doc_id apart. Rolling two-word hashes meet the templates' positions in one join, the
    words themselves decide. ``ps`` are the template positions that voted; repeated rows vote for the same, ``rows`` counts them.
    """
    positions = _positions(known)
    positions = F.broadcast(positions) if is_small(positions) else positions
    led = F.concat(F.array(*[F.lit("")] * LEAD), words(F.col("text")))
    texts = docs.select("doc_id", F.xxhash64("text").alias("copy_a"), F.xxhash64(F.lit(1), "text").alias("copy_b"), led.alias("words"))
    each = texts.select("doc_id", "copy_a", "copy_b", (F.size("words") - LEAD).alias("n_words"), F.posexplode(_grams(F.col("words"))).alias("at", "g"))
    each = each.withColumn("gram", _hash("g"))
    same = (F.col("gram") == F.col("h")) & (F.col("g.a") == F.col("a")) & (F.col("g.b") == F.col("b"))
    met = each.join(positions, same & (F.col("c").isNull() | (F.col("g.c") == F.col("c"))))
    # the document's own gram also stands before its first word: only the first place counts
    met = met.where((F.col("template") != DOCUMENT) | (F.col("at") == 0))
    d = (F.col("at") - LEAD - F.col("p")).cast("long")
    return met.groupBy("doc_id", "copy_a", "copy_b", "n_words", "template", d.alias("d")).agg(F.collect_set("p").alias("ps"), F.count(F.lit(1)).alias("rows"))


def spans(votes: DataFrame, known: DataFrame) -> DataFrame:
    """The votes with what they amount to: label, exact, place (a whole phrase), first, last (words of the span), similarity, found.

    A diagonal that has the most votes of those ``NEAR`` it, the first of equals, takes its neighbours' votes in: words put in or left
    out shift the rest of a notice to the next diagonal. The span is verified by the share of words that the votes cover.
    """
    kinds = F.broadcast(known.select("template", "label", "exact", "m", "k", "least"))
    rows = votes.join(kinds, "template", "left")
    # a window per document and template: the neighbours of a diagonal are at most 2 * NEAR
    beside = W.partitionBy("doc_id", "copy_a", "copy_b", "template").orderBy("d").rangeBetween(-NEAR, NEAR)
    strength = F.struct(F.size("ps").alias("votes"), (-F.col("d")).alias("earlier"))
    rows = rows.withColumn("peak", F.max(strength).over(beside) == strength)
    rows = rows.withColumn("merged", F.collect_list(F.struct("d", "ps")).over(beside))
    covered = F.flatten(F.transform("merged", lambda e: F.flatten(F.transform(e["ps"], lambda p: F.sequence(p, p + F.col("k") - 1)))))
    first = F.array_min(F.transform("merged", lambda e: e["d"] + F.array_min(e["ps"])))
    last = F.array_max(F.transform("merged", lambda e: e["d"] + F.array_max(e["ps"]))) + F.col("k") - 1
    rows = rows.withColumns({"first": first, "last": last})
    similar = F.size(F.array_distinct(covered)) / F.greatest(F.col("m").cast("long"), F.col("last") - F.col("first") + 1)
    whole = F.size("ps") == F.col("m") - F.col("k") + 1
    rows = rows.withColumn("place", F.coalesce(F.col("exact") & whole, F.lit(False)))
    rows = rows.withColumn("similarity", F.when(F.col("exact"), F.when(whole, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(similar))
    found = F.when(F.col("exact"), F.col("place")).otherwise(F.col("peak") & (F.col("similarity") >= F.col("least")))
    return rows.withColumn("found", F.coalesce(found, F.lit(False))).drop("merged", "ps")


def scanned(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of ``docs``.

    n_base counts the places of the phrases, first_word and last_word are the smallest and largest of them, NULL without any. Labels
    are distinct, sorted and comma-joined, empty without any; score is the similarity of the best verified span, 0 without
    one. NULL texts are empty, repeated rows come back as often, other columns are ignored, an empty table gives an empty result. Texts are
    read once and stay where they are: a document sends one narrow row and one for each diagonal that got votes.
    """
    known = templates(docs.sparkSession) if known is None else known
    rows = spans(hits(docs, known), known)
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    out = rows.groupBy("doc_id", "copy_a", "copy_b", "n_words").agg(
        F.max(F.when(F.col("template") == DOCUMENT, F.col("rows"))).alias("copies"),
        F.count_if("place").alias("n_base"),
        F.min(F.when(F.col("place"), F.col("d"))).alias("first_word"),
        F.max(F.when(F.col("place"), F.col("d"))).alias("last_word"),
        labels(F.col("place")).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("found"), F.col("similarity"))), F.lit(0.0)).alias("score"),
    )
    out = out.withColumn("n_words", F.col("n_words").cast("long")).drop("copy_a", "copy_b")
    return repeat_rows(out, "copies")
