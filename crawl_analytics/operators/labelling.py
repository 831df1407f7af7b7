"""Labelling requests with the filter lists that block them, as joins on index keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hosts, jsontext, urls
from ..session import new_run_dir
from ..sources.lake import materialize
from .automaton import literals_in
from .joins import LOOKUP_CHARS, LOOKUP_ROWS, salted_join
from .rules import request_type

TRIPLE = ["url", "frame_url", "resource_type"]
TEXT_CHARS = 500_000  # characters of literals that one automaton holds
ANY_RULES = 64  # rules without any key that a URL meets under one block number


def _prefixed(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix), v))


def _source() -> Column:
    """The page a request comes from; without one the request is its own source."""
    return urls.host(F.when(F.coalesce("frame_url", F.lit("")) == "", F.col("url")).otherwise(F.col("frame_url")))


def _url_keys(kinds: set[str], any_blocks: int) -> Column:
    """The index keys a URL has besides pieces of text, limited to the kinds that occur in the rules."""
    found = []
    if "host" in kinds:
        found.append(urls.host_suffixes(urls.host(F.col("url"))))
    if "word" in kinds:
        found.append(F.regexp_extract_all("low", F.lit("[a-z0-9%]{2,}"), F.lit(0)))
    if "source" in kinds:
        found.append(_prefixed("s:", urls.host_suffixes(_source())))
    if "type" in kinds:
        found.append(F.array(F.concat(F.lit("t:"), request_type(F.col("resource_type")))))
    if "any" in kinds:
        found.append(F.array(*[F.lit(f"u:{i}") for i in range(any_blocks)]))
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")


def _keyed(known: DataFrame, rules: DataFrame, kinds: set[str], any_blocks: int, text_chars: int) -> DataFrame:
    """``known`` with a row per index key. Pieces of text are searched by automata, one pass over the URLs for each.

    A part of the literals, dealt by a hash of their first characters, makes one automaton, so what the driver and a worker
    hold is bounded by ``TEXT_CHARS``, not by the lists.
    """
    parts = -(-text_chars // TEXT_CHARS) if "text" in kinds else 0
    literals = rules.filter("key_kind = 'text'").select(F.substr(F.col("keys")[0], F.lit(3)).alias("literal")).distinct()
    part = F.pmod(F.xxhash64(F.substring("literal", 1, 2)), F.lit(max(1, parts)))
    own = _url_keys(kinds, any_blocks)
    if parts == 1:  # the usual case: all keys in one pass
        own = F.array_distinct(F.concat(own, literals_in(F.col("low"), [r["literal"] for r in literals.collect()], "g:")))
    # explode_outer: an inner explode would evaluate the keys twice, once for a test of its own
    keyed = known.withColumn("key", F.explode_outer(own))
    for i in range(parts if parts > 1 else 0):
        mine = [r["literal"] for r in literals.where(part == i).collect()]
        keyed = keyed.unionByName(known.withColumn("key", F.explode_outer(literals_in(F.col("low"), mine, "g:"))))
    return keyed


def _rule_matches() -> Column:
    """Options and pattern of a rule against a request that shares an index key with it."""
    kind = request_type(F.col("resource_type"))
    named = F.array_contains("types_in", kind)
    free = (kind != "document") & F.coalesce(~F.array_contains("types_out", kind), F.lit(True))
    party = F.when(F.col("third_party").isNull(), F.lit(True)).otherwise(F.col("third_party") == F.col("third"))
    from_sites = urls.host_suffixes(_source())
    inside = F.when(F.col("domains_in").isNull(), F.lit(True)).otherwise(F.arrays_overlap("domains_in", from_sites))
    outside = F.when(F.col("domains_out").isNull(), F.lit(True)).otherwise(~F.arrays_overlap("domains_out", from_sites))
    text = F.when(F.col("match_case"), F.col("url")).otherwise(F.col("low"))
    plain = F.col("plain")
    fixed = (
        F.when(F.col("at_start") & F.col("at_end"), text == plain)
        .when(F.col("at_start"), F.startswith(text, plain))
        .when(F.col("at_end"), F.endswith(text, plain))
        .otherwise(F.contains(text, plain))
    )
    pattern = (
        F.when(plain.isNotNull(), fixed).when(F.col("regex").isNull(), F.lit(True)).otherwise(F.rlike(text, F.col("regex")))
    )
    return F.when(F.col("types_in").isNull(), free).otherwise(named) & pattern & party & inside & outside


def blocking_lists(requests: DataFrame, rules: DataFrame, suffixes: Iterable[str] = hosts.SUFFIXES) -> DataFrame:
    """(url, frame_url, resource_type, lists) of every request that some list blocks.

    A list blocks when one of its rules matches and none of its exceptions does;
    an important rule beats exceptions. A request is a third party's if its host and its source's have different registrable
    domains by ``suffixes``; they are taken once per triple, and only where a rule asks.
    """
    own_chars = F.length("raw") + F.length(F.coalesce("regex", F.lit(""))) + F.length(F.array_join(F.coalesce("domains_in", F.array().cast("array<string>")), ","))
    sizes = rules.groupBy("key_kind").agg(
        F.sum(F.size("keys")).alias("n"), F.sum(own_chars).alias("chars"), F.sum(F.length(F.col("keys")[0])).alias("key_chars"),
        F.count("third_party").alias("parties"),
    )
    measured = {r["key_kind"]: r for r in sizes.collect()}  # one row per kind of key, six at most
    small = sum(r["n"] for r in measured.values()) <= LOOKUP_ROWS and sum(r["chars"] for r in measured.values()) <= LOOKUP_CHARS
    any_blocks = -(-measured["any"]["n"] // ANY_RULES) if "any" in measured else 0
    known = requests.filter(F.col("url").isNotNull() & (F.col("url") != "")).select(*TRIPLE).distinct()
    # narrow and read several times: stored once
    third = F.lit(None).cast("boolean")
    if any(r["parties"] for r in measured.values()):
        third = hosts.registrable_domain(urls.host(F.col("url")), suffixes) != hosts.registrable_domain(_source(), suffixes)
    known = materialize(known.withColumns({"low": F.lower("url"), "third": third}), new_run_dir(requests.sparkSession, "request-triples"))
    keyed = _keyed(known, rules, set(measured), any_blocks, measured["text"]["key_chars"] if "text" in measured else 0)
    # keys and rules are two tables, so that a rule with many keys stands once; rules for any URL are dealt to numbered blocks
    block = F.concat(F.lit("u:"), F.pmod("rule_id", F.lit(max(1, any_blocks))).cast("string"))
    keys = F.when(F.col("key_kind") == "any", F.array(block)).otherwise(F.col("keys"))
    index = rules.select("rule_id", F.explode(keys).alias("key"))
    bodies = rules.drop("keys", "key_kind")
    if small:
        pairs = keyed.join(F.broadcast(index), "key").join(F.broadcast(bodies), "rule_id")
    else:
        pairs = salted_join(keyed, index, ["key"], "inner", spread=TRIPLE)
        pairs = salted_join(pairs, bodies, ["rule_id"], "inner", spread=TRIPLE)
    pairs = pairs.drop("key")
    hits = pairs.filter(_rule_matches())
    per_list = hits.groupBy(*TRIPLE, "list_ord", "list_name").agg(
        F.bool_or(~F.col("is_exception")).alias("hit"),
        F.bool_or("is_exception").alias("excepted"),
        F.bool_or(F.col("is_important") & ~F.col("is_exception")).alias("important"),
    )
    blocked = per_list.filter(F.col("hit") & (~F.col("excepted") | F.col("important")))
    # one entry per list and request: bounded by the number of lists
    named = blocked.groupBy(*TRIPLE).agg(F.array_sort(F.collect_list(F.struct("list_ord", "list_name"))).alias("l"))
    return named.select(*TRIPLE, F.col("l.list_name").alias("lists"))


def label_requests(requests: DataFrame, rules: DataFrame, as_array: bool = False, suffixes: Iterable[str] = hosts.SUFFIXES) -> DataFrame:
    """Requests with ``blocked_by``: JSON text of the list names in list order, ``[]`` for none.

    The work is done once per distinct (url, frame, type) and joined back; the whole requests move, so NULL in the key is told by a mark
    beside it and no text stands twice.
    """
    filled = {c: F.coalesce(c, F.lit("\0")) for c in TRIPLE}
    found = blocking_lists(requests, rules, suffixes).select(*[filled[c].alias(c) for c in TRIPLE], "lists")
    keyed = requests.withColumns({**{f"__no_{c}": F.col(c).isNull() for c in TRIPLE}, **filled})
    joined = salted_join(keyed, found, TRIPLE, "left", spread=[c for c in keyed.columns if c not in TRIPLE])
    own = [F.when(~F.col(f"__no_{c}"), F.col(c)).alias(c) if c in TRIPLE else F.col(c) for c in requests.columns]
    out = joined.select(*own, jsontext.json_list(F.col("lists")).alias("blocked_by"), "lists")
    return out.withColumnRenamed("lists", "blocked_by_lists") if as_array else out.drop("lists")
