"""Rules that run over a table of pages: links, description, consent button, subpage walk."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ACCEPT_PHRASES, DESCRIPTION_CHARS
from ..functions import urls
from ..functions.elements import elements
from ..session import shared_dir
from .joins import first_rows, salted_join

CANDIDATES, ROLES = ["button", "a", "input"], ["button"]


def link_sets(pages: DataFrame) -> DataFrame:
    """(page columns but html, links): distinct http(s) links of a page to its own host, sorted.

    Narrow: every page is handled where it lies.
    """
    anchors = F.filter(elements(F.col("html"), ["a"]), lambda e: F.map_contains_key(e["attrs"], "href"))
    hrefs = F.transform(anchors, lambda e: e["attrs"]["href"])
    keep = [c for c in pages.columns if c != "html"]
    raw = pages.select(
        *keep, F.array_distinct(hrefs).alias("hrefs"), urls.base_parts(F.col("url")).alias("base"), urls.host(F.col("url")).alias("own")
    )
    resolved = raw.select(*keep, "own", urls.resolve_links(F.col("base"), F.col("hrefs")).alias("found"))
    same = F.filter("found", lambda u: urls.host(u) == F.col("own"))
    return resolved.select(*keep, F.array_sort(F.array_distinct(same)).alias("links"))


def extract_links(pages: DataFrame) -> DataFrame:
    """One row per page and link."""
    # outer, with the test afterwards: an inner explode would evaluate the links twice
    return link_sets(pages).withColumn("link", F.explode_outer("links")).drop("links").filter("link IS NOT NULL")


def site_description(pages: DataFrame) -> DataFrame:
    """Description of seed pages: the first ``meta[name="description"]``, cut to 500 characters, '' for none.

    With a ``crawl_depth`` column only depth 0 is read.
    """
    seeds = pages.filter("crawl_depth = 0") if "crawl_depth" in pages.columns else pages
    metas = F.filter(elements(F.col("html"), ["meta"]), lambda e: e["attrs"]["name"] == "description")
    content = F.try_element_at(metas, F.lit(1))["attrs"]["content"]
    text = F.substring(F.coalesce(content, F.lit("")), 1, DESCRIPTION_CHARS)
    return seeds.select(*[c for c in seeds.columns if c != "html"], text.alias("description"))


def _clickable(e: Column) -> Column:
    """What static markup tells: shown with all around it, enabled, right input type, link that goes nowhere."""
    attrs, tag = e["attrs"], e["name"]
    disabled = F.map_contains_key(attrs, "disabled") | F.coalesce(attrs["aria-disabled"] == "true", F.lit(False))
    href = F.trim(F.coalesce(attrs["href"], F.lit("")))
    stays = (href == "") | (href == "#") | href.startswith("javascript:")
    link = stays & F.coalesce(attrs["target"] != "_blank", F.lit(True))
    typed = F.lower(F.coalesce(attrs["type"], F.lit(""))).isin("submit", "button")
    # most candidates are links that lead elsewhere: they are out after one test
    return F.when(tag == "a", link).when(tag == "input", typed).otherwise(F.lit(True)) & ~e["hidden"] & ~disabled


def clean_text(text: Column) -> Column:
    """Trimmed, lower-case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s ]+", " "))


def _element_text(e: Column) -> Column:
    def filled(value: Column) -> Column:
        return F.when(F.trim(value) != "", value)

    attrs, is_input = e["attrs"], e["name"] == "input"
    label, title = filled(attrs["aria-label"]), filled(attrs["title"])
    own = F.when(is_input, filled(attrs["value"])).otherwise(filled(clean_text(e["text"])))
    other = F.when(is_input, label).otherwise(F.coalesce(label, title))
    return clean_text(F.coalesce(own, other, F.lit("")))


def match_consent(pages: DataFrame, phrases: list[str] | None = None) -> DataFrame:
    """The element a consent click goes to: the first phrase that occurs, then the first element with it.

    A phrase matches whole words. Pages without a match drop out. Narrow: the
    phrases travel as one literal array.
    """
    wanted = ACCEPT_PHRASES if phrases is None else phrases
    listed = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(p).alias("phrase")) for i, p in enumerate(wanted)])
    keep = [c for c in pages.columns if c != "html"]
    found = pages.select(*keep, elements(F.col("html"), CANDIDATES, ROLES).alias("e"))
    texts = F.transform(
        "e",
        lambda e: F.struct(e["pos"].alias("pos"), e["name"].alias("tag"), F.when(_clickable(e), _element_text(e)).otherwise(F.lit("")).alias("text")),
    )
    named = found.select(*keep, F.filter(texts, lambda t: t["text"] != "").alias("t"))

    def best(t: Column) -> Column:
        padded = F.concat(F.lit(" "), t["text"], F.lit(" "))
        hit = F.try_element_at(
            F.filter(listed, lambda p: F.contains(padded, F.concat(F.lit(" "), p["phrase"], F.lit(" ")))), F.lit(1)
        )
        return F.when(
            hit.isNotNull(), F.struct(hit["rank"].alias("rank"), t["pos"], t["tag"], t["text"], hit["phrase"].alias("phrase"))
        )

    chosen = F.array_min(F.filter(F.transform("t", best), lambda m: m.isNotNull()))
    found = named.select(*keep, F.explode_outer(F.array(chosen)).alias("m"))
    return found.filter("m IS NOT NULL").select(*keep, "m.tag", "m.text", "m.phrase", F.col("m.rank").alias("phrase_rank"))


@F.pandas_udf(T.IntegerType())
def _pick(seed: pd.Series, depth: pd.Series, size: pd.Series) -> pd.Series:
    def one(s: str, d: int, n: int) -> int:
        if n < 1:
            return 0
        digest = hashlib.sha256(f"{s}:{d}".encode()).digest()
        return 1 + random.Random(digest).choice(range(n))

    return pd.Series([one(s, d, n) for s, d, n in zip(seed, depth, size)], dtype="int32")


def choose_link(links: Column, seed: Column, depth: Column) -> Column:
    """The link followed next: SHA-256 of ``seed:depth`` picks from the sorted distinct links; NULL for none.

    Only the number of links goes to Python.
    """
    ordered = F.array_sort(F.array_distinct(F.coalesce(links, F.array().cast("array<string>"))))
    at = _pick(seed, depth.cast("int"), F.size(ordered))
    return F.when(F.size(ordered) > 0, F.try_element_at(ordered, at))


def walk(tasks: DataFrame, page_links: DataFrame, max_depth: int) -> DataFrame:
    """Visits of every task: (experiment_id, seed, depth, url, ok).

    ``tasks`` has experiment_id and url, ``page_links`` has url and links. A task may bring its own ``max_depth``,
    and ``navigate_subpages`` false keeps it on its first page; no walk goes deeper than the argument. A page
    absent from ``page_links`` fails to load: at depth 0 the task fails, below it
    the walk ends. No page is visited twice. Each level is one join; its result is
    checkpointed in the shared folder, which keeps the plan short and survives the
    loss of executors.
    """
    shared_dir(tasks.sparkSession)
    known = first_rows(page_links.select("url", "links"), ["url"], []).withColumn("found", F.lit(True)).checkpoint()
    own = F.coalesce(F.col("max_depth"), F.lit(max_depth)) if "max_depth" in tasks.columns else F.lit(max_depth)
    stays = ~F.coalesce("navigate_subpages", F.lit(True)) if "navigate_subpages" in tasks.columns else F.lit(False)
    deepest = F.when(stays, F.lit(0)).otherwise(own).cast("int").alias("deepest")
    front = tasks.select("experiment_id", F.col("url").alias("seed"), "url", F.array("url").alias("visited"), deepest).distinct()
    levels = []
    for depth in range(max_depth + 1):
        here = salted_join(front, known, ["url"], "left", spread=["experiment_id", "seed"])
        following = choose_link(F.col("links"), F.col("seed"), F.lit(depth)) if depth < max_depth else F.lit(None).cast("string")
        step = here.select(
            "experiment_id", "seed", "url", "visited", "deepest", F.coalesce("found", F.lit(False)).alias("ok"), following.alias("following")
        ).checkpoint()
        levels.append(step.select("experiment_id", "seed", F.lit(depth).alias("depth"), "url", "ok"))
        goes_on = F.col("ok") & (F.col("deepest") > depth) & F.col("following").isNotNull()
        front = step.filter(goes_on & ~F.array_contains("visited", F.col("following"))).select(
            "experiment_id", "seed", F.col("following").alias("url"), F.concat("visited", F.array("following")).alias("visited"), "deepest"
        )
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out
