"""The enrichment job: raw lake in, five tables per experiment out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import (
    dedup_consents,
    dedup_requests,
    dedup_responses,
    dedup_site_metadata,
    dedup_workers,
    kept_sessions,
)
from ..operators.joins import is_small, salted_join
from ..operators.labelling import label_requests
from ..operators.rules import parse_rules
from ..session import new_run_dir
from ..sources.lake import copy_metadata, experiments_with_rows, materialize, read_metadata, read_raw, read_workers, write_enriched
from ..sources.lists import chosen_lists, read_filter_lists


KINDS = ("requests", "responses", "cookie_warning_consents", "site_metadata")


def enriched_tables(
    requests: DataFrame,
    responses: DataFrame,
    consents: DataFrame,
    site_metadata: DataFrame,
    workers: DataFrame,
    rules: DataFrame,
    kept: DataFrame | None = None,
    single: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The five enriched tables of raw tables.

    ``kept`` and ``single`` may be stored results of ``kept_sessions`` and ``dedup_requests``.
    """
    kept = kept_sessions(requests) if kept is None else kept
    single = dedup_requests(requests, kept) if single is None else single
    return {
        "labeled_requests": label_requests(single, rules),
        "responses": dedup_responses(responses, kept),
        "cookie_warning_consents": dedup_consents(consents, kept),
        "site_metadata": dedup_site_metadata(site_metadata, kept),
        "worker_metadata": dedup_workers(workers),
    }


def enrich(
    spark: SparkSession,
    root: str,
    out: str,
    filter_lists: str | None = None,
    experiments: list[str] | None = None,
    committed: bool = False,
    rules: DataFrame | None = None,
) -> None:
    """Process all experiments in one go: the experiment is a key, not a loop.

    With ``experiments`` only these are read, and their partitions of the result are replaced; the others stay.
    Running the job again gives the same tables and documents. Experiments without a readable document
    or without raw files are left out. Kept sessions (for four tables), rules and single requests
    (for the labels, read three times) are stored once, in the shared folder. ``committed`` reads a lake of committed batches;
    ``rules`` may be a stored rule table of the lists.
    """
    documents = read_metadata(spark, root)
    if experiments is not None:
        documents = documents.filter(F.col("exp_id").isin(experiments))
    ids = documents.select(F.col("exp_id").alias("experiment_id")).distinct()
    small = is_small(ids)

    def known(rows: DataFrame) -> DataFrame:
        if small:
            return rows.join(F.broadcast(ids), "experiment_id", "left_semi")
        return salted_join(rows, ids, ["experiment_id"], "left_semi")

    raw = [known(read_raw(spark, root, kind, experiments, committed)) for kind in KINDS]
    present = experiments_with_rows(spark, root, list(KINDS), experiments, committed)
    workers = read_workers(spark, root, present.join(ids.withColumnRenamed("experiment_id", "id"), "id", "left_semi"))
    if rules is None:
        rules = materialize(parse_rules(read_filter_lists(spark, chosen_lists(filter_lists))), new_run_dir(spark, "rules"))
    kept = materialize(kept_sessions(raw[0]), new_run_dir(spark, "kept-sessions"))
    single = materialize(dedup_requests(raw[0], kept), new_run_dir(spark, "single-requests"))
    write_enriched(enriched_tables(*raw, workers, rules, kept, single), out, keep_others=experiments is not None)
    copy_metadata(spark, root, out, experiments)
