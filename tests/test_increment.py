import os

import pytest
from pyspark.sql import functions as F

from crawl_analytics.fixtures import FILTER_LISTS, Fixture
from crawl_analytics.plans import enrichment
from crawl_analytics.plans.increment import changed_experiments, enrich_increment, input_files, read_manifest
from crawl_analytics.queries import _contents, _write_documents
from crawl_analytics.sources import lake, lists

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_deliveries_equal_one_run(spark, tmp_path):
    fx = Fixture(spark, SF)
    root, out, whole = (str(tmp_path / n) for n in ("lake", "out", "whole"))
    paths = []
    for name, lines in FILTER_LISTS.items():
        paths.append(str(tmp_path / f"{name}.txt"))
        (tmp_path / f"{name}.txt").write_text("\n".join(lines))
    chosen = ",".join(paths)

    def deliver(condition):
        for kind, name in {"requests": "raw_requests", "responses": "raw_responses", "site_metadata": "raw_site_metadata"}.items():
            lake.write_events(fx[name].drop("k").where(condition), root, kind)

    lake.write_workers(fx["raw_worker_metadata"], root)
    _write_documents(fx, root)
    late = F.col("experiment_id").startswith("chromiumno") & F.col("crawl_session_id").endswith("_1")
    deliver(~late)
    assert enrich_increment(spark, root, out, chosen) == ["chromiumnocookies_e0", "chromiumwithcookies_e2", "firefoxwithcookies_e1"]
    assert enrich_increment(spark, root, out, chosen) == []  # nothing new
    before = files(out)
    deliver(late)
    assert enrich_increment(spark, root, out, chosen) == ["chromiumnocookies_e0"]
    kept = {f for f in before if "chromiumnocookies_e0" not in f}
    assert kept <= files(out)  # the others' files are the same ones
    enrichment.enrich(spark, root, whole, chosen)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(_contents(fx, out), _contents(fx, whole))
    lake.write_workers(fx["raw_worker_metadata"].withColumn("timestamp", F.lit(9e9)).withColumn("country_code", F.lit("ZZ")), root)
    assert enrich_increment(spark, root, out, chosen) == []  # workers only: their table is new, no experiment is read
    enrichment.enrich(spark, root, whole, chosen)
    assert same(_contents(fx, out), _contents(fx, whole))
    (tmp_path / "easylist.txt").write_text("||example^\n")
    assert len(enrich_increment(spark, root, out, chosen)) == 3  # other rules concern everything


def test_a_run_that_breaks_is_done_again(spark, tmp_path, monkeypatch):
    fx = Fixture(spark, SF)
    root, out = str(tmp_path / "lake"), str(tmp_path / "out")
    (tmp_path / "l.txt").write_text("||a^\n")
    lake.write_workers(fx["raw_worker_metadata"], root)
    _write_documents(fx, root)
    lake.write_events(fx["raw_requests"].drop("k"), root, "requests")
    with monkeypatch.context() as m:
        m.setattr(enrichment, "write_enriched", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            enrich_increment(spark, root, out, str(tmp_path / "l.txt"))
    assert read_manifest(spark, out).count() == 0
    assert len(enrich_increment(spark, root, out, str(tmp_path / "l.txt"))) == 3
    assert enrich_increment(spark, root, out, str(tmp_path / "l.txt")) == []


def test_changes_of_a_listing(spark, tmp_path):
    entry = "path string, length bigint, modified timestamp"
    before = spark.createDataFrame([("/x/experiment=a/f", 1, None), ("/x/experiment=b/f", 1, None), ("/x/experiment=c/f", 1, None), ("rules", 5, None)], entry)
    now = spark.createDataFrame([("/x/experiment=a/f", 1, None), ("/x/experiment=b/f", 2, None), ("/x/experiment=d/f", 1, None), ("rules", 5, None)], entry)
    assert changed_experiments(now, before) == ["b", "c", "d"] and changed_experiments(now, now) == []
    assert changed_experiments(now.where("path <> 'rules'").unionByName(spark.createDataFrame([("rules", 6, None)], entry)), before) is None
    assert input_files(spark, str(tmp_path)).count() == 0


def test_lists_that_cannot_be_read_at_all_are_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no filter list"), pytest.warns(UserWarning):
        lists.read_filter_lists(spark, [str(tmp_path / "a.txt"), "https://lists.invalid/b.txt"])


def test_one_shape_names_no_files(spark, tmp_path, monkeypatch):
    from crawl_analytics.sources.footers import groups_by_schema

    root = str(tmp_path)
    frame = spark.range(10).select("id", F.col("id").cast("string").alias("t"))
    frame.repartition(3).write.parquet(f"{root}/experiment=a/data_type=requests")
    read = lambda: groups_by_schema(spark, [f"{root}/experiment=*/data_type=requests"], lake.frames_of)
    assert read() == [({"id": "bigint", "t": "string"}, [])]
    frame.select("id").write.parquet(f"{root}/experiment=b/data_type=requests")
    frame.select("t").coalesce(1).write.mode("append").parquet(f"{root}/experiment=a/data_type=requests")
    found = {tuple(kinds): paths for kinds, paths in read()}
    assert [p.rsplit("/", 2)[-2:] for p in found[("id",)]] == [["experiment=b", "data_type=requests"]]
    assert len(found[("id", "t")]) == 3 and len(found[("t",)]) == 1
