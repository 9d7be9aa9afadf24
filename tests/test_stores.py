import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from bindings import fixtures as X
from cohortlens.operators.observations import feature_families
from cohortlens.plans import general_testing as GT
from cohortlens.sources import readers, results
from cohortlens.sources.study_store import read_family, write_study

SF = "/root/testdata/sf0.001"


def files(path):
    return {os.path.join(folder, name) for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")}


def folder_of(name):
    return int(name.split(f"{results.BUCKET}=")[1].split("/")[0])


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture()
def stored(spark, tmp_path):
    path = str(tmp_path / "results")
    table = spark.createDataFrame([(k, "pending", float(k)) for k in range(200)], "id bigint, status string, perf double")
    results.store_results(table, path, "id", buckets=16)
    return path


def test_update_keeps_untouched_files(spark, stored):
    before = files(stored)
    updates = spark.createDataFrame([(3, "done"), (40, "done"), (999, "done"), (None, "done")], "id bigint, status string")
    touched = results.update_stored(spark, stored, updates, "id", buckets=16)
    after = files(stored)
    assert 1 <= len(touched) <= 2
    assert {f for f in before if folder_of(f) not in touched} == {f for f in after if folder_of(f) not in touched}
    assert not {f for f in before if folder_of(f) in touched} & after
    rows = {r["id"]: (r["status"], r["perf"]) for r in results.read_results(spark, stored).collect()}
    assert rows == {k: ("done" if k in (3, 40) else "pending", float(k)) for k in range(200)}


def test_update_without_match_writes_nothing(spark, stored):
    before = files(stored)
    for rows in ([(999, "done")], []):
        updates = spark.createDataFrame(rows, "id bigint, status string")
        assert results.update_stored(spark, stored, updates, "id", buckets=16) == []
    assert files(stored) == before


def test_update_takes_the_last_of_several_and_refuses_new_fields(spark, stored):
    updates = spark.createDataFrame([(7, "early", 1), (7, "late", 2)], "id int, status string, at int")
    results.update_stored(spark, stored, updates, "id", buckets=16, order="at")
    assert results.read_results(spark, stored).where("id = 7").first()["status"] == "late"
    with pytest.raises(ValueError):
        results.update_stored(spark, stored, updates, "id", buckets=16)


def test_a_failed_update_leaves_the_results(spark, stored):
    before = {f: os.path.getmtime(f) for f in files(stored)}
    broken = spark.createDataFrame([(3, "x")], "id bigint, status string").withColumn(
        "status", F.when(F.col("id") == 3, F.raise_error(F.lit("no result"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="no result"):
        results.update_stored(spark, stored, broken, "id", buckets=16)
    assert {f: os.path.getmtime(f) for f in files(stored)} == before


def test_study_is_read_by_family(spark, tmp_path):
    path = str(tmp_path / "study")
    obs = X.mixed_study(spark, SF)
    families = feature_families(obs)
    write_study(obs, families, path)
    write_study(obs.limit(50), families, path, data_type="other")
    text = plan(read_family(spark, path, "Numerical"))
    scan = text.split("PartitionFilters")[1].split("\n")[0]
    assert "(family#" in scan and "Numerical" in scan and "study" in scan
    kinds = {r["feature"]: r["family"] for r in families.collect()}
    for name in ("Numerical", "Categorical", "Binary"):
        got = {r["feature"] for r in read_family(spark, path, name).select("feature").distinct().collect()}
        assert got == {f for f, kind in kinds.items() if kind == name and f in got} and got
    assert read_family(spark, path, "Other", "none").count() == 0
    assert read_family(spark, path, "Numerical").where("feature = 'totalprice' AND value IS NULL").count() == 0


def test_report_does_not_go_back_to_the_raw_study(spark, tmp_path):
    raw = str(tmp_path / "raw")
    X.mixed_study(spark, SF).write.parquet(raw)
    report = GT.general_testing(spark.read.parquet(raw))
    for section in (report.correlations, report.chi_square, report.binomial, report.anova):
        assert raw not in plan(section)


def test_document_is_bounded(spark):
    report = GT.general_testing(X.mixed_study(spark, SF))
    document = GT.general_testing_document(report, most=1).first()
    assert len(document["NumberOfNAs"]) == 1 and document["NumberOfNAsRows"] == report.missing.count() > 1
    most = report.missing.orderBy(F.desc("n_na"), "feature").first()
    assert document["NumberOfNAs"][0]["feature"] == most["feature"]


def test_first_header_line_in_any_order(spark):
    lines = spark.createDataFrame([(2, "x y"), (1, "b a c"), (3, "a")], "number int, line string").repartition(3)
    got = [r["feature"] for r in readers.feature_names(lines, number="number").orderBy("pos").collect()]
    assert got == ["b", "a", "c"]
    assert [r["feature"] for r in readers.feature_names(lines).collect()] == ["a"]


def test_study_is_written_without_sorting_it_by_family(spark, tmp_path, monkeypatch):
    """A task keeps a file open for each family; the setting is put back, also after an error."""
    from pyspark.sql import DataFrameWriter

    name, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    before = spark.conf.get(name)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.append(int(spark.conf.get(name))), write(self, *a, **b)))
    obs = spark.createDataFrame([(f, k, v) for k in range(40) for f, v in (("x", str(k)), ("y", "ab"[k % 2]), ("z", "yes"))],
                                "feature string, sample_id long, raw string")
    write_study(obs, feature_families(obs), str(tmp_path / "a"))
    assert seen[0] >= 4 and spark.conf.get(name) == before
    assert read_family(spark, str(tmp_path / "a"), "Numerical").count() == 40
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **b: 1 // 0)
    with pytest.raises(ZeroDivisionError):
        write_study(obs, feature_families(obs), str(tmp_path / "b"))
    assert spark.conf.get(name) == before
