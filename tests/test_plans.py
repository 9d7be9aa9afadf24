import io
import contextlib

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from bindings import fixtures as X
from bindings.oracle import ORACLE
from bindings.registered import REGISTRY
from cohortlens.plans import enrichment as PE
from cohortlens.plans import general_testing as GT
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    assert difference(REGISTRY[name](spark, SF), con, ORACLE[name]) is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 5


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)
    assert REGISTRY.items() <= queries().items() and ORACLE.items() <= oracle_sql().items()
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["family_infer", "typed_values", "na_counts", "class_counts",
                                  "pathway_overlap", "enrichment_top5", "score_linear"])
def test_no_python_and_no_cross_product(spark, name):
    text = plan(queries()[name](spark, SF))
    for word in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct"):
        assert word not in text


def test_scan_is_pruned_and_filtered(spark):
    text = plan(queries()["study_scan"](spark, SF))
    assert "EqualTo(lang,en)" in text and "n_chars" not in text.split("ReadSchema")[1].split("\n")[0]
    text = plan(X.returned_parts(spark, SF))
    assert "EqualTo(l_returnflag,R)" in text and "GreaterThanOrEqual(l_quantity,45.0)" in text
    assert "l_extendedprice" not in text


def test_summaries_are_hash_aggregates(spark):
    assert "SortAggregate" not in plan(queries()["family_infer"](spark, SF))


def test_small_family_table_is_broadcast(spark):
    text = plan(queries()["typed_values"](spark, SF))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_empty_gene_list(spark):
    links, ids = X.brand_links(spark, SF), X.returned_parts(spark, SF).where("gene_id < 0")
    for correction in ("Bonferroni", "HB", "Sidak", None):
        assert PE.enrich(links, ids, correction).count() == 0


def test_enrichment_document(spark):
    ids = X.returned_parts(spark, SF)
    top = PE.enrich(X.brand_links(spark, SF), ids, universe=X.part_universe(spark, SF))
    document = PE.enrichment_document(top, ids).first()
    assert len(document["TopPathways"]) == 5
    assert document["NumberOfGenes"] == ids.distinct().count()
    with pytest.raises(ValueError):
        PE.enrich(X.brand_links(spark, SF), ids, n_tests="some")


def test_general_testing_document(spark):
    report = GT.general_testing(X.mixed_study(spark, SF))
    document = GT.general_testing_document(report).first()
    assert document["NumberOfData"]["n_features"] == 11
    assert {r["feature"] for r in document["BinomialTest"]} >= {"building", "fulfilled"}
    assert report.heatmap().where(F.col("cell") < 0).count() == 0
