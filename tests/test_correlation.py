import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import correlation as C
from cohortlens.operators import spearman as S
from cohortlens.operators.ranking import average_ranks, with_pieces


def ranks(x):
    order = np.sort(x)
    return (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2


@pytest.fixture(scope="module")
def study():
    rng = np.random.default_rng(11)
    base = rng.normal(0, 1, 240)
    data = {
        "a": base * 3 + 1000, "b": base + rng.normal(0, 1, 240), "c": rng.integers(0, 5, 240) * 1.0,
        "d": -base + rng.normal(0, 0.3, 240), "e": rng.exponential(1, 240), "const": np.full(240, 0.1),
    }
    data["b"][rng.random(240) < 0.2] = np.nan
    data["c"][rng.random(240) < 0.1] = np.nan
    few = np.full(240, np.nan)
    few[:2] = [1.0, 2.0]
    data["few"] = few
    # varies, but not where `few2` is present
    late = np.full(240, 0.3)
    late[200:] = rng.normal(0, 1, 40)
    data["late"] = late
    few2 = np.full(240, np.nan)
    few2[:50] = rng.normal(0, 1, 50)
    data["few2"] = few2
    apart = np.full(240, np.nan)  # no sample in common with `few2`
    apart[100:] = rng.normal(0, 1, 140)
    data["apart"] = apart
    return data


def expected(study, kind):
    out = {}
    for f, x in study.items():
        for g, y in study.items():
            both = ~np.isnan(x) & ~np.isnan(y)
            u, v = x[both], y[both]
            if len(u) <= 2 or len(set(u)) < 2 or len(set(v)) < 2:
                out[f, g] = (len(u), 0.0, True)
                continue
            if kind == "spearman":
                u, v = ranks(u), ranks(v)
            out[f, g] = (len(u), np.corrcoef(u, v)[0, 1], False)
    return out


@pytest.mark.parametrize("block,chunk,task_rows", [(256, 8192, 4_000_000), (3, 40, 60), (4, 100, 25)])
@pytest.mark.parametrize("kind", ["pearson", "spearman"])
def test_matrix(spark, study, kind, block, chunk, task_rows):
    rows = [(f, i, float(v)) for f, x in study.items() for i, v in enumerate(x) if not np.isnan(v)]
    values = spark.createDataFrame(rows, "feature string, sample_id bigint, value double").repartition(5)
    if kind == "pearson":
        got = C.pearson_matrix(values, block, chunk)
    else:
        got = C.spearman_matrix(values, block, chunk, task_rows)
    got = {(r["feature_x"], r["feature_y"]): r for r in got.collect()}
    want = expected(study, kind)
    assert set(got) == set(want)
    for key, (n, r, degenerate) in want.items():
        assert got[key]["n"] == n and got[key]["degenerate"] == degenerate, key
        assert got[key]["r"] == pytest.approx(r, abs=1e-10), key
        assert 0.0 <= got[key]["p"] <= 1.0
        assert got[key]["p"] == got[key[::-1]]["p"]
        if degenerate:
            assert got[key]["p"] == 0.0
    # t = r sqrt(n-2) / sqrt(1-r^2), n = 240: compare with the normal tail loosely
    assert got["a", "e"]["p"] == pytest.approx(
        2 * (1 - __import__("statistics").NormalDist().cdf(
            abs(got["a", "e"]["r"]) * 238 ** 0.5 / (1 - got["a", "e"]["r"] ** 2) ** 0.5)), abs=5e-3)


def test_heatmap(spark):
    m = spark.createDataFrame([("a", "a", 1.0), ("a", "b", -0.5), ("b", "a", -0.5), ("b", "b", 1.0)],
                              "feature_x string, feature_y string, r double")
    got = {(r["row"], r["col"]): r["cell"] for r in C.heatmap_cells(m).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 1.0}


def test_spearman_ranks_once_per_mask(spark):
    """30 sets of missing samples over 50 features with ties: equal to ranking every pair on its own,
    in one piece and in many, and nothing in the plan has a row per sample and pair."""
    rng = np.random.default_rng(4)
    samples, masks = 300, rng.random((30, 300)) < 0.85
    data = rng.normal(0, 1, (50, samples)).round(1)
    data[::7] = np.where(data[::7] < 0.3, 0.0, data[::7])  # a value of more than half of the rows
    mask_of = np.append(np.arange(30), rng.integers(0, 30, 20))
    data = np.where(masks[mask_of], data, np.nan)
    rows = [(f"f{i:02d}", s, float(v)) for i, x in enumerate(data) for s, v in enumerate(x) if not np.isnan(v)]
    values = spark.createDataFrame(rows, "feature string, sample_id bigint, value double").repartition(6)
    numbered = S.number_features(values)
    assert numbered.select("mask").distinct().count() == 30
    for block, chunk, piece_rows in ((64, 2048, 250_000), (8, 70, 40)):
        matrix = C.spearman_matrix(values, block, chunk, piece_rows)
        got = {(r["feature_x"], r["feature_y"]): r for r in matrix.collect()}
        assert len(got) == 2500
        for i in range(50):
            for j in range(i, 50):
                both = ~np.isnan(data[i]) & ~np.isnan(data[j])
                r = got[f"f{i:02d}", f"f{j:02d}"]
                assert r["n"] == both.sum()
                assert r["r"] == pytest.approx(np.corrcoef(ranks(data[i][both]), ranks(data[j][both]))[0, 1], abs=1e-10)
    arrays = S.rank_moments(values, numbered)
    plan = arrays._jdf.queryExecution().analyzed().toString()
    assert "feature_x" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("kind", ["pearson", "spearman"])
def test_repeated_cells_count_once_in_any_order(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(f, s, float(v)) for f in "xy" for s, v in enumerate(rng.normal(0, 1, 40))]
    repeats = [("x", s, float(v)) for s, v in zip(range(0, 40, 3), rng.normal(0, 3, 14))]
    best = {}
    for f, s, v in rows + repeats:
        best[f, s] = max(v, best.get((f, s), v))
    x, y = (np.array([best[f, s] for s in range(40)]) for f in "xy")
    want = np.corrcoef(x, y)[0, 1] if kind == "pearson" else np.corrcoef(ranks(x), ranks(y))[0, 1]
    matrix = C.pearson_matrix if kind == "pearson" else C.spearman_matrix
    for table in (rows + repeats, repeats + rows):
        values = spark.createDataFrame(table, "feature string, sample_id bigint, value double").coalesce(1)
        got = {(r["feature_x"], r["feature_y"]): r for r in matrix(values).collect()}
        assert got["x", "y"]["n"] == 40 and got["x", "y"]["r"] == pytest.approx(want, abs=1e-10)


def test_average_ranks_of_a_value_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(6)
    x = np.where(rng.random(3000) < 0.34, 0.0, rng.normal(0, 1, 3000).round(2))
    rows = spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(x)], "feature string, sample_id bigint, value double")
    totals = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    placed, pieces = with_pieces(rows, ["feature"], "value", totals, 200)
    largest = placed.where("not full").groupBy("piece").count().agg(F.max("count")).first()[0]
    assert pieces == 15 and largest <= 400 and placed.where("full").count() == (x == 0).sum()
    got = {r["sample_id"]: r["r"] for r in average_ranks(rows, ["feature"], "value", totals, "r", 200).collect()}
    assert np.allclose([got[i] for i in range(3000)], ranks(x))


def test_short_studies_have_long_chunks_and_wide_values_few_tasks(spark):
    """Rows between the tasks must not grow with the square of the samples: with few features a chunk
    holds many samples, and a value is dealt to as many tasks as it fills pieces."""
    from cohortlens.operators.ranking import with_pieces
    from cohortlens.operators.spearman import MOST_SAMPLES, chunk_samples

    assert chunk_samples(2048, 64, 6, 4) == MOST_SAMPLES >= 50 * 2048
    assert chunk_samples(2048, 64, 64, 64) == chunk_samples(2048, 64, 900, 64) == 2048
    values = [5.0] * 3000 + [6.0] * 1500 + [10.0 + k for k in range(5500)]
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "feature string, sample_id long, value double")
    totals = rows.groupBy("feature").count().withColumnRenamed("count", "n")
    placed, pieces = with_pieces(rows, ["feature"], "value", totals, 500)
    found = {r["value"]: r["width"] for r in placed.where("full").select("value", "width").distinct().collect()}
    assert pieces == 20 and set(found) == {5.0, 6.0}
    assert 5 <= found[5.0] <= 7 and 2 <= found[6.0] <= 4
    assert placed.where("NOT full AND width <> 0").count() == 0
