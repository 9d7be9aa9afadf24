"""Values and shapes that real studies hold: NaN, infinities, ragged vectors, huge ids and counts."""

import math

import numpy as np
import pytest

from cohortlens.operators import anova, categorical, correlation, linear_models, normality, observations
from cohortlens.plans import cross_validation
from cohortlens.sources import results


def study(spark, columns):
    rows = [(f, k, v) for f, values in columns.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "feature string, sample_id bigint, value double")


def test_non_finite_values_count_as_missing(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=50).tolist(), rng.normal(size=50).tolist()
    clean = study(spark, {"x": x[1:], "y": y})
    for odd in (math.nan, math.inf, -math.inf):
        dirty = study(spark, {"x": [odd, *x[1:]], "y": y})
        fixed = spark.createDataFrame([("x", k + 1, v) for k, v in enumerate(x[1:])]
                                      + [("y", k, v) for k, v in enumerate(y)], clean.schema)
        for matrix in (correlation.pearson_matrix, correlation.spearman_matrix):
            got, want = (sorted(map(tuple, matrix(v).collect())) for v in (dirty, fixed))
            assert [g[:3] for g in got] == [w[:3] for w in want]
            assert np.allclose([g[3:5] for g in got], [w[3:5] for w in want])
        w = {r["feature"]: r["shapiro_w"] for r in normality.shapiro_w(dirty).collect()}
        assert w["x"] == pytest.approx({r["feature"]: r["shapiro_w"] for r in normality.shapiro_w(clean).collect()}["x"])
        counts = {r["feature"]: r["n_non_finite"] for r in observations.non_finite_counts(dirty).collect()}
        assert counts == {"x": 1, "y": 0}


@pytest.mark.parametrize("bad, message", [
    (None, "1 null vectors"), ([1.0], "1 vectors of another width"), ([1.0, None], "1 vectors with a null"),
    ([1.0, math.nan], "1 vectors with a null or non-finite"), ([1.0, 2.0, 3.0], "another width than 2"),
])
def test_vectors_are_checked_against_the_names(spark, bad, message):
    rows = [(k, float(k % 2), [1.0, float(k)]) for k in range(20)] + [(99, 1.0, bad)]
    points = spark.createDataFrame(rows, "sample_id bigint, label double, features array<double>")
    with pytest.raises(ValueError, match=message):
        cross_validation.cross_validate(points, ["a", "b"], "SVM", floor=2)


def test_two_ragged_rows_that_add_up(spark):
    points = spark.createDataFrame([(0, 1.0, [1.0] * 63), (1, 0.0, [1.0] * 65)],
                                   "sample_id bigint, label double, features array<double>")
    with pytest.raises(ValueError, match="2 vectors of another width"):
        linear_models.check_points(points, 64)


def test_both_engines_fit_the_same_penalised_model(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [1.0, 20.0, 0.1]
    y = x @ [0.5, 0.02, 1.0] + rng.normal(scale=0.1, size=300)
    points = spark.createDataFrame(
        [(float(b), a.tolist(), [True]) for a, b in zip(x, y)], "label double, features array<double>, in_train array<boolean>")
    w = linear_models.fit_by_estimator(points, np.ones((1, 3)), [0], "LinearRegressionWithSGD", 200)[0]
    assert np.allclose(w, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-4)
    lasso = linear_models.fit_by_estimator(points, np.ones((1, 3)), [0], "LassoWithSGD", 500)[0]
    strength, fit = linear_models.ALGORITHMS["LassoWithSGD"].strength, np.zeros(3)
    for _ in range(4000):  # coordinate descent on raw features: only without standardisation
        for k in range(3):
            rest = y - x @ fit + x[:, k] * fit[k]
            rho, size = (x[:, k] @ rest) / 300, (x[:, k] @ x[:, k]) / 300
            fit[k] = np.sign(rho) * max(abs(rho) - strength, 0) / size
    assert np.allclose(lasso, fit, atol=1e-3)


def test_wide_models(spark):
    width = 20_000
    features = spark.createDataFrame([([1.0] * width,)], "features array<double>")
    weights = [0.5 if k % 2 else -0.25 for k in range(width)]
    scored = features.select(linear_models.score(weights).alias("s"))
    assert scored.first()["s"] == pytest.approx(sum(weights))
    kept = observations.drop_positions(features, list(range(0, width, 10)))
    assert len(kept.first()["features"]) == width * 9 // 10
    assert observations.drop_positions(features, []).first()["features"] == [1.0] * width


def test_chi_square_of_large_counts(spark):
    for total in (10 ** 10, 10 ** 14):
        ns = [total + d * int(total ** 0.5) for d in (-2, 0, 1, 1)]
        rows = spark.createDataFrame([("f", str(k), n) for k, n in enumerate(ns)], "feature string, raw string, n bigint")
        mean = sum(ns) / 4
        got = categorical.chi_square_equal(rows).first()
        assert got["chi2"] == pytest.approx(sum((n - mean) ** 2 / mean for n in ns), rel=1e-9)
        assert got["n"] == sum(ns) and got["n_classes"] == 4


def test_sample_ids_up_to_the_largest(spark):
    top = 2 ** 63 - 1
    rows = [("num", top - k, str(k * 3)) for k in range(6)] + [("bin", -k, "yes" if k % 2 else "no") for k in range(6)]
    rows += [("unk", top - 9, "unknown"), *[("unk", top - k, str(k + 2)) for k in range(5)]]
    got = {r["feature"]: r["family"] for r in observations.feature_families(
        spark.createDataFrame(rows, "feature string, sample_id bigint, raw string")).collect()}
    assert got == {"num": "Numerical", "bin": "Binary", "unk": "Numerical"}


def test_one_update_per_key(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    updates = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "z", 1)], "id int, v string, at int")
    assert sorted(map(tuple, results.update_existing(target, updates, "id", order="at").collect())) == [(1, "x"), (2, "b")]
    assert sorted(map(tuple, results.update_existing(target, updates.drop("at"), "id").collect())) == [(1, "y"), (2, "b")]


def test_members_of_buckets(spark):
    summary = spark.createDataFrame([("a", 1.0), ("b", 1.001), ("c", 9.0)], "feature string, var_pop double")
    assert sorted(map(tuple, anova.anova_members(summary).collect())) == [(1.0, "a"), (1.0, "b"), (3.0, "c")]


def test_line_ids_do_not_depend_on_splits(spark, tmp_path):
    from cohortlens.sources import readers

    for name, n in (("b.txt", 700), ("a.txt", 900)):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" for k in range(n)))
    seen = []
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        seen.append(sorted((r["sample_id"], r["line"]) for r in readers.read_lines(spark, str(tmp_path)).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1]
    assert [line for _, line in seen[0]] == [f"a.txt {k}" for k in range(900)] + [f"b.txt {k}" for k in range(700)]
    assert seen[0][0][0] == 0 and seen[0][900][0] == 1 << 40
