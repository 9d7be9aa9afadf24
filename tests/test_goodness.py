import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.special import exact_kolmogorov_p, kolmogorov_p
from cohortlens.operators import goodness as G


@pytest.mark.parametrize("n,d", [(5, 0.56328), (10, 0.40925), (20, 0.29408), (35, 0.22425), (40, 0.21012)])
def test_exact_p_at_tabulated_five_percent_points(spark, n, d):
    row = spark.createDataFrame([(n, d)], "n bigint, d double").select(exact_kolmogorov_p("d", "n").alias("p")).first()
    assert row["p"] == pytest.approx(0.05, abs=2e-5)


def test_exact_p_of_one_and_two_values_and_near_the_asymptote(spark):
    rows = [(1, 0.5), (1, 0.8), (1, 1.0), (2, 0.25), (2, 0.6), (80, 0.1), (80, 0.02), (80, 1.0)]
    table = spark.createDataFrame(rows, "n bigint, d double").select(
        "n", "d", exact_kolmogorov_p("d", "n").alias("p"), kolmogorov_p("d", "n").alias("far"))
    got = {(r["n"], r["d"]): r for r in table.collect()}
    assert got[1, 0.5]["p"] == pytest.approx(1.0) and got[1, 0.8]["p"] == pytest.approx(0.4)
    assert got[1, 1.0]["p"] == pytest.approx(0.0, abs=1e-12)
    assert got[2, 0.25]["p"] == pytest.approx(1.0) and got[2, 0.6]["p"] == pytest.approx(2 * 0.4 ** 2)
    assert got[80, 0.1]["p"] == pytest.approx(got[80, 0.1]["far"], abs=1e-2)
    assert got[80, 0.02]["p"] == pytest.approx(1.0, abs=1e-6) and got[80, 1.0]["p"] < 1e-12


def distance(x, cdf):
    x = np.sort(x)
    f, n = cdf(x), len(x)
    return max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())


def test_laws(spark):
    rng = np.random.default_rng(4)
    data = {"u": rng.permutation(np.linspace(3, 9, 400) ** 1.02), "g": rng.normal(5, 2, 400), "e": rng.exponential(2, 400) + 1,
            "ties": rng.integers(0, 4, 300) * 1.0, "few": rng.normal(0, 1, 12)}
    rows = [(f, i, float(v)) for f, x in data.items() for i, v in enumerate(x)]
    rows += [("flat", i, 1.0) for i in range(9)] + [("u", 1000, float("nan")), ("u", 1001, None)]
    values = spark.createDataFrame(rows, "feature string, sample_id bigint, value double")
    phi = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
    for task_rows in (10 ** 6, 50):
        got = {(r["feature"], r["law"]): r for r in G.ks_test(values, task_rows=task_rows).collect()}
        assert set(got) == {(f, law) for f in data for law in G.LAWS}
        for f, x in data.items():
            lo, hi, mu, sd = x.min(), x.max(), x.mean(), x.std()
            want = {"uniform": distance(x, lambda v: (v - lo) / (hi - lo)), "normal": distance(x, lambda v: phi((v - mu) / sd)),
                    "exponential": distance(x, lambda v: 1 - np.exp(-(v - lo) / (mu - lo)))}
            for law, d in want.items():
                assert got[f, law]["ks_d"] == pytest.approx(d, abs=1e-12)
                assert got[f, law]["distribution"] == (law if got[f, law]["ks_p"] >= 0.05 else "unknown")
        assert [got["u", "uniform"]["distribution"], got["g", "normal"]["distribution"], got["e", "exponential"]["distribution"]] == [
            "uniform", "normal", "exponential"]
        assert got["e", "normal"]["distribution"] == got["e", "uniform"]["distribution"] == "unknown"


def test_given_parameters_and_bad_arguments(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(10, 3, 60)
    values = spark.createDataFrame([("f", i, float(v)) for i, v in enumerate(x)], "feature string, sample_id bigint, value double")
    right = G.ks_test(values, ["normal"], parameters={"normal": (10.0, 3.0)}).first()
    wrong = G.ks_test(values, ["normal"], parameters={"normal": (0.0, 1.0)}).first()
    assert right["distribution"] == "normal" and wrong["distribution"] == "unknown"
    for bad in (dict(laws=["cauchy"]), dict(laws=[]), dict(parameters={"normal": (0.0, 0.0)}), dict(exact_values=200)):
        with pytest.raises(ValueError):
            G.ks_test(values, **bad)
    assert G.ks_test(values.where(F.col("sample_id") < 0)).count() == 0
