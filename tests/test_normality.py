import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import normality as N
from cohortlens.operators.ranking import average_ranks, ranked_runs

PHI = NormalDist()


def brute_w(x):
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        m = np.array([PHI.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        s, u = (m ** 2).sum(), n ** -0.5
        an = np.polyval(N.LARGEST_WEIGHT, u) + m[-1] / math.sqrt(s)
        a = np.empty(n)
        if n > 5:
            an1 = np.polyval(N.SECOND_WEIGHT, u) + m[-2] / math.sqrt(s)
            phi = (s - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
            a[:] = m / math.sqrt(phi)
            a[-2], a[1] = an1, -an1
        else:
            phi = (s - 2 * m[-1] ** 2) / (1 - 2 * an ** 2)
            a[:] = m / math.sqrt(phi)
        a[-1], a[0] = an, -an
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


def brute_a2(x):
    x = np.sort(np.asarray(x, float))
    n = len(x)
    z = (x - x.mean()) / x.std(ddof=1)
    i = np.arange(1, n + 1)
    lo = np.array([math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in z])
    hi = np.array([math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in z])
    return -n - ((2 * i - 1) * lo + (2 * (n - i) + 1) * hi).sum() / n


def brute_ks(x):
    x = np.sort(np.asarray(x, float))
    n = len(x)
    f = (x - x.min()) / (x.max() - x.min())
    i = np.arange(1, n + 1)
    return max((i / n - f).max(), (f - (i - 1) / n).max())


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(5)
    zeros = np.zeros(900)
    return {
        "normal": rng.normal(3, 2, 400).tolist(),
        "skewed": rng.exponential(1, 300).tolist(),
        "ties": rng.integers(0, 6, 500).astype(float).tolist(),
        # one value holds most of the feature
        "hot": np.concatenate([rng.normal(0, 1, 700), zeros]).tolist(),
        "lowhot": np.concatenate([rng.exponential(1, 600), zeros]).tolist(),
        "three": [1.0, 2.0, 4.5],
        "four": [1.0, 2.0, 4.5, 4.0],
        "five": [1.0, 2.0, 4.5, 4.0, 9.0],
        "six": [1.0, 2.0, 4.5, 4.0, 9.0, 7.0],
        "constant": [2.0] * 12,
        "one": [1.0],
        "two": [1.0, 5.0],
    }


@pytest.fixture(scope="module")
def values(spark, samples):
    rows = [(f, i, float(v)) for f, xs in samples.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "feature string, sample_id bigint, value double")


@pytest.mark.parametrize("task_rows,long_run", [(4_000_000, 1024), (97, 128)])
def test_statistics_match_brute_force(values, samples, task_rows, long_run):
    got = {r["feature"]: r for r in
           N.normality(values, task_rows=task_rows, long_run=long_run).collect()}
    assert set(got) == set(samples)
    for name, xs in samples.items():
        if len(set(xs)) < 2:
            assert got[name]["shapiro_w"] is None and got[name]["anderson_a2"] is None
            assert got[name]["distribution"] == "unknown"
            continue
        if len(xs) >= 3:
            assert got[name]["shapiro_w"] == pytest.approx(min(brute_w(xs), 1), rel=1e-10), name
        assert got[name]["anderson_a2"] == pytest.approx(brute_a2(xs), rel=1e-7, abs=1e-9), name
    assert got["normal"]["distribution"] == "normal"
    assert got["skewed"]["distribution"] == "unknown"


@pytest.mark.parametrize("task_rows", [4_000_000, 97])
def test_ks(values, samples, task_rows):
    got = {r["feature"]: r["ks_d"] for r in N.ks_uniform(values, task_rows=task_rows).collect()}
    for name, xs in samples.items():
        if len(set(xs)) > 1:
            assert got[name] == pytest.approx(brute_ks(xs), abs=1e-12), name


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_divided_ranks_equal_plain_ranks(spark, values, parts):
    totals = values.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    shuffled = values.repartition(parts)
    plain = ranked_runs(values, ["feature"], "value", totals)
    divided = ranked_runs(shuffled, ["feature"], "value", totals, task_rows=50)
    assert sorted(plain.collect()) == sorted(divided.select(plain.columns).collect())
    a = average_ranks(values, ["feature"], "value", totals, "r")
    b = average_ranks(shuffled, ["feature"], "value", totals, "r", task_rows=50)
    assert sorted(a.collect()) == sorted(b.select(a.columns).collect())


def test_thresholds(spark):
    rows = {r["n"]: r["w"] for r in spark.range(1, 70).select(
        F.col("id").alias("n"), N.shapiro_threshold(F.col("id")).alias("w")).collect()}
    assert rows[4] is None and rows[5] == 0.762 and rows[19] == 0.901 and rows[24] == 0.905
    assert rows[25] == 0.918 and rows[49] == 0.94 and rows[50] == 0.947 and rows[69] == 0.947
    crit = spark.range(1).select(N.anderson_threshold(F.lit(10.0)).alias("c")).first()["c"]
    assert crit == 0.684
    with pytest.raises(ValueError):
        N.anderson_threshold(F.lit(10.0), 7.0)


def test_empty_input(spark):
    empty = spark.createDataFrame([], "feature string, sample_id bigint, value double")
    assert N.normality(empty).count() == 0
    assert N.ks_uniform(empty).count() == 0
