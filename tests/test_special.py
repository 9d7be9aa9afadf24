import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import special as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    # keep the optimizer from folding the whole formula on the driver
    return f"({float(x)!r}D + id)"


def test_log_gamma(spark):
    for x in (0.5, 1.0, 3.25, 7.9, 8.0, 42.5, 1e6, 3e9):
        assert one(spark, S.log_gamma(lit(x))) == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13)


def test_normal(spark):
    for z in (-40.0, -8.0, -3.0, -0.5, 0.0, 0.5, 1.959963985, 5.0, 9.0):
        exact = 0.5 * math.erfc(-z / math.sqrt(2))
        assert one(spark, S.normal_cdf(lit(z))) == pytest.approx(exact, rel=2e-8, abs=1e-300)
        logs = S.with_log_normal_cdf(spark.range(1), F.expr(lit(z)), "low", "high").first()
        for side, sign in (("low", 1), ("high", -1)):
            exact = 0.5 * math.erfc(-sign * z / math.sqrt(2))
            if exact > 0:
                assert logs[side] == pytest.approx(math.log(exact), rel=1e-7, abs=1e-15)
    from statistics import NormalDist

    for p in (1e-300, 1e-12, 1e-4, 0.05, 0.3, 0.5, 0.93, 0.999999):
        got = S.with_normal_quantile(spark.range(1).select(F.expr(lit(p)).alias("p")), F.col("p"), "z")
        assert got.columns == ["p", "z"]
        assert got.first()["z"] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-13, abs=1e-15)


def test_beta_and_gamma_known_values(spark):
    assert one(spark, S.beta_cdf(lit(2), lit(3), lit(0.4))) == pytest.approx(0.5248, abs=1e-14)
    assert one(spark, S.chi_square_sf(lit(9.487729036781154), lit(4))) == pytest.approx(0.05, abs=1e-13)
    assert one(spark, S.chi_square_sf(lit(0), lit(4))) == 1.0
    # df = 2 is exp(-x/2); x^a is I_x(a, 1)
    for x in (0.1, 3.0, 40.0, 900.0):
        assert one(spark, S.chi_square_sf(lit(x), lit(2))) == pytest.approx(math.exp(-x / 2), rel=1e-12)
    for a, x in ((5e8, 1 - 1e-9), (30000.0, 0.9999), (2.5, 0.01)):
        assert one(spark, S.beta_cdf(lit(a), lit(1), lit(x))) == pytest.approx(
            math.exp(a * math.log(x)), rel=1e-7)


def test_large_degrees_of_freedom(spark):
    # the symmetric beta is 1/2 at its centre, whatever its size
    for a in (10.0, 2e5, 5e7):
        assert one(spark, S.beta_cdf(lit(a), lit(a), lit(0.5))) == pytest.approx(0.5, abs=1e-9)
    # a billion pairs: Student is normal
    n, r = 1e9, 1.959963984540054 / math.sqrt(1e9)
    assert one(spark, S.correlation_p(lit(r), lit(n))) == pytest.approx(0.05, abs=1e-7)


def test_tests(spark):
    assert one(spark, S.fair_binomial_p(lit(2), lit(10))) == pytest.approx(0.109375, abs=1e-14)
    assert one(spark, S.fair_binomial_p(lit(5), lit(10))) == 1.0
    assert one(spark, S.fair_binomial_p(lit(0), lit(7))) == pytest.approx(2 / 128, abs=1e-14)
    assert one(spark, S.f_sf(lit(1.0), lit(2), lit(2))) == pytest.approx(0.5, abs=1e-14)
    assert one(spark, S.correlation_p(lit(1.0), lit(10))) == 0.0
    assert one(spark, S.correlation_p(lit(0.0), lit(10))) == pytest.approx(1.0, abs=1e-14)


def binomial_tail(n, k, p):
    """P(X >= k) with 60 digits."""
    from decimal import Decimal, localcontext

    with localcontext() as context:
        context.prec, context.Emin, context.Emax = 60, -10 ** 9, 10 ** 9
        p = Decimal(p)
        term, total = Decimal(math.comb(n, k)) * p ** k * (1 - p) ** (n - k), Decimal(0)
        for x in range(k, n + 1):
            total += term
            term = term * (n - x) / (x + 1) * p / (1 - p)
            if term < total * Decimal("1e-40"):
                break
        return float(total)


def poisson_below(mean, k):
    """P(X < k) with 60 digits; the chi-square tail at 2 * mean with 2 * k degrees."""
    from decimal import Decimal, localcontext

    with localcontext() as context:
        context.prec, context.Emin, context.Emax = 60, -10 ** 9, 10 ** 9
        term, total = (-Decimal(mean)).exp(), Decimal(0)
        for x in range(k):
            total += term
            term = term * Decimal(mean) / (x + 1)
        return float(total)


def test_fractions_converge_for_large_and_lopsided_arguments(spark):
    """Beta and gamma tails where many steps are needed: exact sums of binomials and Poissons."""
    cases = [(20_000, 10_100, 0.5), (20_000, 30, 0.001), (100_000, 5, 0.0001), (100_000, 99_990, 0.9999), (5_000, 4_000, 0.79),
             (1_000, 1, 0.002), (60_000, 18_000, 0.3), (60_000, 18_600, 0.3)]
    rows = spark.createDataFrame([(float(k), float(n - k + 1), p) for n, k, p in cases], "a double, b double, x double")
    got = [r["v"] for r in rows.select(S.beta_cdf("a", "b", "x").alias("v")).collect()]
    for case, value in zip(cases, got):
        assert value == pytest.approx(binomial_tail(*case), rel=1e-9), case
    cases = [(2_000.0, 2_000), (2_100.5, 2_000), (1_850.0, 2_000), (30.0, 3), (3.0, 30), (0.25, 4), (9_000.0, 9_300), (12.0, 1)]
    rows = spark.createDataFrame([(2 * m, 2 * k) for m, k in cases], "x double, df bigint")
    got = [r["v"] for r in rows.select(S.chi_square_sf("x", "df").alias("v")).collect()]
    for case, value in zip(cases, got):
        assert value == pytest.approx(poisson_below(*case), rel=1e-9), case
