"""Kolmogorov-Smirnov tests against named distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.special import exact_kolmogorov_p, kolmogorov_p, normal_cdf
from cohortlens.operators.normality import order_totals, runs_with_totals
from cohortlens.operators.ranking import TASK_ROWS

LAWS = ("uniform", "normal", "exponential")
# Up to so many values the p-value is that of the exact distribution of the distance.
EXACT_VALUES = 80


def _location_and_scale(law: str, parameters: dict[str, tuple[float, float]]) -> tuple[Column, Column]:
    """Given for the law, or read off the feature: its range, its mean and deviation, or its smallest
    value and the mean's distance from it."""
    if law in parameters:
        return tuple(F.lit(float(x)) for x in parameters[law])
    return {
        "uniform": (F.col("min_value"), F.col("max_value") - F.col("min_value")),
        "normal": (F.col("mean"), F.sqrt("var_pop")),
        "exponential": (F.col("min_value"), F.col("mean") - F.col("min_value")),
    }[law]


def _cdf(law: str, z: str) -> Column:
    if law == "normal":
        return normal_cdf(z)
    inside = F.greatest(F.lit(0.0), F.col(z))
    return F.least(F.lit(1.0), inside) if law == "uniform" else 1.0 - F.exp(-inside)


def ks_test(values: DataFrame, laws: Sequence[str] = LAWS, alpha: float = 0.05,
            parameters: dict[str, tuple[float, float]] | None = None, totals: DataFrame | None = None,
            exact_values: int = EXACT_VALUES, task_rows: int = TASK_ROWS) -> DataFrame:
    """(feature, law, n, ks_d, ks_p, distribution): one row per feature and law, all laws from one
    ranking of the values.

    `parameters` gives (location, scale) of a law; without it they are read off the feature, which
    makes the test accept more than its level says. `distribution` is the law where p is at least
    `alpha`, else `unknown`. Features without two different values have no row.
    """
    unknown = [law for law in laws if law not in LAWS]
    if unknown or not laws:
        raise ValueError(f"laws must be some of {LAWS}")
    parameters = parameters or {}
    if any(scale <= 0 for _, scale in parameters.values()):
        raise ValueError("a scale must be positive")
    if not 0 <= exact_values <= EXACT_VALUES:
        raise ValueError(f"exact p-values go up to {EXACT_VALUES} values")
    totals = order_totals(values) if totals is None else totals
    runs = runs_with_totals(values, totals, task_rows).where(F.col("max_value") > F.col("min_value"))
    n = F.col("n")
    standard = []
    for law in laws:
        location, scale = _location_and_scale(law, parameters)
        standard.append(((F.col("value") - location) / scale).alias(f"z_{law}"))
    placed = runs.select("feature", "n", "below", "run", *standard)
    placed = placed.select("feature", "n", "below", "run", *[_cdf(law, f"z_{law}").alias(law) for law in laws])
    gaps = [F.max(F.greatest((F.col("below") + F.col("run")) / n - F.col(law), F.col(law) - F.col("below") / n))
            .alias(law) for law in laws]
    found = placed.groupBy("feature").agg(F.max("n").alias("n"), *gaps)
    rows = found.select("feature", "n", F.inline(F.array(*[
        F.struct(F.lit(law).alias("law"), F.col(law).alias("ks_d")) for law in laws])))
    p = F.when(n <= exact_values, exact_kolmogorov_p("ks_d", "n")).otherwise(kolmogorov_p("ks_d", "n"))
    return rows.select("feature", "law", "n", "ks_d", p.alias("ks_p")).withColumn(
        "distribution", F.when(F.col("ks_p") >= alpha, F.col("law")).otherwise(F.lit("unknown")))
