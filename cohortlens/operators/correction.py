"""Multiple-testing corrections of a small table with one row per test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _capped(p: Column) -> Column:
    return F.least(p, F.lit(1.0))


def bonferroni(p: Column, n: Column, alpha: float = 0.05) -> Column:
    return _capped(p * n)


def sidak(p: Column, n: Column, alpha: float = 0.05) -> Column:
    """p scaled by the ratio of alpha to the per-test level."""
    level = 1.0 - F.pow(F.lit(1.0 - alpha), F.try_divide(F.lit(1.0), n))
    return _capped(p * F.coalesce(F.try_divide(F.lit(alpha), level), F.lit(1.0)))


def holm(p: Column, n: Column, alpha: float = 0.05) -> Column:
    """p scaled by the tests not smaller than it, but only where it passes its own level.

    The ranking window covers the whole table of tests.
    """
    remaining = n + 1 - F.rank().over(Window.orderBy(p))
    return _capped(F.when(p / remaining < alpha, p * remaining).otherwise(p))


CORRECTIONS: dict[str, Callable[..., Column]] = {
    "Bonferroni": bonferroni, "HB": holm, "Sidak": sidak,
}


def correct(tests: DataFrame, method: str | None, p: str = "p", alpha: float = 0.05,
            n_tests: int | None = None) -> DataFrame:
    """Add `p_corrected`. `n_tests` defaults to the number of rows; `None` leaves p unchanged."""
    if method is None:
        return tests.withColumn("p_corrected", _capped(F.col(p)))
    if method not in CORRECTIONS:
        raise ValueError(f"correction must be one of {sorted(CORRECTIONS)} or None")
    if n_tests is None:
        size = tests.agg(F.count(F.lit(1)).alias("test_count"))
        tests = tests.join(F.broadcast(size), F.lit(True))  # one row
    else:
        tests = tests.withColumn("test_count", F.lit(n_tests))
    corrected = CORRECTIONS[method](F.col(p), F.col("test_count"), alpha)
    return tests.withColumn("p_corrected", corrected).drop("test_count")
