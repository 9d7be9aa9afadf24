"""Class frequencies and the tests on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.special import chi_square_sf, fair_binomial_p


def class_counts(obs: DataFrame) -> DataFrame:
    """(feature, raw, n): how often each exact value occurs; partially aggregated."""
    return obs.groupBy("feature", "raw").agg(F.count(F.lit(1)).alias("n"))


def chi_square_equal(counts: DataFrame) -> DataFrame:
    """Goodness of fit against equally frequent classes; one class or none gives (0, 0)."""
    n = F.col("n").cast("double")
    sizes = counts.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("total"))
    mean = F.col("total").cast("double") / F.col("n_classes")
    # the mean first: squares of large counts would cancel
    sums = counts.select("feature", n.alias("n")).join(
        sizes.select("feature", "n_classes", "total", mean.alias("mean")), "feature"
    ).groupBy("feature", "n_classes", F.col("total").alias("n")).agg(
        F.sum((n - F.col("mean")) * (n - F.col("mean")) / F.col("mean")).alias("sum"))
    k = F.col("n_classes")
    sums = sums.withColumn("chi2", F.when(k > 1, F.col("sum")).otherwise(F.lit(0.0)))
    p = F.when(k > 1, chi_square_sf("chi2", "greatest(n_classes - 1, 1)")).otherwise(
        F.lit(0.0))
    return sums.select("feature", "n_classes", "n", "chi2", p.alias("p"))


def two_rarest(counts: DataFrame) -> DataFrame:
    """The two smallest class counts per feature (both of them when there are two classes)."""
    # The ranking limit is applied before the shuffle, so many classes stay cheap.
    order = Window.partitionBy("feature").orderBy("n", "raw")
    kept = counts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2)
    return kept.groupBy("feature").agg(
        F.max(F.when(F.col("nth") == 1, F.col("n"))).alias("low"),
        F.max(F.when(F.col("nth") == 2, F.col("n"))).alias("high"),
    )


def binomial_test(counts: DataFrame) -> DataFrame:
    """Exact two-sided test that the two rarest classes are equally likely."""
    pairs = two_rarest(counts).where(F.col("high").isNotNull())
    p = fair_binomial_p("low", "low + high")
    return pairs.select("feature", "low", "high", p.alias("p"))
