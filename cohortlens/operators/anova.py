"""One-way analysis of variance across features that share a rounded deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.special import f_sf
from cohortlens.operators.observations import round_half_even


def anova_members(summary: DataFrame) -> DataFrame:
    """(std_bucket, feature): the features that `anova_by_deviation` compares in each bucket."""
    return summary.select(round_half_even(F.sqrt("var_pop")).alias("std_bucket"), "feature")


def anova_by_deviation(summary: DataFrame) -> DataFrame:
    """Groups are features, buckets are population deviations rounded to two decimals.

    Works on (feature, n, mean, var_pop), never on values. F and p are null for a bucket of one
    feature. Each bucket's mean is found first and taken out before squaring, for accuracy.
    """
    bucketed = summary.withColumn("std_bucket", round_half_even(F.sqrt("var_pop")))
    n = F.col("n").cast("double")
    centres = bucketed.groupBy("std_bucket").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("n").alias("n_values"),
        (F.sum(n * F.col("mean")) / F.sum(n)).alias("centre"),
        F.sum(n * F.col("var_pop")).alias("ss_within"),
    )
    gap = F.col("mean") - F.col("centre")
    between = (
        bucketed.select("std_bucket", "mean", "n").join(
            centres.select("std_bucket", "centre"), "std_bucket")
        .groupBy("std_bucket").agg(F.sum(n * gap * gap).alias("ss_between"))
    )
    joined = centres.join(between, "std_bucket")
    d1, d2 = F.col("n_features") - 1, F.col("n_values") - F.col("n_features")
    defined = (d1 > 0) & (d2 > 0) & (F.col("ss_within") > 0)
    statistic = F.when(
        defined, F.try_divide(F.col("ss_between") * d2, F.col("ss_within") * d1))
    joined = joined.withColumn("f", statistic)
    p = F.when(
        F.col("f").isNotNull(), f_sf("f", "n_features - 1", "n_values - n_features"))
    return joined.select("std_bucket", "n_features", "n_values", "f", p.alias("p"))
