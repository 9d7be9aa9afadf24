"""Reproducible random splits: a row's side depends on its id and the seed only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform_of(seed: Column | int, key: Column) -> Column:
    """A number in [0, 1) from an md5 of seed and key; independent of partitioning and retries."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    digest = F.md5(F.concat_ws("|", seed.cast("string"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / 4294967296.0


def in_training(seed: Column | int, key: Column, train_fraction: float) -> Column:
    return uniform_of(seed, key) < train_fraction


def split(points: DataFrame, seed: int, train_fraction: float, key: str = "sample_id"
          ) -> tuple[DataFrame, DataFrame]:
    """(training, validation): disjoint, complete, and the same on every evaluation."""
    training = in_training(seed, F.col(key), train_fraction)
    return points.where(training), points.where(~training)


def resample_sizes(points: DataFrame, seeds: list[int], train_fraction: float,
                   key: str = "sample_id") -> DataFrame:
    """(run, n_train, n_validation) of every resample in one pass over the points."""
    flags = [in_training(seed, F.col(key), train_fraction) for seed in seeds]
    sums = points.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(flag).alias(f"n_{run}") for run, flag in enumerate(flags)],
    )
    rows = F.array(*[
        F.struct(F.lit(run).cast("bigint").alias("run"), F.col(f"n_{run}").alias("n_train"),
                 (F.col("n") - F.col(f"n_{run}")).alias("n_validation"))
        for run in range(len(seeds))
    ])
    return sums.select(F.inline(rows))
