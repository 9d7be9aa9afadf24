"""Result sink: overwrite fields of existing results, never insert new ones.

Stored results are kept in folders by a hash of their key, so that an update reads and replaces only
the folders that hold a key it changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import cut, lookup_side

BUCKET = "_bucket"


def update_existing(target: DataFrame, updates: DataFrame, key: str,
                    order: str | None = None) -> DataFrame:
    """`target` with every field of `updates` set where the key exists in both.

    Of several updates of a key the one with the largest `order` (a column of `updates`, not
    written) counts, without one the largest row, so that a key never gives two rows.
    """
    fields = [name for name in updates.columns if name not in (key, order)]
    if fields:
        rank = [F.col(order)] if order else []
        updates = updates.groupBy(key).agg(
            F.max(F.struct(*rank, *fields)).alias("last")).select(
            key, *[F.col("last")[name].alias(name) for name in fields])
    else:
        updates = updates.select(key).distinct()
    new = updates.select(
        F.col(key).alias("update_key"), *[F.col(name).alias(f"new_{name}") for name in fields]
    )
    joined = target.join(new, F.col(key) == F.col("update_key"), "left")
    matched = F.col("update_key").isNotNull()
    kept = [
        F.when(matched, F.col(f"new_{name}")).otherwise(F.col(name)).alias(name)
        if name in fields else F.col(name)
        for name in target.columns
    ]
    added = [F.col(f"new_{name}").alias(name) for name in fields if name not in target.columns]
    return joined.select(*kept, *added)


def write_results(results: DataFrame, path: str) -> None:
    """Results go to a new path; an existing one is refused rather than overwritten."""
    results.write.mode("errorifexists").parquet(path)


def bucket_of(key: str, buckets: int) -> Column:
    """The folder of a key, by its md5, so that it stays the same for any type of the column."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def store_results(results: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Write results to a new path, in `buckets` folders by key."""
    results.withColumn(BUCKET, bucket_of(key, buckets)).repartition(BUCKET).write.mode("errorifexists").partitionBy(
        BUCKET).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def update_stored(spark: SparkSession, path: str, updates: DataFrame, key: str, buckets: int = 64,
                  order: str | None = None) -> list[int]:
    """`update_existing` on stored results; gives the folders replaced, at most `buckets`.

    Only folders with a key of `updates` are read, and of these only those with a match replaced. The
    new rows are first written apart in whole; then Spark writes the folders aside and swaps them in
    when all tasks are done, so that a failure before leaves the results as they were. Fields that
    the stored results lack would change all files and are refused.
    """
    stored = spark.read.parquet(path)
    unknown = set(updates.columns) - set(stored.columns) - {order}
    if unknown:
        raise ValueError(f"stored results have no {sorted(unknown)}")
    keyed = updates.withColumn(BUCKET, bucket_of(key, buckets))
    asked = [r[0] for r in keyed.select(BUCKET).distinct().collect()]
    near = stored.where(F.col(BUCKET).isin(asked)) if asked else stored.limit(0)
    matched = near.select(key, BUCKET).join(lookup_side(updates.select(key).distinct()), key, "left_semi")
    touched = sorted(r[0] for r in matched.select(BUCKET).distinct().collect())
    if not touched:
        return []
    new = update_existing(stored.where(F.col(BUCKET).isin(touched)),
                          keyed.where(F.col(BUCKET).isin(touched)).drop(BUCKET), key, order)
    kinds = {f.name: f.dataType for f in stored.schema.fields}
    new = cut(new.select(*[F.col(name).cast(kinds[name]).alias(name) for name in stored.columns]))
    new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        BUCKET).parquet(path)
    return touched
