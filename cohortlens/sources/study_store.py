"""Typed study on disk, laid out so that a test reads only the features of its family."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.tokens import to_number
from cohortlens.operators.observations import FAMILIES, drop_missing
from cohortlens.session import lookup_side


@contextmanager
def open_writers(spark: SparkSession, most: int) -> Iterator[None]:
    """Inside, a task that writes to at most `most` folders keeps a file open for each. Otherwise it
    sorts its rows by folder first, which for a large share of a study goes through its disk."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_study(obs: DataFrame, families: DataFrame, path: str, data_type: str = "study") -> None:
    """Write the present values of (feature, sample_id, raw) in one pass, with their number where
    they are one, under `path`/data_type=../family=... Features of a family are kept together in
    files of their own; other data types under the path stay as they are."""
    names = lookup_side(families.select("feature", "family"))
    typed = drop_missing(obs).join(names, "feature").select(
        "feature", "sample_id", "raw", to_number(F.col("raw")).alias("value"),
        F.lit(data_type).alias("data_type"), "family")
    with open_writers(obs.sparkSession, len(FAMILIES)):
        typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "data_type", "family").parquet(path)


def read_family(spark: SparkSession, path: str, family: str, data_type: str = "study") -> DataFrame:
    """(feature, sample_id, raw, value) of one family; the scan lists its partition only. A family
    that the study does not have has no rows."""
    stored = spark.read.schema(
        "feature string, sample_id bigint, raw string, value double, data_type string, family string").parquet(path)
    return stored.where((F.col("data_type") == data_type) & (F.col("family") == family)).select(
        "feature", "sample_id", "raw", "value")
