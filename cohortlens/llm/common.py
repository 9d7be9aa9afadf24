"""Shared helpers: stored intermediates, connected components, Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir

#: Words of every operator here: runs of anything but blanks and the ASCII controls 9 to 13.
BLANKS = "[\\x20\\x09-\\x0D]+"
#: Rows turned into Python objects at a time inside a task.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the local folder that tests set in its place."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it from there: later jobs neither compute it
    again nor depend on files of an executor that may be lost."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Views of a few rows, so that a task never holds a whole batch as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of `edges`: (id, component), the smallest id reachable; only ids that
    have an edge to another id.

    Alternating large and small stars: each round links every node's larger neighbours to its
    smallest one. Minima are partial aggregates, so a hub with very many edges is no hot group,
    and rounds grow with the logarithm of the longest chain.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    pairs = stored(pairs.where("u <> v").distinct())
    mark = None
    while True:
        new = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == mark:
            break
        mark = new
        if not mark[0]:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v")))
        pairs = stored(small.where("u <> v").distinct())
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
