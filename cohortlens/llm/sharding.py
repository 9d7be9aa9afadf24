"""Sharding by jump consistent hashing of a stable key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import stored, table

#: Rows that share one piece of a shard when slots are numbered.
PIECE_ROWS = 50_000
LEAST_PIECES = 64


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys: each key's candidate jumps ahead through the
    shard numbers by its own pseudo-random sequence; the last number below `shards` is the shard."""
    state = keys.astype(np.uint64)
    at = np.full(len(state), -1, dtype=np.int64)
    ahead = np.zeros(len(state), dtype=np.int64)
    open_ = ahead < shards
    with np.errstate(over="ignore"):
        while open_.any():
            at[open_] = ahead[open_]
            state[open_] = state[open_] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (state[open_] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead[open_] = ((at[open_] + 1) * (2147483648.0 / draw)).astype(np.int64)
            open_ = ahead < shards
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key of any type; depends on the key as text and the shard count alone, so that an id
    stays where it is when its column becomes wider or a string. Null is a key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy().astype(np.int64).view(np.uint64), shards), dtype="int32")

    return place(F.xxhash64(key.cast("string")))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Slots number the rows of a shard without gaps. A shard is divided into pieces by a hash of key
    and row number, pieces are numbered on their own and moved by the rows of the pieces before, so
    no task sees a whole shard, also where one key holds a third of the rows. Row numbers follow the
    splits of the input and are written once, so slots (not shards) may differ between runs.
    Null text: no bytes, size 1, crc 0. An empty table gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(whole) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
    ).withColumns({"shard": shard_of(F.col("key"), shards),
                   "grown_shard": shard_of(F.col("key"), shards + 1)})
    pieces = max(LEAST_PIECES, docs.select(key).count() // (PIECE_ROWS * shards))
    rows = stored(rows.withColumn(
        "row", F.monotonically_increasing_id()
    ).withColumn("piece", F.pmod(F.xxhash64("key", "row"), F.lit(pieces)).cast("int")))
    counts = rows.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "piece").orderBy("key", "row")
    return (
        rows.withColumn("rank", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "piece"])
        .select("key", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("start") + F.col("rank")).alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write `docs` as one folder per shard; each task appends to every shard it has rows of."""
    docs.withColumn("shard", shard_of(F.col(key), shards)).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign(docs, 8).withColumnRenamed("key", "doc_id")
