"""Study fixtures derived from the driver's tables; every one covers its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str):
    """A two-decimal number string that reads the same in every engine."""
    return F.col(column).cast("decimal(12,2)").cast("string")


def mixed_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined with customer as (feature, sample_id, raw): all families, missing values."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    balance = F.when(F.col("c_acctbal") < 0, F.lit("NA")).when(
        key % 11 == 0, F.lit("")).otherwise(money("c_acctbal"))
    priority = F.when(F.col("o_orderpriority").startswith("5"), F.lit("NA")).otherwise(
        F.col("o_orderpriority"))
    building = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Yes")).otherwise(F.lit("no"))
    features = {
        "totalprice": money("o_totalprice"),
        "acctbal": balance,
        "nation": F.col("c_nationkey").cast("string"),
        "status": F.col("o_orderstatus"),
        "priority": priority,
        "building": building,
        "fulfilled": F.when(F.col("o_orderstatus") == "F", F.lit("1")).otherwise(F.lit("0")),
        "constant": F.lit("7"),
        "rare": F.when(F.col("o_orderkey") < 3, F.col("o_orderkey").cast("string")).otherwise(
            F.lit("NA")),
        "guessed": F.when(key == 0, F.lit("unknown")).otherwise(money("o_totalprice")),
        "answered": F.when(key < 2, F.lit("Uncertain")).otherwise(building),
    }
    cells = F.array(*[
        F.struct(F.lit(name).alias("feature"), value.alias("raw"))
        for name, value in features.items()
    ])
    return rows.select(key.alias("sample_id"), F.inline(cells)).select(
        "feature", "sample_id", "raw")


def numeric_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding dimensions d00, d01, ... as (feature, sample_id, value)."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("pos", "x")
    ).select(
        F.format_string("d%02d", "pos").alias("feature"), "sample_id",
        F.col("x").cast("double").alias("value"),
    )


def gappy_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns of orders and customer, with gaps, as (feature, sample_id, value)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    features = {
        "totalprice": F.col("o_totalprice"),
        "acctbal": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")),
        "nation": F.col("c_nationkey").cast("double"),
        "late": F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") + F.col("c_acctbal")),
        "constant": F.lit(7.0),
        "rare": F.when(key < 2, key.cast("double")),
    }
    cells = F.array(*[
        F.struct(F.lit(name).alias("feature"), value.alias("value"))
        for name, value in features.items()
    ])
    return rows.select(key.alias("sample_id"), F.inline(cells)).where(
        F.col("value").isNotNull()).select("feature", "sample_id", "value")


def labeled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as (sample_id, label, features) with a two-valued label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.when(F.col("label") >= 5, F.lit(1.0)).otherwise(F.lit(0.0)).alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def vector_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """Feature names of `labeled_vectors`, read from the width of the vectors."""
    width = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    return [f"d{i:02d}" for i in range(width)]


def brand_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as pathways, parts as genes."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("pathway"), F.col("p_partkey").alias("gene_id"))


def part_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("universe"))


def returned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts returned in large quantities as the gene list."""
    return table(spark, sf_dir, "lineitem").where(
        (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)
    ).select(F.col("l_partkey").alias("gene_id"))
