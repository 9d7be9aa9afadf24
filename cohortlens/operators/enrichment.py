"""Over-representation of a gene list in gene sets by Fisher's exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.hypergeometric import with_fisher

# Fixed value: size of the gene universe assumed by default.
GENE_UNIVERSE = 30922


def symbols_to_ids(symbols: DataFrame, symbol_map: DataFrame) -> DataFrame:
    """(symbol, gene_id) of the distinct symbols that are mapped; unknown symbols are dropped. Two
    symbols may have one id."""
    return symbols.select("symbol").distinct().join(symbol_map, "symbol").select(
        "symbol", "gene_id")


def pathway_overlap(links: DataFrame, gene_ids: DataFrame) -> DataFrame:
    """(pathway, m, k): set size and members on the list; repeated links and ids count once."""
    listed = gene_ids.select("gene_id").distinct().withColumn("hit", F.lit(1).cast("bigint"))
    edges = links.select("pathway", "gene_id").distinct()
    return edges.join(listed, "gene_id", "left").groupBy("pathway").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.coalesce("hit", F.lit(0).cast("bigint"))).alias("k"))


def with_list_size(overlap: DataFrame, gene_ids: DataFrame) -> DataFrame:
    """Add `list_size`, the number of distinct listed ids."""
    size = gene_ids.agg(F.count_distinct("gene_id").alias("list_size"))
    return overlap.join(F.broadcast(size), F.lit(True))  # one row


def contingency(overlap: DataFrame, universe: Column) -> DataFrame:
    """2x2 table per pathway: a, b over the list, c, d over the rest of the universe."""
    k, m, size = F.col("k"), F.col("m"), F.col("list_size")
    return overlap.select(
        "pathway", k.alias("a"), (size - k).alias("b"), (m - k).alias("c"),
        (universe - (m + size - k)).cast("bigint").alias("d"),
    )


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Sample odds ratio; infinite when only b*c is zero, NaN when a margin is zero."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    empty = (a + b == 0) | (c + d == 0) | (a + c == 0) | (b + d == 0)
    return (
        F.when(empty, F.lit(float("nan")))
        .when(b * c > 0, F.try_divide(a * d, b * c))
        .when(a * d > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    )


def fisher_tests(tables: DataFrame) -> DataFrame:
    """Contingency tables to (pathway, a, b, c, d, odds_ratio, p, log10_p)."""
    cells = ("a", "b", "c", "d")
    odds = odds_ratio(*[F.col(name) for name in cells])
    return with_fisher(tables.select("pathway", *cells, odds.alias("odds_ratio")))


def top_pathways(tests: DataFrame, k: int = 5) -> DataFrame:
    """The k smallest p-values, told apart by their logs where p is too small for a double; ties by
    pathway name."""
    return tests.orderBy("log10_p", "pathway").limit(k)
