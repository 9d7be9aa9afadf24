"""Pathway enrichment from a gene list to the corrected top pathways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.correction import correct
from cohortlens.operators.enrichment import (
    GENE_UNIVERSE, contingency, fisher_tests, pathway_overlap, symbols_to_ids, top_pathways,
    with_list_size,
)


def all_tests(links: DataFrame, gene_ids: DataFrame, universe: DataFrame | int = GENE_UNIVERSE
              ) -> DataFrame:
    """Fisher's test of every pathway; an empty gene list gives no tests.

    `universe` is a number, or a one-row DataFrame (universe) when it is counted from data.
    """
    overlap = with_list_size(pathway_overlap(links, gene_ids), gene_ids)
    overlap = overlap.where(F.col("list_size") > 0)
    if isinstance(universe, DataFrame):
        overlap = overlap.join(F.broadcast(universe), F.lit(True))  # one row
    else:
        overlap = overlap.withColumn("universe", F.lit(universe))
    return fisher_tests(contingency(overlap, F.col("universe")))


def enrich(links: DataFrame, gene_ids: DataFrame, correction: str | None = "Bonferroni", *,
           universe: DataFrame | int = GENE_UNIVERSE, k: int = 5, n_tests: str = "topk",
           alpha: float = 0.05) -> DataFrame:
    """The k most over-represented pathways with corrected p.

    `n_tests="topk"` corrects for the reported tests only, `"all"` for every pathway tested; the
    step-down method then ranks all pathways before the top is taken.
    """
    if n_tests not in ("topk", "all"):
        raise ValueError("n_tests must be 'topk' or 'all'")
    tests = all_tests(links, gene_ids, universe)
    if n_tests == "topk":
        return correct(top_pathways(tests, k), correction, alpha=alpha)
    return top_pathways(correct(tests, correction, alpha=alpha), k)


def enrich_symbols(links: DataFrame, symbols: DataFrame, symbol_map: DataFrame,
                   correction: str | None = "Bonferroni", **options) -> DataFrame:
    return enrich(links, symbols_to_ids(symbols, symbol_map), correction, **options)


def with_names(top: DataFrame, names: DataFrame) -> DataFrame:
    """Attach the pathway names to the few reported pathways."""
    return top.join(names, "pathway", "left")


def enrichment_document(top: DataFrame, gene_ids: DataFrame, correction: str | None = None,
                        custom: str | None = None) -> DataFrame:
    """One result row: the top pathways in order of p, the first of them, the size of the gene list
    and the settings. The list itself is the table `gene_listing`."""
    pathways = top.agg(F.array_sort(F.collect_list(F.struct("log10_p", "pathway", "p_corrected")))
                       .alias("ranked")).select(
        F.transform("ranked", lambda t: F.struct(
            t["pathway"].alias("pathway"), t["p_corrected"].alias("p"))).alias("TopPathways"))
    size = gene_ids.agg(F.count_distinct("gene_id").alias("NumberOfGenes"))
    return pathways.join(F.broadcast(size), F.lit(True)).select(  # one row each
        "TopPathways", F.get("TopPathways", F.lit(0))["pathway"].alias("KeggTopPathway"),
        "NumberOfGenes", F.lit(correction).cast("string").alias("Correction"),
        F.lit(custom).cast("string").alias("CustomField"),
        F.current_timestamp().alias("EndTime"), F.lit("Completed").alias("Status"))


def gene_listing(symbols: DataFrame, symbol_map: DataFrame) -> DataFrame:
    """The list itself, (symbol, gene_id) in descending order; a table, as it may be long."""
    return symbols_to_ids(symbols, symbol_map).orderBy(F.desc("symbol"))
