"""Pearson and Spearman matrices with pairwise deletion of missing values.

A pair of features needs seven sums over the samples both have. Emitting a row per sample and pair
would multiply the data by the number of features, so the sums are taken block by block instead:
samples are divided into chunks, features into blocks, and one task multiplies two feature blocks
of one chunk as matrices. What is shuffled afterwards is one row per pair and chunk. Values are
centred by the feature mean first, which keeps the sums of squares accurate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.special import correlation_p
from cohortlens.operators.observations import finite_only
from cohortlens.operators.spearman import BLOCK_FEATURES as SPEARMAN_BLOCK
from cohortlens.operators.spearman import CHUNK_SAMPLES as SPEARMAN_CHUNK
from cohortlens.operators.spearman import (
    PIECE_ROWS, number_features, one_per_cell, rank_moments,
)
from cohortlens.session import cut, kept, lookup_side

# Features per block and samples per chunk: two blocks of one chunk are about 32 MB of doubles.
BLOCK_FEATURES = 256
CHUNK_SAMPLES = 8192

_MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
_SCHEMA = (
    "i bigint, j bigint, n bigint, sx double, sy double, sxx double, syy double, sxy double, "
    "min_x double, max_x double, min_y double, max_y double"
)


def feature_index(values: DataFrame) -> DataFrame:
    """(feature, idx, n, mean): one row per feature, numbered in name order, fixed for later steps."""
    totals = values.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.mean("value").alias("mean"))
    # the numbering window runs over one row per feature, not over values
    numbered = totals.withColumn("idx", F.row_number().over(Window.orderBy("feature")) - 1)
    return cut(numbered.select("feature", F.col("idx").cast("bigint").alias("idx"), "n", "mean"))


def _block_moments(block: int, features: int, packed: bool):
    """Task: moments of all feature pairs of two blocks within one chunk of samples."""

    def moments(key, pdf):
        import numpy as np
        import pandas as pd

        left, right = int(key[0]), int(key[1])
        samples, row = np.unique(pdf["sample_id"].to_numpy(), return_inverse=True)
        idx, value = pdf["idx"], pdf["value"]
        if packed:  # one row per sample and block, cells as arrays
            row = np.repeat(row, idx.str.len())
            idx, value = np.concatenate(idx.to_list()), np.concatenate(value.to_list())
        else:
            idx, value = idx.to_numpy(), value.to_numpy()
        # of a repeated feature and sample the largest value is written last
        order = np.argsort(value, kind="stable")
        row, idx, value = row[order], idx[order], value[order]

        def dense(which):
            inside = idx // block == which
            filled = np.full((len(samples), block), np.nan)
            filled[row[inside], idx[inside] % block] = value[inside]
            return filled

        x = dense(left)
        y = x if left == right else dense(right)

        def extremes(a, present):
            """Smallest and largest of every column of `a` among the rows of each mask column."""
            low = np.full((a.shape[1], present.shape[1]), np.inf)
            high = -low
            filled_low = np.where(np.isnan(a), np.inf, a)
            filled_high = np.where(np.isnan(a), -np.inf, a)
            everywhere = present.all(axis=0)
            low[:, everywhere] = filled_low.min(axis=0)[:, None]
            high[:, everywhere] = filled_high.max(axis=0)[:, None]
            for column in np.flatnonzero(~everywhere & present.any(axis=0)):
                rows = present[:, column]
                low[:, column] = filled_low[rows].min(axis=0)
                high[:, column] = filled_high[rows].max(axis=0)
            return low, high

        has_x, has_y = ~np.isnan(x), ~np.isnan(y)
        mx, my = has_x.astype(float), has_y.astype(float)
        x0, y0 = np.where(has_x, x, 0.0), np.where(has_y, y, 0.0)
        n = mx.T @ my
        min_x, max_x = extremes(x, has_y)
        min_y, max_y = (m.T for m in extremes(y, has_x))
        i = np.arange(block)[:, None] + left * block
        j = np.arange(block)[None, :] + right * block
        keep = (i <= j) & (j < features)  # also pairs without a common sample
        i, j = np.broadcast_arrays(i, j)
        columns = {
            "i": i, "j": j, "n": n.astype(np.int64), "sx": x0.T @ my, "sy": mx.T @ y0,
            "sxx": (x0 * x0).T @ my, "syy": mx.T @ (y0 * y0), "sxy": x0.T @ y0,
            "min_x": min_x, "max_x": max_x, "min_y": min_y, "max_y": max_y,
        }
        return pd.DataFrame({name: matrix[keep] for name, matrix in columns.items()})

    return moments


def pair_moments(values: DataFrame, index: DataFrame, block: int = BLOCK_FEATURES,
                 chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Sums over the common samples of every pair i <= j of the numbered features."""
    size = index.agg(F.count(F.lit(1)), F.max("n")).first()
    blocks = math.ceil(size[0] / block)
    samples = values.agg(F.approx_count_distinct("sample_id")).first()[0]
    chunks = max(1, math.ceil(samples / chunk))
    block = min(block, max(size[0], 1))

    cells = values.join(lookup_side(index.select("feature", "idx", "mean")), "feature").select(
        F.pmod(F.xxhash64("sample_id"), F.lit(chunks)).alias("chunk"), "sample_id", "idx",
        (F.col("value") - F.col("mean")).alias("value"),
    )
    own = F.expr(f"CAST(idx div {block} AS INT)")
    if blocks > 1:
        # cells are about to be copied to every block pair: pack them, a block of a sample per row
        cells = cells.groupBy("chunk", "sample_id", own.alias("own")).agg(
            F.collect_list(F.struct("idx", "value")).alias("cells")
        ).select("chunk", "sample_id", "own", F.col("cells.idx").alias("idx"),
                 F.col("cells.value").alias("value"))
        own = F.col("own")
    # a block meets every block once: as the left side of later ones, as the right of earlier ones
    partners = F.transform(
        F.sequence(F.lit(0), F.lit(max(blocks - 1, 0))),
        lambda other: F.struct(
            F.least(own, other).alias("left"), F.greatest(own, other).alias("right")),
    )
    placed = cells.withColumn("pair", F.explode(partners)).select(
        F.col("pair.left").alias("left"), F.col("pair.right").alias("right"), "chunk",
        "sample_id", "idx", "value",
    )
    partial = placed.groupBy("left", "right", "chunk").applyInPandas(
        _block_moments(block, size[0], blocks > 1), _SCHEMA)
    return partial.groupBy("i", "j").agg(
        *[F.sum(name).alias(name) for name in _MOMENTS],
        F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"),
        F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"),
    )


def _named(pairs: DataFrame, index: DataFrame) -> DataFrame:
    names = lookup_side(index.select("idx", "feature", "mean"))
    left = names.select(F.col("idx").alias("i"), F.col("feature").alias("feature_x"),
                        F.col("mean").alias("centre_x"))
    right = names.select(F.col("idx").alias("j"), F.col("feature").alias("feature_y"),
                         F.col("mean").alias("centre_y"))
    return pairs.join(left, "i").join(right, "j")


def aligned_pairs(values: DataFrame, block: int = BLOCK_FEATURES, chunk: int = CHUNK_SAMPLES
                  ) -> DataFrame:
    """What pairwise deletion leaves of every pair: common samples and the means over them.

    A pair without common samples has n = 0 and null means.
    """
    values = finite_only(values)
    index = feature_index(values)
    pairs = _named(pair_moments(values, index, block, chunk), index)
    return pairs.select(
        "feature_x", "feature_y", "n",
        (F.col("centre_x") + F.try_divide("sx", "n")).alias("mean_x"),
        (F.col("centre_y") + F.try_divide("sy", "n")).alias("mean_y"),
    )


def _coefficient() -> Column:
    n = F.when(F.col("n") > 0, F.col("n"))
    shared = F.col("sxy") - F.col("sx") * F.col("sy") / n
    spread_x = F.col("sxx") - F.col("sx") * F.col("sx") / n
    spread_y = F.col("syy") - F.col("sy") * F.col("sy") / n
    r = F.try_divide(shared, F.sqrt(spread_x) * F.sqrt(spread_y))
    return _clamped(r)


def _clamped(r: Column) -> Column:
    """r within [-1, 1]; NaN stays NaN, which least and greatest would take for the largest."""
    return F.when(F.isnan(r), r).when(r > 1, F.lit(1.0)).when(r < -1, F.lit(-1.0)).otherwise(r)


def _degenerate() -> Column:
    """Too few common samples, or a side without variation: no correlation is defined."""
    return (
        (F.col("n") <= 2) | (F.col("min_x") == F.col("max_x"))
        | (F.col("min_y") == F.col("max_y"))
    )


def _finish(pairs: DataFrame) -> DataFrame:
    """(feature_x, feature_y, n, r, degenerate) with i <= j to the full matrix with p."""
    pairs = pairs.withColumn(
        "r", F.when(F.col("degenerate"), F.lit(0.0))
        .when(F.col("feature_x") == F.col("feature_y"), F.lit(1.0)).otherwise(F.col("r")))
    p = F.when(F.col("degenerate"), F.lit(0.0)).otherwise(correlation_p("r", "n"))
    pairs = pairs.withColumn("p", p)
    sides = F.when(
        F.col("feature_x") == F.col("feature_y"),
        F.array(F.struct(F.col("feature_x").alias("x"), F.col("feature_y").alias("y"))),
    ).otherwise(F.array(
        F.struct(F.col("feature_x").alias("x"), F.col("feature_y").alias("y")),
        F.struct(F.col("feature_y").alias("x"), F.col("feature_x").alias("y")),
    ))
    return pairs.select(F.explode(sides).alias("side"), "n", "r", "p", "degenerate").select(
        F.col("side.x").alias("feature_x"), F.col("side.y").alias("feature_y"),
        "n", "r", "p", "degenerate",
    )


def pearson_matrix(values: DataFrame, block: int = BLOCK_FEATURES, chunk: int = CHUNK_SAMPLES
                   ) -> DataFrame:
    """(feature_x, feature_y, n, r, p, degenerate) for all ordered pairs, self pairs included. Of a
    repeated feature and sample the largest value counts, whatever the order of rows."""
    values = finite_only(values)
    index = feature_index(values)
    pairs = _named(pair_moments(values, index, block, chunk), index)
    return _finish(pairs.select(
        "feature_x", "feature_y", "n", _coefficient().alias("r"), _degenerate().alias("degenerate")
    ))


def spearman_matrix(values: DataFrame, block: int = SPEARMAN_BLOCK, chunk: int = SPEARMAN_CHUNK,
                    piece_rows: int = PIECE_ROWS) -> DataFrame:
    """As `pearson_matrix`, on ranks taken among the samples both features have; ties get the mean
    rank. Of a repeated feature and sample the largest value counts."""
    # written out, as several jobs read it
    values = kept(one_per_cell(finite_only(values)))
    numbered = number_features(values)
    pairs = rank_moments(values, numbered, block, chunk, piece_rows)
    pairs = _named(pairs, numbered.withColumn("mean", F.lit(0.0)))
    return _finish(pairs.select(
        "feature_x", "feature_y", "n", _coefficient().alias("r"), _degenerate().alias("degenerate")
    ))


def heatmap_cells(matrix: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(row, col, feature_x, feature_y, cell): positions in name order, values under 0.001 as 0.

    `features` (feature) names the rows where the caller has them at hand; otherwise they are read
    off the diagonal, which evaluates `matrix` once more. Nothing of the matrix is written out.
    """
    if features is None:
        features = matrix.where("feature_x = feature_y").select(F.col("feature_x").alias("feature"))
    # the numbering window runs over one row per feature
    order = features.select(F.col("feature").alias("label")).distinct().select(
        "label", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint").alias("pos"))
    order = lookup_side(order)
    rows = order.select(F.col("label").alias("feature_x"), F.col("pos").alias("row"))
    cols = order.select(F.col("label").alias("feature_y"), F.col("pos").alias("col"))
    cell = F.when(F.col("r") < 0.001, F.lit(0.0)).otherwise(F.col("r"))
    return matrix.join(rows, "feature_x").join(cols, "feature_y").select(
        "row", "col", "feature_x", "feature_y", cell.alias("cell"))
