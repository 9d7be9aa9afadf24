"""Ranks within groups of any size.

A window over one group is one task. That is fine while the largest group is known to be small;
beyond it the value range of the large groups is divided at approximate quantiles, each piece is
ranked on its own, and piece counts are turned into offsets. The quantiles only decide where the
pieces end, so the ranks are exact; they are written out once, so every stage and every retry
sees the same division.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import cut, lookup_side

# Most rows of one group that a single ranking task should sort.
TASK_ROWS = 4_000_000


def _largest(totals: DataFrame) -> int:
    return totals.agg(F.max("n")).first()[0] or 0


def _division_points(rows: DataFrame, keys: list[str], value: str, totals: DataFrame,
                     largest: int, task_rows: int) -> tuple[DataFrame, int]:
    pieces = math.ceil(largest / task_rows)
    large = totals.where(F.col("n") > task_rows).select(*keys)
    points = (
        rows.join(large, keys, "left_semi").groupBy(*keys)
        .agg(F.percentile_approx(value, [i / pieces for i in range(1, pieces)], 4 * pieces + 100)
             .alias("points"))
    )
    # how many division points equal each one
    widths = F.transform("points", lambda p: F.size(F.filter("points", lambda q: q == p)))
    return cut(points.withColumn("widths", widths)), pieces


def _piece(points: Column, value: Column, pieces: int) -> Column:
    """Number of division points below `value`, by binary search; 0 for small groups."""
    steps = [2 ** k for k in range(max(pieces, 1).bit_length() - 1, -1, -1)]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda lo, step: F.when(
            (lo + step <= F.size(points))
            & (F.get(points, F.least(lo + step, F.size(points)) - 1) < value),
            lo + step,
        ).otherwise(lo),
    )
    return F.when(points.isNull(), F.lit(0)).otherwise(found)


def ranked_runs(rows: DataFrame, keys: list[str], value: str, totals: DataFrame,
                task_rows: int = TASK_ROWS) -> DataFrame:
    """Equal values collapsed: (keys, value, run, below).

    `run` is how often the value occurs in its group and `below` how many rows are smaller, so it
    covers ranks below + 1 .. below + run. `totals` holds (keys, n).
    """
    runs = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("run"))
    largest = _largest(totals)
    if largest <= task_rows:
        before = Window.partitionBy(*keys).orderBy(value).rowsBetween(
            Window.unboundedPreceding, -1)
        below = F.coalesce(F.sum("run").over(before), F.lit(0))
        return runs.select(*keys, value, "run", below.alias("below"))

    points, pieces = _division_points(rows, keys, value, totals, largest, task_rows)
    placed = runs.join(lookup_side(points), keys, "left").select(
        *keys, value, "run", _piece(F.col("points"), F.col(value), pieces).alias("piece")
    )
    per_piece = placed.groupBy(*keys, "piece").agg(F.sum("run").alias("piece_rows"))
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_piece.select(
        *keys, "piece", F.coalesce(F.sum("piece_rows").over(earlier), F.lit(0)).alias("offset")
    )
    before = Window.partitionBy(*keys, "piece").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    within = placed.withColumn("within", F.coalesce(F.sum("run").over(before), F.lit(0)))
    return within.join(offsets, [*keys, "piece"]).select(
        *keys, value, "run", (F.col("within") + F.col("offset")).alias("below")
    )


def with_pieces(rows: DataFrame, keys: list[str], value: str, totals: DataFrame,
                task_rows: int = TASK_ROWS) -> tuple[DataFrame, int]:
    """(rows with `piece`, `full` and `width`, pieces of the largest group): pieces of large groups in
    value order; `full` marks rows whose value fills more than a whole piece, the greatest of its
    piece, and `width` is then about how many pieces it fills, otherwise 0."""
    largest = _largest(totals)
    if largest <= task_rows:
        return rows.withColumns({"piece": F.lit(0), "full": F.lit(False), "width": F.lit(0)}), 1
    points, pieces = _division_points(rows, keys, value, totals, largest, task_rows)
    placed = rows.join(lookup_side(points), keys, "left").withColumn(
        "piece", _piece(F.col("points"), F.col(value), pieces))
    # a value that is two neighbouring division points
    full = (F.get("points", F.col("piece")) == F.col(value)) & (
        F.get("points", F.col("piece") + 1) == F.col(value))
    placed = placed.withColumn("full", F.coalesce(full, F.lit(False)))
    width = F.when(F.col("full"), F.get("widths", F.col("piece"))).otherwise(F.lit(0))
    return placed.withColumn("width", width).drop("points", "widths"), pieces


def average_ranks(rows: DataFrame, keys: list[str], value: str, totals: DataFrame, name: str,
                  task_rows: int = TASK_ROWS) -> DataFrame:
    """Every row with the mean rank of its value among the group.

    Rows of large groups are ranked piece by piece. A value that fills a piece of its own needs no
    ranking, only the counts of pieces, so its rows stay spread as they are.
    """
    columns = rows.columns
    placed, pieces = with_pieces(rows, keys, value, totals, task_rows)
    piece = [*keys, "piece"]

    def ranked() -> Column:
        ties = F.count(F.lit(1)).over(Window.partitionBy(*piece, value))
        return F.rank().over(Window.partitionBy(*piece).orderBy(value)) + (ties - 1) / 2.0

    if pieces == 1:
        return placed.withColumn(name, ranked()).select(*columns, name)
    counts = placed.groupBy(*piece, "full").agg(F.count(F.lit(1)).alias("piece_rows"))
    earlier = Window.partitionBy(*keys).orderBy("piece", "full").rowsBetween(Window.unboundedPreceding, -1)
    counts = lookup_side(cut(counts.withColumn("before", F.coalesce(F.sum("piece_rows").over(earlier), F.lit(0)))))
    within = placed.where(~F.col("full"))
    within = within.withColumn("_rank", ranked()).join(counts, [*piece, "full"])
    alone = placed.where("full").join(counts, [*piece, "full"])
    return within.select(*columns, (F.col("before") + F.col("_rank")).alias(name)).unionByName(
        alone.select(*columns, (F.col("before") + (F.col("piece_rows") + 1) / 2.0).alias(name)))
