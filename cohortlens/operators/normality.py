"""Shapiro-Wilk, Anderson-Darling and Kolmogorov-Smirnov statistics per feature.

All three need the order statistics of a feature. They are built from runs of equal values (see
`ranking`), so a value that fills most of a feature is one row, and everything after the ranking is
a partially aggregated sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.special import (
    INV_SQRT_2PI, double, horner, kolmogorov_p, let, normal_quantile, number, with_log_normal_cdf,
    with_normal_quantile,
)
from cohortlens.operators.observations import finite_only
from cohortlens.operators.ranking import TASK_ROWS, ranked_runs
from cohortlens.session import cut, lookup_side

# Smallest n of each step and the 5 % critical value of W from there on.
SHAPIRO_CRITICAL = [
    (5, 0.762), (6, 0.788), (7, 0.803), (8, 0.818), (9, 0.829), (10, 0.842), (11, 0.850),
    (12, 0.859), (13, 0.866), (14, 0.874), (15, 0.881), (16, 0.887), (17, 0.892), (18, 0.897),
    (19, 0.901), (20, 0.905), (25, 0.918), (30, 0.927), (35, 0.934), (40, 0.940), (50, 0.947),
]
# Anderson-Darling critical values for a normal with estimated mean and deviation.
ANDERSON_CRITICAL = {15.0: 0.576, 10.0: 0.656, 5.0: 0.787, 2.5: 0.918, 1.0: 1.092}
# Weights of the largest and second largest value (Royston 1995), highest power of
# 1/sqrt(n) first; the constant term is the normal score itself.
LARGEST_WEIGHT = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0]
SECOND_WEIGHT = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]

# Runs longer than this are summed in closed form instead of rank by rank.
LONG_RUN = 1024
# Ranks at either end that a closed form never covers: the scores bend too much there.
EDGE = 64


def shapiro_threshold(n: Column) -> Column:
    """Critical W for n values; null below 5."""
    steps = sorted(SHAPIRO_CRITICAL, reverse=True)
    rule = F.when(n >= steps[0][0], F.lit(steps[0][1]))
    for start, critical in steps[1:]:
        rule = rule.when(n >= start, F.lit(critical))
    return rule


def anderson_threshold(n: Column, level: float = 5.0) -> Column:
    """Critical A^2 for n values at a significance level in percent."""
    if level not in ANDERSON_CRITICAL:
        raise ValueError(f"level must be one of {sorted(ANDERSON_CRITICAL, reverse=True)}")
    correction = 1.0 + 4.0 / n - 25.0 / (n * n)
    return F.round(F.lit(ANDERSON_CRITICAL[level]) / correction, 3)


def order_totals(values: DataFrame) -> DataFrame:
    """(feature, n, mean, var_pop, min_value, max_value) of the finite values, fixed for the passes
    that follow."""
    value = F.col("value")
    return cut(finite_only(values).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.mean(value).alias("mean"),
        F.var_pop(value).alias("var_pop"), F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    ))


def runs_with_totals(values: DataFrame, totals: DataFrame, task_rows: int) -> DataFrame:
    runs = ranked_runs(finite_only(values), ["feature"], "value", totals, task_rows)
    return runs.join(lookup_side(totals), "feature")


def _score_probability(rank: Column, n: Column) -> Column:
    return (rank - 0.375) / (n + 0.25)


def _interior_moments(lo: str, hi: str, n: str) -> Column:
    """struct(scores, squares): sums of scores and squared scores over the ranks lo..hi.

    Euler-Maclaurin with half-integer ends; both ends must be EDGE ranks away from 1 and n. Only
    long runs need it, so it is lazy: rows that skip it pay nothing.
    """

    def sums(scale: str, pa: str, pb: str) -> str:
        return let(
            ends, scale, pa, pb, normal_quantile(pa), normal_quantile(pb))

    def ends(scale: str, pa: str, pb: str, za: str, zb: str) -> str:
        def slope(z: str) -> str:
            return f"{scale} * exp(-{z} * {z} / 2) * {number(INV_SQRT_2PI)}"

        return let(totals, scale, pa, pb, za, zb, slope(za), slope(zb))

    def totals(scale, pa, pb, za, zb, fa, fb) -> str:
        # f is scale * density; derivatives by rank of the score are 1/f and (1 + 2 z^2)/f^3,
        # those of its square 2z/f and (8z + 4z^3)/f^3
        scores = (
            f"{fa} - {fb} - (1 / {fb} - 1 / {fa}) / 24 + 7 * ((1 + 2 * {zb} * {zb}) / "
            f"pow({fb}, 3) - (1 + 2 * {za} * {za}) / pow({fa}, 3)) / 5760")
        squares = (
            f"{scale} * ({pb} - {pa}) - ({zb} * {fb} - {za} * {fa}) "
            f"- (2 * {zb} / {fb} - 2 * {za} / {fa}) / 24 "
            f"+ 7 * ((8 * {zb} + 4 * pow({zb}, 3)) / pow({fb}, 3) "
            f"- (8 * {za} + 4 * pow({za}, 3)) / pow({fa}, 3)) / 5760")
        return f"named_struct('scores', {scores}, 'squares', {squares})"

    text = let(
        lambda lo, hi, scale: let(
            sums, scale, f"({lo} - 0.875D) / {scale}", f"({hi} + 0.125D) / {scale}"),
        double(lo), double(hi), f"{double(n)} + 0.25D")
    return F.expr(f"CASE WHEN {lo} <= {hi} THEN {text} END")


def _ranks_one_by_one(lo: Column, hi: Column, n: Column, long_run: int) -> Column:
    """Ranks of lo..hi to score singly: all of a short run, the end ranks of a long one."""
    none = F.array().cast("array<bigint>")
    low_end = F.when(lo <= EDGE, F.sequence(lo, F.least(hi, F.lit(EDGE)))).otherwise(none)
    high_end = F.when(
        hi > n - EDGE, F.sequence(F.greatest(lo, n - EDGE + 1), hi)
    ).otherwise(none)
    return F.when(hi - lo < long_run, F.sequence(lo, hi)).otherwise(F.concat(low_end, high_end))


def _score_squares(totals: DataFrame, long_run: int) -> DataFrame:
    """(n, score_squares): sum of squared scores over the ranks 1..n."""
    n = F.col("n")
    sizes = totals.select("n").distinct()  # the scores do not depend on the values
    by_rank = sizes.select("n", F.explode(
        _ranks_one_by_one(F.lit(1).cast("bigint"), n, n, long_run)).alias("rank"))
    singles = with_normal_quantile(by_rank, _score_probability(F.col("rank"), n), "score")
    singles = singles.groupBy("n").agg(F.sum(F.col("score") * F.col("score")).alias("ends"))
    interior = F.when(n > long_run, _interior_moments(str(EDGE + 1), f"n - {EDGE}", "n"))
    return singles.select("n", (
        F.col("ends") + F.coalesce(interior["squares"], F.lit(0.0))).alias("score_squares"))


def shapiro_w(values: DataFrame, totals: DataFrame | None = None, task_rows: int = TASK_ROWS,
              long_run: int = LONG_RUN) -> DataFrame:
    """(feature, n, shapiro_w) by Royston's weights; null for fewer than 3 or constant values."""
    totals = order_totals(values) if totals is None else totals
    return _statistics(values, totals, task_rows, long_run).select("feature", "n", "shapiro_w")


def anderson_a2(values: DataFrame, totals: DataFrame | None = None, task_rows: int = TASK_ROWS
                ) -> DataFrame:
    """(feature, n, anderson_a2) for a normal with estimated mean and sample deviation."""
    totals = order_totals(values) if totals is None else totals
    runs = runs_with_totals(values, totals, task_rows).where(F.col("var_pop") > 0)
    sums = _with_anderson_term(runs).groupBy("feature").agg(F.sum("anderson_term").alias("total"))
    return totals.select("feature", "n").join(sums, "feature", "left").select(
        "feature", "n", (-F.col("n") - F.col("total") / F.col("n")).alias("anderson_a2")
    )


def _with_anderson_term(runs: DataFrame) -> DataFrame:
    n, below, run = (F.col(c).cast("double") for c in ("n", "below", "run"))
    deviation = F.sqrt(F.col("var_pop") * n / (n - 1.0))
    z = (F.col("value") - F.col("mean")) / deviation
    runs = with_log_normal_cdf(runs, z, "log_low", "log_high")
    # sums of 2i - 1 and 2(n - i) + 1 over the ranks of the run, as differences of squares
    rising = run * (2.0 * below + run)
    falling = run * (2.0 * (n - below) - run)
    term = rising * F.col("log_low") + falling * F.col("log_high")
    return runs.withColumn("anderson_term", term).drop("log_low", "log_high")


def _statistics(values: DataFrame, totals: DataFrame, task_rows: int, long_run: int) -> DataFrame:
    """Both normality statistics from one ranking of the values."""
    long_run = max(long_run, 2 * EDGE)
    n, below, run = F.col("n"), F.col("below"), F.col("run")
    runs = runs_with_totals(values, totals, task_rows).where(F.col("var_pop") > 0)
    runs = _with_anderson_term(runs)
    lo, hi = below + 1, below + run
    interior = F.when(run > long_run, _interior_moments(
        f"greatest(below + 1, {EDGE + 1})", f"least(below + run, n - {EDGE})", "n"))
    pieces = runs.select(
        "feature", "n", (F.col("value") - F.col("mean")).alias("x"), "anderson_term",
        F.coalesce(interior["scores"], F.lit(0.0)).alias("score_sum"),
        F.posexplode_outer(_ranks_one_by_one(lo, hi, n, long_run)).alias("nth", "rank"),
    )
    x, rank = F.col("x"), F.col("rank")
    leads = F.coalesce(F.col("nth"), F.lit(0)) == 0
    scored = with_normal_quantile(
        pieces, _score_probability(F.coalesce(rank, (n + 1) / 2.0), n), "score")
    single = F.when(rank.isNotNull(), F.col("score")).otherwise(F.lit(0.0))
    interior = F.when(leads, F.col("score_sum")).otherwise(F.lit(0.0))
    sums = scored.groupBy("feature").agg(
        F.sum(x * (single + interior)).alias("linear"),
        F.sum(F.when(leads, F.col("anderson_term"))).alias("anderson_total"),
        F.max(F.when(rank == 2, x)).alias("second"),
        F.max(F.when(rank == n - 1, x)).alias("last_but_one"),
    )
    squares = _score_squares(totals, long_run)
    return _assemble(totals.join(squares, "n", "left").join(sums, "feature", "left"))


def _assemble(joined: DataFrame) -> DataFrame:
    n = F.col("n")
    joined = with_normal_quantile(joined, _score_probability(n, n), "top")
    joined = with_normal_quantile(
        joined, _score_probability(F.greatest(n - 1, F.lit(1)), n), "next")
    top, nxt, squares = F.col("top"), F.col("next"), F.col("score_squares")
    root = F.when(squares > 0, F.sqrt(squares))
    joined = joined.withColumn("u", 1.0 / F.sqrt(n)).withColumn(
        "w_top", F.expr(horner(LARGEST_WEIGHT, "u")) + top / root
    ).withColumn("w_next", F.expr(horner(SECOND_WEIGHT, "u")) + nxt / root)
    w_top, w_next = F.col("w_top"), F.col("w_next")
    wide = n > 5
    phi = F.when(
        wide,
        F.try_divide(squares - 2.0 * top * top - 2.0 * nxt * nxt,
                     1.0 - 2.0 * w_top * w_top - 2.0 * w_next * w_next),
    ).otherwise(F.try_divide(squares - 2.0 * top * top, 1.0 - 2.0 * w_top * w_top))
    spread = F.col("max_value") - F.col("min_value")
    inner_spread = F.when(wide, F.col("last_but_one") - F.col("second")).otherwise(F.lit(0.0))
    rest = (F.col("linear") - top * spread - F.when(wide, nxt).otherwise(F.lit(0.0)) * inner_spread)
    weighted = w_top * spread + F.when(wide, w_next).otherwise(F.lit(0.0)) * inner_spread
    total = weighted + F.try_divide(rest, F.sqrt(phi))
    # three values have the exact weights sqrt(1/2), 0, -sqrt(1/2)
    total = F.when(n == 3, spread * 0.5 ** 0.5).otherwise(total)
    defined = (n >= 3) & (F.col("var_pop") > 0)
    w = total * total / (n * F.col("var_pop"))
    w = F.when(defined, F.when(w > 1, F.when(F.isnan(w), w).otherwise(F.lit(1.0))).otherwise(w))
    a2 = F.when(F.col("var_pop") > 0, -n - F.col("anderson_total") / n)
    return joined.select("feature", "n", w.alias("shapiro_w"), a2.alias("anderson_a2"))


def normality(values: DataFrame, level: float = 5.0, totals: DataFrame | None = None,
              task_rows: int = TASK_ROWS, long_run: int = LONG_RUN) -> DataFrame:
    """Both statistics, their critical values and the verdict `normal` or `unknown`."""
    totals = order_totals(values) if totals is None else totals
    n = F.col("n")
    # One row per feature, written out: a filter on the verdict would otherwise be pushed through
    # the long formulas above it and copy them many times over.
    stats = cut(_statistics(values, totals, task_rows, long_run))
    stats = stats.withColumn("anderson_critical", anderson_threshold(n, level)).withColumn(
        "shapiro_critical", shapiro_threshold(n))
    normal = (F.col("anderson_a2") < F.col("anderson_critical")) & (
        F.col("shapiro_w") > F.coalesce("shapiro_critical", F.lit(float("-inf"))))
    return stats.withColumn(
        "distribution",
        F.when(F.coalesce(normal, F.lit(False)), F.lit("normal")).otherwise(F.lit("unknown")),
    )


def ks_uniform(values: DataFrame, alpha: float = 0.05, totals: DataFrame | None = None,
               task_rows: int = TASK_ROWS) -> DataFrame:
    """Distance of each feature from the uniform distribution on its own range."""
    totals = order_totals(values) if totals is None else totals
    runs = runs_with_totals(values, totals, task_rows)
    runs = runs.where(F.col("max_value") > F.col("min_value"))
    n = F.col("n")
    expected = (F.col("value") - F.col("min_value")) / (F.col("max_value") - F.col("min_value"))
    gap = F.greatest(
        (F.col("below") + F.col("run")) / n - expected, expected - F.col("below") / n)
    found = runs.groupBy("feature").agg(F.max(gap).alias("ks_d"), F.max("n").alias("n"))
    p = kolmogorov_p("ks_d", "n")
    return found.select("feature", "n", "ks_d", p.alias("ks_p")).withColumn(
        "distribution",
        F.when(F.col("ks_p") >= alpha, F.lit("uniform")).otherwise(F.lit("unknown")),
    )
