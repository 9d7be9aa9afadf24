"""Two-sided Fisher test of 2x2 tables as native expressions.

The overlap x of a set of `marked` items with a list of `drawn` ones is hypergeometric. Its
likelihoods are summed from a start outwards by the ratio of neighbours, relative to that start, in
blocks of `aggregate`; a bisection over logs finds beforehand how many terms can count. Nothing is
cut off that a double could show, and no factorial of a margin is formed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.special import let, number

# Tables as likely as the observed one up to this share count as equally extreme.
TIE_TOLERANCE = 1e-7
# Terms per block, and the log of the share at which terms no longer count.
BLOCK, NEGLIGIBLE = 4096, -60.0
# Up to here logs of factorials come from a table, computed by summing logs.
TABLE = 64
LOG_FACTORIALS = [math.fsum(math.log(k) for k in range(2, n + 1)) for n in range(TABLE + 1)]


def _log_factorial_ratio(a: str, b: str) -> str:
    """ln(a! / b!). Differences of Stirling's series keep the digits that two log-gammas lose."""
    table = "array(" + ", ".join(number(v) for v in LOG_FACTORIALS) + ")"

    def rest(x: str) -> str:
        return f"(1 - (1 - (2D / 7 - 3D / (14 * {x} * {x})) / ({x} * {x})) / (30 * {x} * {x})) / (12 * {x})"

    def difference(x: str, y: str) -> str:
        return (f"(({x} - {y}) * (ln({x}) - 1) + ({y} + 0.5D) * log1p(({x} - {y}) / {y}) "
                f"+ {rest(x)} - {rest(y)})")

    def small(x: str) -> str:
        return f"get({table}, CAST(least({x}, {TABLE}) AS INT))"

    large = let(difference, f"CAST(greatest({a}, {TABLE}) AS DOUBLE)", f"CAST(greatest({b}, {TABLE}) AS DOUBLE)")
    return f"({large} + {small(a)} - {small(b)})"


def _log_ratio(x: str, y: str) -> str:
    """Log of how much likelier the overlap x is than y."""
    pairs = ((x, y), (f"(marked - {x})", f"(marked - {y})"), (f"(drawn - {x})", f"(drawn - {y})"),
             (f"(rest + {x})", f"(rest + {y})"))
    return "(-(" + " + ".join(_log_factorial_ratio(a, b) for a, b in pairs) + "))"


def _first_step(start: str, step: str, limit: str, base: str, bound: str) -> str:
    """Fewest steps from `start` after which an overlap is no more than exp(bound) times as likely as
    `base`, if `limit` steps suffice for that, else `limit`. Likelihoods fall along these steps."""
    at = _log_ratio(f"({start} + {step} * ((s.near + s.far) div 2))", base)
    halve = (f"CASE WHEN s.far - s.near <= 1 THEN s WHEN {at} > {bound} "
             f"THEN named_struct('near', (s.near + s.far) div 2, 'far', s.far) "
             f"ELSE named_struct('near', s.near, 'far', (s.near + s.far) div 2) END")
    rounds = f"sequence(1, CAST(ceil(log2({limit} + 1D)) AS INT) + 1)"
    first = f"named_struct('near', 0L, 'far', {limit})"
    return f"aggregate({rounds}, {first}, (s, i) -> {halve}, s -> s.far)"


def _outward(start: str, step: str, reach: str) -> str:
    """Likelihoods of `start` and of `reach` overlaps behind it, relative to that of `start`."""
    def ratio(x: str) -> str:
        up = f"(marked - {x}) * (drawn - {x}) / (({x} + 1) * (rest + {x} + 1))"
        down = f"{x} * (rest + {x}) / ((marked - {x} + 1) * (drawn - {x} + 1))"
        return f"(CASE WHEN {step} > 0 THEN {up} ELSE {down} END)"

    next_ratio = let(ratio, f"CAST({start} + {step} * (block * {BLOCK} + i - 1) AS DOUBLE)")
    following = let(lambda term: f"named_struct('term', {term}, 'total', t.total + {term})", f"t.term * {next_ratio}")
    inner = (f"aggregate(sequence(1L, {BLOCK}L), s, (t, i) -> "
             f"CASE WHEN block * {BLOCK} + i <= {reach} THEN {following} ELSE t END)")
    return (f"aggregate(sequence(0L, greatest({reach} - 1, 0L) div {BLOCK}), named_struct('term', 1D, 'total', 1D), "
            f"(s, block) -> {inner}, s -> s.total)")


def with_fisher(tables: DataFrame) -> DataFrame:
    """Add `p` and `log10_p` to tables (a, b, c, d): the share of all tables with these margins that
    are no likelier than this one. 1 where a margin is empty, null where a cell is."""
    columns = tables.columns
    tie = number(math.log1p(TIE_TOLERANCE))
    staged = tables.selectExpr(
        "*", "CAST(a AS BIGINT) AS overlap", "CAST(a + c AS BIGINT) AS marked", "CAST(a + b AS BIGINT) AS drawn",
        "CAST(d - a AS BIGINT) AS rest")
    # the product of two margins may leave a long
    peak = ("CAST((CAST(marked + 1 AS DECIMAL(19, 0)) * CAST(drawn + 1 AS DECIMAL(19, 0))) "
            "div CAST(marked + drawn + rest + 2 AS DECIMAL(19, 0)) AS BIGINT)")
    staged = staged.selectExpr("*", "greatest(0L, -rest) AS low", "least(marked, drawn) AS high").selectExpr(
        "*", f"least(greatest({peak}, low), high) AS mode").selectExpr(
        "*", "CASE WHEN overlap >= mode THEN 1L ELSE -1L END AS side",
        "CASE WHEN overlap >= mode THEN high - overlap ELSE overlap - low END AS own_room",
        "CASE WHEN overlap >= mode THEN mode - low ELSE high - mode END AS far_room",
        f"{_log_ratio('mode', 'overlap')} AS lead")
    usual = f"lead <= {tie} OR low = high"  # nothing is likelier than this table
    end = _log_ratio("(mode - side * far_room)", "overlap")
    # the nearest overlap on the other side that is no likelier, if there is one
    staged = staged.selectExpr("*", f"CASE WHEN NOT ({usual}) AND {end} <= {tie} THEN mode - side * "
                               f"{_first_step('mode', '(-side)', 'far_room', 'overlap', tie)} END AS other")

    def reach(start: str, step: str, room: str) -> str:
        return _first_step(start, step, room, start, number(NEGLIGIBLE))

    staged = staged.selectExpr(
        "*", f"{reach('overlap', 'side', 'own_room')} AS own_reach",
        f"{reach('other', '(-side)', '(far_room - abs(other - mode))')} AS other_reach",
        f"{reach('mode', '1L', '(high - mode)')} AS up_reach",
        f"{reach('mode', '(-1L)', '(mode - low)')} AS down_reach")
    staged = staged.selectExpr(
        "*", f"{_outward('overlap', 'side', 'own_reach')} AS own_sum",
        f"CASE WHEN other IS NULL THEN 0D ELSE exp({_log_ratio('other', 'overlap')}) * "
        f"{_outward('other', '(-side)', 'other_reach')} END AS other_sum",
        f"{_outward('mode', '1L', 'up_reach')} + {_outward('mode', '(-1L)', 'down_reach')} - 1 AS whole")
    log_p = f"CASE WHEN a + b + c + d IS NULL THEN NULL WHEN {usual} THEN 0D ELSE least(0D, -lead + ln(own_sum + other_sum) - ln(whole)) END"
    return staged.selectExpr("*", f"{log_p} AS log_p").select(
        *columns, F.exp("log_p").alias("p"), (F.col("log_p") / math.log(10)).alias("log10_p"))
