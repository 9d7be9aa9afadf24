"""Special functions as native SQL expressions (Spark has no lgamma, erf or beta).

Arguments are SQL text: a column name or an expression over columns. A formula is put together as
one text and parsed once, which is much quicker than thousands of calls that build it piece by
piece. Two kinds live here. The normal distribution functions are evaluated once per data value, so
they are plain arithmetic that stays inside generated code; pass them simple columns. Everything
behind a p-value runs once per test, so it may use `aggregate` over a short `sequence` for a
recurrence. Factors of the form x^a / Gamma(a) are written as a deviance plus a Stirling remainder,
which keeps full relative accuracy when the counts are in the billions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_SQRT_2PI = 0.5 * math.log(2.0 * math.pi)
INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)

# Asymptotic series of ln Gamma, coefficients of 1/z, 1/z^3, 1/z^5, ...
STIRLING_SERIES = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]

# Rational approximation of the normal tail (Hart 1968), highest power first.
NORMAL_TAIL_NUM = [
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
NORMAL_TAIL_DEN = [
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]

# Normal quantile (Wichura 1988, AS 241), highest power first.
QUANTILE_CENTRE_NUM = [
    2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
    13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608,
]
QUANTILE_CENTRE_DEN = [
    5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
    5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0,
]
QUANTILE_MIDDLE_NUM = [
    7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
    1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
    4.6303378461565452959, 1.42343711074968357734,
]
QUANTILE_MIDDLE_DEN = [
    1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
    0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
    2.05319162663775882187, 1.0,
]
QUANTILE_FAR_NUM = [
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
    0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
    5.4637849111641143699, 6.6579046435011037772,
]
QUANTILE_FAR_DEN = [
    2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
    7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
    0.59983220655588793769, 1.0,
]



def number(x: float) -> str:
    return f"({float(x)!r}D)"


def double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


_depth = 0


def let(body: Callable[..., str], *values: str) -> str:
    """Evaluate `values` once per row and hand them to `body`; keeps nested formulas small."""
    global _depth
    _depth += 1
    try:
        name = f"s{_depth}"
        fields = ", ".join(f"'v{i}', {value}" for i, value in enumerate(values))
        inner = body(*[f"{name}.v{i}" for i in range(len(values))])
    finally:
        _depth -= 1
    return f"transform(array(named_struct({fields})), {name} -> {inner})[0]"


def horner(coefficients: Sequence[float], x: str) -> str:
    total = number(coefficients[0])
    for coefficient in coefficients[1:]:
        total = f"({total} * {x} + {number(coefficient)})"
    return total


# ---------------------------------------------------------------------------------- normal


def _normal_tail(size: str) -> str:
    """P(Z < -size) for size >= 0."""
    density = f"exp(-{size} * {size} / 2)"
    rational = f"{density} * {horner(NORMAL_TAIL_NUM, size)} / {horner(NORMAL_TAIL_DEN, size)}"
    fraction = f"({size} + 0.65D)"
    for k in (4, 3, 2, 1):
        fraction = f"({size} + {k} / {fraction})"
    far = f"{density} / {fraction} * {number(INV_SQRT_2PI)}"
    return f"(CASE WHEN {size} < 7.07106781186547D THEN {rational} ELSE {far} END)"


def normal_cdf(z: str) -> Column:
    tail = _normal_tail(f"abs({z})")
    return F.expr(f"CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END")


def with_log_normal_cdf(df: DataFrame, z: Column, low: str, high: str) -> DataFrame:
    """Add `low` = ln P(Z < z) and `high` = ln P(Z > z), accurate far in both tails.

    Staged like the quantile below; both sides share one evaluation of the tail.
    """
    at, size, tail, rare, rest = (f"{low}__{part}" for part in ("z", "size", "tail", "rare", "rest"))
    far = f"-{size} * {size} / 2 - ln({size}) - {number(LOG_SQRT_2PI)}"
    staged = df.select(
        "*", z.alias(at), F.expr(f"abs({at})").alias(size),
        F.expr(_normal_tail(size)).alias(tail),
        F.expr(f"CASE WHEN {size} > 37 THEN {far} ELSE ln({tail}) END").alias(rare),
        F.expr(f"log1p(-{tail})").alias(rest),
        F.expr(f"CASE WHEN {at} > 0 THEN {rest} ELSE {rare} END").alias(low),
        F.expr(f"CASE WHEN {at} > 0 THEN {rare} ELSE {rest} END").alias(high),
    )
    return staged.drop(at, size, tail, rare, rest)


def _quantile_ratio(numerator: Sequence[float], denominator: Sequence[float], step: str) -> str:
    return f"{horner(numerator, step)} / {horner(denominator, step)}"


def normal_quantile(p: str) -> str:
    """Normal quantile as text, for the few rows of a rare case; see `with_normal_quantile`."""

    def outer(p: str, offset: str) -> str:
        def tails(depth: str) -> str:
            middle = let(lambda r: _quantile_ratio(QUANTILE_MIDDLE_NUM, QUANTILE_MIDDLE_DEN, r),
                         f"{depth} - 1.6D")
            far = let(lambda r: _quantile_ratio(QUANTILE_FAR_NUM, QUANTILE_FAR_DEN, r),
                      f"{depth} - 5")
            return f"sign({offset}) * (CASE WHEN {depth} <= 5 THEN {middle} ELSE {far} END)"

        centre = let(lambda r: _quantile_ratio(QUANTILE_CENTRE_NUM, QUANTILE_CENTRE_DEN, r),
                     f"0.180625D - {offset} * {offset}")
        tail = let(tails, f"sqrt(-ln(least({p}, 1 - {p})))")
        return f"CASE WHEN abs({offset}) <= 0.425D THEN {offset} * {centre} ELSE {tail} END"

    return let(lambda p: let(outer, p, f"{p} - 0.5D"), p)


def with_normal_quantile(df: DataFrame, p: Column, name: str) -> DataFrame:
    """Add column `name` = the normal quantile of `p`.

    The shared sub-terms are staged as columns of their own: one short generated method per row
    instead of one too long for the JIT compiler.
    """
    prob, offset, reach, step = (f"{name}__{part}" for part in ("p", "offset", "reach", "step"))
    central, near = f"abs({offset}) <= 0.425D", f"{reach} <= 5"

    # later columns refer to earlier ones of the same select (lateral column aliases)
    staged = df.select(
        "*", p.alias(prob), F.expr(f"{prob} - 0.5D").alias(offset),
        F.expr(f"CASE WHEN {central} THEN 0.180625D - {offset} * {offset} "
               f"ELSE sqrt(-ln(least({prob}, 1 - {prob}))) END").alias(reach),
        F.expr(f"CASE WHEN {central} THEN {reach} WHEN {near} THEN {reach} - 1.6D "
               f"ELSE {reach} - 5 END").alias(step),
        F.expr(
            f"CASE WHEN {central} "
            f"THEN {offset} * {_quantile_ratio(QUANTILE_CENTRE_NUM, QUANTILE_CENTRE_DEN, step)} "
            f"WHEN {near} THEN sign({offset}) * {_quantile_ratio(QUANTILE_MIDDLE_NUM, QUANTILE_MIDDLE_DEN, step)} "
            f"ELSE sign({offset}) * {_quantile_ratio(QUANTILE_FAR_NUM, QUANTILE_FAR_DEN, step)} END").alias(name),
    )
    return staged.drop(prob, offset, reach, step)


# ---------------------------------------------------------------------------------- gamma


def _stirling_remainder(z: str) -> str:
    """ln Gamma(z) - ((z - 1/2) ln z - z + ln sqrt(2 pi)) for z > 0."""

    def series(inverse: str) -> str:
        return f"{inverse} * " + let(
            lambda square: horner(STIRLING_SERIES[::-1], square), f"{inverse} * {inverse}")

    def body(v: str) -> str:
        product = " * ".join(f"({v} + {k})" for k in range(8))
        raised = let(series, f"1 / ({v} + 8)")
        shifted = (
            f"{raised} + ({v} + 7.5D) * ln({v} + 8) - ({v} - 0.5D) * ln({v}) - 8 - ln({product})")
        return f"CASE WHEN {v} >= 8 THEN {let(series, f'1 / {v}')} ELSE {shifted} END"

    return let(body, double(z))


def log_gamma(z: str) -> Column:
    return F.expr(let(
        lambda v: f"({v} - 0.5D) * ln({v}) - {v} + {number(LOG_SQRT_2PI)} + "
                  f"{_stirling_remainder(v)}",
        double(z)))


# ------------------------------------------------------------------- incomplete beta, gamma

_TINY = 1e-300


def _unit_fraction(numerators: str) -> str:
    """1 / (1 + n1/(1 + n2/(1 + ...))) by forward recurrence, denominators scaled to one."""
    raw = "(1 + n * s.pb)"
    update = let(
        lambda b: f"named_struct('pa', s.a / {b}, 'pb', 1 / {b}, 'a', (s.a + n * s.pa) / {b})",
        f"CASE WHEN abs{raw} < {number(_TINY)} THEN {number(_TINY)} ELSE {raw} END")
    return (f"aggregate({numerators}, named_struct('pa', 0D, 'pb', 1D, 'a', 1D), "
            f"(s, n) -> {update}, s -> s.a)")


def _beta_fraction(a: str, b: str, x: str) -> str:
    odd = f"-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1))"
    even = (f"(m + 1) * ({b} - m - 1) * {x} / (({a} + 2 * m + 1) * ({a} + 2 * m + 2))")
    # The steps needed grow with the root of the harmonic size; the factors were measured.
    pairs = f"CAST(50 + ceil(1.5D * sqrt({a} * {b} / ({a} + {b}))) AS INT)"
    return _unit_fraction(f"flatten(transform(sequence(0, {pairs}), m -> array({odd}, {even})))")


def _log_beta_kernel(a: str, b: str, x: str, y: str) -> str:
    """ln( x^a y^b / B(a, b) ) with y = 1 - x."""
    remainder = " - ".join(_stirling_remainder(z) for z in (f"{a} + {b}", a, b))
    return let(
        lambda gap: f"{a} * log1p({gap} / {a}) + {b} * log1p(-{gap} / {b}) + "
                    f"0.5D * ln({a} * {b} / ({a} + {b})) - {number(LOG_SQRT_2PI)} + {remainder}",
        f"{b} * {x} - {a} * {y}")


def _beta_cdf(a: str, b: str, x: str, y: str) -> str:
    """Regularised incomplete beta I_x(a, b) with y = 1 - x."""

    def body(a: str, b: str, x: str, y: str) -> str:
        return let(
            lambda kernel: (
                f"CASE WHEN {x} <= 0 THEN 0D WHEN {y} <= 0 THEN 1D "
                f"WHEN {x} < ({a} + 1) / ({a} + {b} + 2) "
                f"THEN {kernel} * {_beta_fraction(a, b, x)} / {a} "
                f"ELSE 1 - {kernel} * {_beta_fraction(b, a, y)} / {b} END"),
            f"exp({_log_beta_kernel(a, b, x, y)})")

    return let(body, *[double(v) for v in (a, b, x, y)])


def beta_cdf(a: str, b: str, x: str, complement: str | None = None) -> Column:
    """Regularised incomplete beta I_x(a, b); `complement` = 1 - x when known more exactly."""
    return F.expr(_beta_cdf(a, b, x, f"1 - ({x})" if complement is None else complement))


def _gamma_sf(a: str, x: str) -> str:
    """Regularised upper incomplete gamma Q(a, x)."""

    def body(a: str, x: str) -> str:
        gap = f"({x} - {a})"
        # x^a e^-x / Gamma(a + 1)
        kernel = (f"exp({a} * log1p({gap} / {a}) - {gap} - {_stirling_remainder(a)} "
                  f"- 0.5D * ln({a}) - {number(LOG_SQRT_2PI)})")
        steps = f"sequence(1, CAST(200 + ceil(12 * sqrt({a})) AS INT))"
        series = (
            f"aggregate({steps}, named_struct('term', 1D, 'total', 1D), (s, k) -> "
            f"named_struct('term', s.term * {x} / ({a} + k), "
            f"'total', s.total + s.term * {x} / ({a} + k)), s -> s.total)")
        base = f"({x} + 1 - {a})"
        fraction = _unit_fraction(
            f"transform({steps}, k -> -k * (k - {a}) / "
            f"(({base} + 2 * k - 2) * ({base} + 2 * k)))")
        return (
            f"CASE WHEN {x} <= 0 THEN 1D "
            f"WHEN {x} < {a} + 1 THEN greatest(1 - {kernel} * {series}, 0D) "
            f"ELSE {kernel} * {a} * {fraction} / {base} END")

    return let(body, double(a), double(x))


# ---------------------------------------------------------------------------------- p-values


def chi_square_sf(statistic: str, df: str) -> Column:
    return F.expr(_gamma_sf(f"({df}) / 2", f"({statistic}) / 2"))


def f_sf(statistic: str, df_between: str, df_within: str) -> Column:
    return F.expr(let(
        lambda part, d1, d2: _beta_cdf(
            f"{d2} / 2", f"{d1} / 2", f"{d2} / ({d2} + {part})", f"{part} / ({d2} + {part})"),
        double(f"({statistic}) * ({df_between})"), double(df_between), double(df_within)))


def correlation_p(r: str, n: str) -> Column:
    """Two-sided p of a correlation r over n pairs (Student t with n - 2 degrees of freedom)."""
    return F.expr(let(
        lambda r, n: _beta_cdf(f"({n} - 2) / 2", "0.5D", f"(1 - {r}) * (1 + {r})", f"{r} * {r}"),
        double(r), double(n)))


def fair_binomial_p(k: str, n: str) -> Column:
    """Exact two-sided p for k of n successes at probability 1/2."""

    def body(low: str, n: str) -> str:
        tail = _beta_cdf(f"{n} - {low}", f"{low} + 1", "0.5D", "0.5D")
        return f"CASE WHEN 2 * {low} = {n} THEN 1D ELSE least(2 * {tail}, 1D) END"

    return F.expr(let(body, double(f"least({k}, ({n}) - ({k}))"), double(n)))


def kolmogorov_p(distance: str, n: str) -> Column:
    """Asymptotic two-sided p of a Kolmogorov-Smirnov distance over n values."""

    def tail(scaled: str) -> str:
        total = (
            "aggregate(sequence(1, 100), 0D, (total, j) -> total + "
            f"(CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END) * exp(-2D * j * j * {scaled} * {scaled}))")
        return f"CASE WHEN {scaled} < 0.2D THEN 1D ELSE least(greatest({total}, 0D), 1D) END"

    return F.expr(let(
        lambda d, root: let(tail, f"({root} + 0.12D + 0.11D / {root}) * {d}"),
        double(distance), f"sqrt({double(n)})"))


def exact_kolmogorov_p(distance: str, n: str) -> Column:
    """P(D >= distance) for n values of a continuous distribution, n at most 80.

    The probability that an empirical distribution stays within the distance is an entry of the nth
    power of a matrix of order 2k - 1, k = ceil(n distance) (Marsaglia, Tsang and Wang 2003). The
    power is applied to a vector step by step, each step taking its share t / n of n! / n^n, so that
    nothing leaves the range of a double.
    """
    inverse = "array(" + ", ".join(number(1 / math.factorial(j)) for j in range(161)) + ")"

    def power(k: str, h: str, count: str) -> str:
        order = f"(2 * {k} - 1)"
        places = f"sequence(0, {order} - 1)"
        cell = (f"((CASE WHEN i - j + 1 < 0 THEN 0D ELSE 1D END) - (CASE WHEN j = 0 THEN pow({h}, i + 1) ELSE 0D END) "
                f"- (CASE WHEN i = {order} - 1 THEN pow({h}, {order} - j) ELSE 0D END) "
                f"+ (CASE WHEN j = 0 AND i = {order} - 1 AND 2 * {h} > 1 THEN pow(2 * {h} - 1, {order}) ELSE 0D END)) "
                f"* get({inverse}, greatest(i - j + 1, 0))")
        matrix = f"transform({places}, i -> transform({places}, j -> {cell}))"

        def steps(rows: str) -> str:
            row = "aggregate(zip_with(r, v, (x, y) -> x * y), 0D, (total, x) -> total + x)"
            start = f"transform({places}, i -> CASE WHEN i = {k} - 1 THEN 1D ELSE 0D END)"
            return (f"aggregate(sequence(1, {count}), {start}, (v, t) -> transform({rows}, r -> t / {double(count)} * {row}), "
                    f"v -> get(v, {k} - 1))")

        return f"least(greatest(1 - {let(steps, matrix)}, 0D), 1D)"

    scaled = f"({double(n)} * {distance})"
    k = f"CAST(greatest(ceil({scaled}), 1) AS INT)"
    return F.expr(let(lambda first, all_, count: let(lambda k_, h: power(k_, h, count), first, f"{first} - {all_}"),
                      k, scaled, f"CAST({n} AS INT)"))
