import math
from decimal import Decimal, localcontext
from fractions import Fraction

import pytest

from cohortlens.operators import correction as C
from cohortlens.operators import enrichment as E


def brute_fisher(a, b, c, d):
    marked, drawn, total = a + c, a + b, a + b + c + d
    lo, hi = max(0, marked + drawn - total), min(marked, drawn)
    pmf = {x: Fraction(math.comb(marked, x) * math.comb(total - marked, drawn - x),
                       math.comb(total, drawn)) for x in range(lo, hi + 1)}
    limit = pmf[a] * (1 + Fraction(1, 10 ** 7))
    return float(sum(p for p in pmf.values() if p <= limit))


TABLES = [
    (3, 1, 1, 3), (0, 5, 7, 9), (5, 0, 0, 5), (1, 9, 11, 3), (8, 2, 1, 5), (0, 0, 3, 4),
    (4, 0, 6, 0), (10, 10, 10, 10), (2, 30, 28, 900), (40, 60, 100, 3000), (0, 50, 40, 500),
    (300, 200, 250, 1200), (58, 1327, 15, 600), (1, 0, 0, 1), (7, 3, 3, 7), (150, 150, 150, 150),
]


def test_fisher(spark):
    rows = spark.createDataFrame([(str(i), *t) for i, t in enumerate(TABLES)],
                                 "pathway string, a bigint, b bigint, c bigint, d bigint")
    got = {r["pathway"]: r for r in E.fisher_tests(rows).collect()}
    for i, table in enumerate(TABLES):
        assert got[str(i)]["p"] == pytest.approx(brute_fisher(*table), rel=1e-9), table
    assert got["0"]["p"] == pytest.approx(0.4857142857, abs=1e-9)
    assert got["0"]["odds_ratio"] == 9.0
    assert got["2"]["odds_ratio"] == float("inf")
    assert math.isnan(got["5"]["odds_ratio"]) and got["5"]["p"] == 1.0


def test_fisher_large_counts(spark):
    n, m, total = 10 ** 6, 10 ** 6, 10 ** 9
    k = 1095
    row = spark.createDataFrame([("x", k, n - k, m - k, total - n - m + k)],
                                "pathway string, a bigint, b bigint, c bigint, d bigint")
    g = math.lgamma

    def log_pmf(x):
        return (g(m + 1) - g(x + 1) - g(m - x + 1) + g(total - m + 1) - g(n - x + 1)
                - g(total - m - n + x + 1) - g(total + 1) + g(n + 1) + g(total - n + 1))

    want = sum(math.exp(log_pmf(x)) for x in range(400, 1800) if log_pmf(x) <= log_pmf(k) + 1e-7)
    assert E.fisher_tests(row).first()["p"] == pytest.approx(want, rel=1e-4)
    # an impossible overlap for chance underflows to zero; its log does not
    far = E.fisher_tests(spark.createDataFrame([("x", 50_000, 50_000, 50_000, 10 ** 9)], row.schema)).first()
    assert far["p"] == 0.0 and -300_000 < far["log10_p"] < -100_000


def exact_log10(a, b, c, d):
    """Sum of all likelihoods by their ratios, in decimals of 60 digits."""
    marked, drawn, rest = a + c, a + b, d - a
    with localcontext() as context:
        context.prec, context.Emin, context.Emax = 60, -10 ** 9, 10 ** 9
        weights, w = {a: Decimal(1)}, Decimal(1)
        for x in range(a, min(marked, drawn)):
            w = w * (marked - x) * (drawn - x) / ((x + 1) * (rest + x + 1))
            weights[x + 1] = w
        w = Decimal(1)
        for x in range(a, max(0, -rest), -1):
            w = w * x * (rest + x) / ((marked - x + 1) * (drawn - x + 1))
            weights[x - 1] = w
        rare = sum(v for v in weights.values() if v <= 1 + Decimal("1e-7"))
        return float((rare / sum(weights.values())).log10())


STRONG = [(5550, 4450, 994450, 995550), (6000, 4000, 994000, 996000), (800, 200, 99200, 99800),
          (700, 300, 99300, 99700), (20, 980, 99980, 899020), (4450, 5550, 995550, 994450)]
# overlaps 12, 20 and 40 deviations from the expected 500 of 1,000 drawn
STRONG += [(500 + s * t * 16, 500 - s * t * 16, 50_000 - s * t * 16, 50_000 + s * t * 16)
           for t in (12, 20, 31) for s in (1, -1)] + [(3000 + s * 40 * 37, 3000 - s * 40 * 37, 97_000, 97_000)
                                                      for s in (1, -1)]


def test_strong_tables_equal_exact_sums(spark):
    rows = spark.createDataFrame([(str(i), *t) for i, t in enumerate(STRONG)],
                                 "pathway string, a bigint, b bigint, c bigint, d bigint")
    got = {r["pathway"]: r["log10_p"] for r in E.fisher_tests(rows).collect()}
    for i, table in enumerate(STRONG):
        want = exact_log10(*table)
        assert abs(got[str(i)] - want) * math.log(10) < 1e-9 * max(1.0, abs(want) / 100), table


def test_every_small_table(spark):
    """All tables of up to 12 items, empty margins and null cells among them."""
    tables = [(a, b, c, d) for a in range(7) for b in range(7) for c in range(5) for d in range(5) if a + b + c + d <= 12]
    rows = spark.createDataFrame([(str(i), *t) for i, t in enumerate(tables)] + [("null", None, 1, 2, 3)],
                                 "pathway string, a bigint, b bigint, c bigint, d bigint")
    got = {r["pathway"]: r for r in E.fisher_tests(rows).collect()}
    for i, table in enumerate(tables):
        assert got[str(i)]["p"] == pytest.approx(brute_fisher(*table), rel=1e-10), table
    assert got["null"]["p"] is None and got["null"]["log10_p"] is None


def test_log_factorial_ratios(spark):
    from pyspark.sql import functions as F

    from cohortlens.functions.hypergeometric import _log_factorial_ratio

    pairs = [(a, b) for a in (0, 1, 5, 63, 64, 65, 100, 4000, 10 ** 6, 10 ** 9) for b in (0, 3, 64, 66, 999, 10 ** 6 + 1)]
    table = spark.createDataFrame(pairs, "a bigint, b bigint").select("*", F.expr(_log_factorial_ratio("a", "b")).alias("r"))
    for r in table.collect():
        want = math.lgamma(r["a"] + 1) - math.lgamma(r["b"] + 1)
        # the difference of two log-gammas is the one that loses digits
        assert r["r"] == pytest.approx(want, rel=1e-13, abs=1e-15 * math.lgamma(max(r["a"], r["b"]) + 2)), r


def test_order_that_depends_on_the_far_tail(spark):
    """The near tails alone would rank these two the other way round."""
    tables = {"even": (800, 200, 99_200, 99_800), "odd": (799, 201, 99_000, 99_801)}
    exact = {k: exact_log10(*t) for k, t in tables.items()}
    rows = spark.createDataFrame([(k, *t) for k, t in tables.items()],
                                 "pathway string, a bigint, b bigint, c bigint, d bigint")
    order = [r["pathway"] for r in E.top_pathways(E.fisher_tests(rows)).collect()]
    assert order == sorted(exact, key=exact.get)


def test_overlap_counts_distinct(spark):
    links = spark.createDataFrame(
        [("p1", 1), ("p1", 1), ("p1", 2), ("p2", 3), ("p2", 2)], "pathway string, gene_id bigint")
    ids = spark.createDataFrame([(1,), (1,), (2,), (9,)], "gene_id bigint")
    got = {r["pathway"]: (r["m"], r["k"], r["list_size"]) for r in
           E.with_list_size(E.pathway_overlap(links, ids), ids).collect()}
    assert got == {"p1": (2, 2, 3), "p2": (2, 1, 3)}
    empty = ids.where("gene_id < 0")
    got = {r["pathway"]: (r["m"], r["k"]) for r in E.pathway_overlap(links, empty).collect()}
    assert got == {"p1": (2, 0), "p2": (2, 0)}


def test_corrections(spark):
    ps = [0.001, 0.01, 0.01, 0.2, 0.9]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")

    def run(method, **kw):
        return [r["p_corrected"] for r in C.correct(df, method, **kw).orderBy("i").collect()]

    assert run("Bonferroni") == pytest.approx([0.005, 0.05, 0.05, 1.0, 1.0])
    factor = 0.05 / (1 - 0.95 ** 0.2)
    assert run("Sidak") == pytest.approx([min(1, p * factor) for p in ps])
    assert run("HB") == pytest.approx([0.005, 0.04, 0.04, 0.2, 0.9])
    assert run(None) == ps
    assert run("Bonferroni", n_tests=295) == pytest.approx([0.295, 1, 1, 1, 1])
    with pytest.raises(ValueError):
        run("B")
    assert C.correct(df.where("i < 0"), "HB").count() == 0
    assert C.correct(df.where("i < 0"), "Sidak").count() == 0
