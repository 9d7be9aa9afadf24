"""DuckDB SQL that computes every registered query independently of the Spark code.

The statistics are written the direct way (row numbers, plain series, chained CTEs), so a shared
mistake is unlikely; sizes of the test tables keep that affordable.
"""

from __future__ import annotations

from bindings.registered import (
    CURVE_DROP, CURVE_FLOOR, CV_RUNS, CV_SEED, DESCENT_STEPS, DESCENT_TOLERANCE, RESULT_FOLDERS, SPLIT_SEED,
    TRAIN_FRACTION,
)
from cohortlens.functions import special as S
from cohortlens.functions import tokens as T
from cohortlens.operators.linear_models import ALGORITHMS
from cohortlens.operators.normality import (
    ANDERSON_CRITICAL, LARGEST_WEIGHT, SECOND_WEIGHT, SHAPIRO_CRITICAL,
)

ORACLE: dict[str, str] = {}


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def horner(coefficients, x: str) -> str:
    text = f"({coefficients[0]!r})"
    for c in coefficients[1:]:
        text = f"({text}*({x})+({c!r}))"
    return text


# ------------------------------------------------------------------------------ value tokens

def quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def is_na(x: str) -> str:
    return f"({x} IS NULL OR {x} IN ({quoted(T.NA_TOKENS)}))"


NUMBER = T.NUMBER_PATTERN.replace("(?i)", "")


def number(x: str) -> str:
    return (f"(CASE WHEN regexp_full_match({x}, '{NUMBER}', 'i') "
            f"THEN try_cast(trim({x}) AS DOUBLE) END)")


# --------------------------------------------------------------------------- fixture studies

ORDERS = "oc AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"
MONEY = "CAST(CAST({} AS DECIMAL(12,2)) AS VARCHAR)"
BUILDING = "CASE WHEN c_mktsegment = 'BUILDING' THEN 'Yes' ELSE 'no' END"
MIXED_FEATURES = {
    "totalprice": MONEY.format("o_totalprice"),
    "acctbal": f"CASE WHEN c_acctbal < 0 THEN 'NA' WHEN o_orderkey % 11 = 0 THEN '' "
               f"ELSE {MONEY.format('c_acctbal')} END",
    "nation": "CAST(c_nationkey AS VARCHAR)",
    "status": "o_orderstatus",
    "priority": "CASE WHEN starts_with(o_orderpriority, '5') THEN 'NA' ELSE o_orderpriority END",
    "building": BUILDING,
    "fulfilled": "CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END",
    "constant": "'7'",
    "rare": "CASE WHEN o_orderkey < 3 THEN CAST(o_orderkey AS VARCHAR) ELSE 'NA' END",
    "guessed": f"CASE WHEN o_orderkey = 0 THEN 'unknown' ELSE {MONEY.format('o_totalprice')} END",
    "answered": f"CASE WHEN o_orderkey < 2 THEN 'Uncertain' ELSE {BUILDING} END",
}
MIXED = ORDERS + ", mixed AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS feature, o_orderkey AS sample_id, {value} AS raw FROM oc"
    for name, value in MIXED_FEATURES.items()) + ")"
NUMERIC = """numeric_study AS (
  SELECT printf('d%02d', pos) AS feature, vec_id AS sample_id, x FROM (
    SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x
    FROM embeddings))"""
GAPPY_FEATURES = {
    "totalprice": "o_totalprice",
    "acctbal": "CASE WHEN c_acctbal >= 0 THEN c_acctbal END",
    "nation": "c_nationkey::DOUBLE",
    "late": "CASE WHEN o_orderstatus <> 'F' THEN o_totalprice + c_acctbal END",
    "constant": "7.0::DOUBLE",
    "rare": "CASE WHEN o_orderkey < 2 THEN o_orderkey::DOUBLE END",
}
GAPPY = ORDERS + ", gappy AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS feature, o_orderkey AS sample_id, {value} AS x FROM oc"
    for name, value in GAPPY_FEATURES.items()) + ") WHERE x IS NOT NULL)"
FAMILIES = f"""valid AS (
  SELECT *, {number('raw')} AS num, lower(raw) IN ({quoted(T.UNKNOWN_TOKENS)}) AS unk,
    row_number() OVER (PARTITION BY feature ORDER BY sample_id) AS i
  FROM mixed WHERE NOT {is_na('raw')}),
known AS (
  SELECT feature, raw, row_number() OVER (PARTITION BY feature ORDER BY sample_id) AS k
  FROM valid WHERE NOT unk),
odd AS (
  SELECT feature, num, row_number() OVER (PARTITION BY feature ORDER BY sample_id) AS k
  FROM valid WHERE num IS NULL OR num NOT IN (0, 1)),
tested AS (
  SELECT t.feature, t.n_total, coalesce(v.n_valid, 0) AS n_valid, coalesce(n_numbers, 0) AS
    n_numbers, coalesce(n_distinct, 0) AS n_distinct, u.raw AS answer,
    CASE WHEN v0.unk THEN v1.num ELSE v0.num END AS decider, o.feature AS odd_feature,
    o.num AS odd_num
  FROM (SELECT feature, count(*) AS n_total FROM mixed GROUP BY 1) t
  LEFT JOIN (SELECT feature, count(*) AS n_valid, count(num) AS n_numbers,
    count(DISTINCT lower(raw)) AS n_distinct FROM valid GROUP BY 1) v USING (feature)
  LEFT JOIN valid v0 ON v0.feature = t.feature AND v0.i = 1
  LEFT JOIN valid v1 ON v1.feature = t.feature AND v1.i = 2
  LEFT JOIN known u ON u.feature = t.feature AND u.k = 1
  LEFT JOIN odd o ON o.feature = t.feature AND o.k = 1),
families AS (
  SELECT feature, n_total, n_valid, n_total - n_valid AS n_na, n_numbers,
    CASE WHEN n_valid < 4 OR n_distinct < 2 OR answer IS NULL THEN 'Other'
      WHEN decider IS NOT NULL AND decider NOT IN (0, 1) THEN 'Numerical'
      WHEN decider IS NOT NULL AND odd_feature IS NULL THEN 'Binary'
      WHEN decider IS NOT NULL AND odd_num IS NOT NULL THEN 'Numerical'
      WHEN lower(answer) IN ({quoted(T.BOOLEAN_TOKENS)}) THEN 'Binary'
      ELSE 'Categorical' END AS family
  FROM tested)"""

# ----------------------------------------------------------------------------- distributions


def tail(a: str) -> str:
    e = f"exp(-({a})*({a})/2)"
    near = f"{e}*{horner(S.NORMAL_TAIL_NUM, a)}/{horner(S.NORMAL_TAIL_DEN, a)}"
    b = f"(({a})+0.65)"
    for k in (4, 3, 2, 1):
        b = f"(({a})+{k}/{b})"
    return f"(CASE WHEN ({a}) < 7.07106781186547 THEN {near} ELSE {e}/{b}/2.506628274631 END)"


def log_cdf(z: str) -> str:
    t = tail(f"abs({z})")
    return (f"(CASE WHEN {z} < -37 THEN -({z})*({z})/2 - ln(abs({z})) - {S.LOG_SQRT_2PI!r} "
            f"WHEN {z} > 0 THEN ln(1 - {t}) ELSE ln({t}) END)")


def quantile(p: str) -> str:
    q = f"(({p}) - 0.5)"
    inner = f"(0.180625 - {q}*{q})"
    r = f"sqrt(-ln(least({p}, 1 - ({p}))))"
    near, far = f"({r} - 1.6)", f"({r} - 5.0)"
    return (
        f"(CASE WHEN abs({q}) <= 0.425 THEN {q}*{horner(S.QUANTILE_CENTRE_NUM, inner)}/"
        f"{horner(S.QUANTILE_CENTRE_DEN, inner)} WHEN {r} <= 5 THEN sign({q})*"
        f"{horner(S.QUANTILE_MIDDLE_NUM, near)}/{horner(S.QUANTILE_MIDDLE_DEN, near)} ELSE "
        f"sign({q})*{horner(S.QUANTILE_FAR_NUM, far)}/{horner(S.QUANTILE_FAR_DEN, far)} END)")


def beta_series(a: str, b: str, x: str, terms: int) -> str:
    """I_x(a, b) by its increasing series."""
    return (f"list_sum(list_transform(range(0, {terms}), lambda z: exp(({a}+z)*ln({x}) + "
            f"({b})*ln(1-({x})) + lgamma(({a})+({b})+z) - lgamma(({a})+z+1) - lgamma({b}))))")


def correlation_p(r: str, n: str) -> str:
    v = f"({n} - 2)"
    return (
        f"(CASE WHEN abs({r}) >= 1 THEN 0.0 WHEN {r} = 0 THEN 1.0 "
        f"WHEN {v}*{r}*{r}/(1-{r}*{r}) > 1600 THEN 0.0 "
        f"WHEN {r}*{r} < 0.5 THEN 1 - {beta_series('0.5', f'{v}/2.0', f'{r}*{r}', 2500)} "
        f"ELSE {beta_series(f'{v}/2.0', '0.5', f'(1-{r}*{r})', 400)} END)")


def chi_square_p(x: str, df: str) -> str:
    a, h = f"({df}/2.0)", f"({x}/2.0)"
    return (
        f"(CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 250 THEN 0.0 ELSE greatest(0.0, 1 - "
        f"list_sum(list_transform(range(0, 400), lambda z: exp(({a}+z)*ln({h}) - {h} - "
        f"lgamma({a}+z+1))))) END)")


def binomial_p(k: str, n: str) -> str:
    return (
        f"(CASE WHEN 2*{k} = {n} THEN 1.0 ELSE least(1.0, 2*list_sum(list_transform("
        f"range(0, {k}+1), lambda j: exp(lgamma({n}+1.0) - lgamma(j+1.0) - lgamma({n}-j+1.0) "
        f"- {n}*ln(2.0))))) END)")


# -------------------------------------------------------------------------- sources and sinks

ORACLE["labeled_points"] = """
SELECT o_orderkey AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS
  label, 3::BIGINT AS n_features, o_custkey::DOUBLE AS f0,
  round(o_totalprice * 100)::BIGINT::DOUBLE AS f1, dayofyear(o_orderdate)::DOUBLE AS f2
FROM orders"""

ORACLE["feature_names"] = """
SELECT file_id, unnest(range(len(names)))::BIGINT AS pos, unnest(names) AS feature FROM (
  SELECT doc_id AS file_id, string_split(split_part(text, chr(10), 1), ' ') AS names
  FROM documents)"""

ORACLE["feature_names_line"] = """
SELECT unnest(range(len(names)))::BIGINT AS pos, unnest(names) AS feature FROM (
  SELECT string_split(string_agg(n_name, ' ' ORDER BY n_name), ' ') AS names FROM nation)"""

ORACLE["feature_lines"] = f"""
SELECT 'v' || vec_id AS feature, unnest(range(len(embedding)))::BIGINT AS sample_id,
  {r6('unnest(embedding)::DOUBLE')} AS value FROM embeddings"""

ORACLE["study_scan"] = """
SELECT source || '-' || doc_id AS "FeatureName", md5(text) AS digest,
  length(text)::BIGINT AS n_chars
FROM documents WHERE lang = 'en'"""

ORACLE["observations_long"] = f"""
SELECT 'v' || vec_id AS feature, pos::BIGINT AS sample_id, x < -0.2 AS missing,
  CASE WHEN NOT x < -0.2 THEN {r6('x')} END AS value FROM (
  SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x
  FROM embeddings)"""

ORACLE["pathway_links"] = "SELECT p_brand AS pathway, p_partkey AS gene_id FROM part"

ORACLE["symbol_map"] = """
SELECT symbol, max(c_custkey) AS gene_id FROM (
  SELECT c_mktsegment || '_' || (c_custkey % 200) AS symbol, c_custkey FROM customer
  WHERE c_custkey % 13 <> 0) GROUP BY symbol"""

ORACLE["gene_list"] = r"""
SELECT symbol, count(*) AS n FROM (
  SELECT unnest(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')) AS symbol FROM conversations)
WHERE symbol <> '' GROUP BY symbol"""

ORACLE["result_update"] = f"""
WITH updates AS (
  SELECT o_custkey AS c_custkey, 'completed' AS status, {r6('max(o_totalprice)')} AS perf,
    count(*) AS n_features FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
SELECT c.c_custkey, c_mktsegment AS algorithm,
  CASE WHEN u.c_custkey IS NOT NULL THEN u.status ELSE 'pending' END AS status,
  CASE WHEN u.c_custkey IS NOT NULL THEN u.perf ELSE {r6('c_acctbal')} END AS perf,
  u.n_features
FROM customer c LEFT JOIN updates u ON u.c_custkey = c.c_custkey"""

ORACLE["result_store_update"] = f"""
WITH rich AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1000000000 ELSE o_custkey END AS k,
    max({r6('o_totalprice')}) AS perf FROM orders WHERE o_totalprice > 450000 GROUP BY 1),
placed AS (
  SELECT c.*, rich.perf AS new, ('0x' || md5(c_custkey::VARCHAR)[1:8])::BIGINT % {RESULT_FOLDERS} AS folder
  FROM customer c LEFT JOIN rich ON k = c_custkey)
SELECT c_custkey, c_mktsegment AS algorithm, CASE WHEN new IS NULL THEN 'pending' ELSE 'completed' END AS status,
  coalesce(new, {r6('c_acctbal')}) AS perf, count(new) OVER (PARTITION BY folder) > 0 AS replaced FROM placed"""

ORACLE["result_document"] = f"""
WITH {MIXED}, {FAMILIES}
SELECT count(*) AS n_features, sum(n_na)::BIGINT AS n_na,
  string_agg(feature || ':' || family || ':' || n_valid || ':' || n_na, ',' ORDER BY feature)
    AS features, 'Completed' AS status
FROM families"""

# ------------------------------------------------------------------------ values and families

ORACLE["na_filter"] = f"""
WITH {MIXED}
SELECT feature, count(*) AS n, min(sample_id) AS first_id, max(sample_id) AS last_id,
  sum(length(raw))::BIGINT AS n_chars
FROM mixed WHERE NOT {is_na('raw')} GROUP BY feature"""

ORACLE["family_infer"] = f"WITH {MIXED}, {FAMILIES} SELECT * FROM families"

ORACLE["family_route"] = f"""
WITH {MIXED}, {FAMILIES}
SELECT feature, family, n_total AS n FROM families WHERE family <> 'Other'"""

ORACLE["typed_values"] = f"""
WITH {MIXED}, {FAMILIES}
SELECT feature, family, count(*) AS n, count(value) AS n_values,
  count(*) FILTER (family = 'Numerical' AND value IS NULL) AS n_unparsed,
  {r6('avg(value)')} AS mean, {r6('min(value)')} AS low, {r6('max(value)')} AS high
FROM (SELECT v.feature, family, CASE WHEN family = 'Numerical' THEN num END AS value
  FROM valid v JOIN families USING (feature)) GROUP BY feature, family"""

# ------------------------------------------------------------------- normality of a long table


def order_statistics(source: str, scored: bool = True) -> str:
    """CTEs `ranked` (rows with rank i, size n, mean, deviation) and the score m of each rank."""
    score = f", {quantile('(i - 0.375)/(n + 0.25)')} AS m" if scored else ""
    return f"""stats AS (
  SELECT feature, count(*) AS n, avg(x) AS mean, var_pop(x) AS var_pop FROM {source} GROUP BY 1),
ranked AS (
  SELECT *{score} FROM (
    SELECT s.feature, x, n, mean, var_pop,
      row_number() OVER (PARTITION BY s.feature ORDER BY x, sample_id) AS i
    FROM {source} d JOIN stats s ON s.feature = d.feature))"""


SHAPIRO = f"""scores AS (
  SELECT feature, n, var_pop, sum(m*m) AS ss, max(CASE WHEN i = n THEN m END) AS mn,
    max(CASE WHEN i = n - 1 THEN m END) AS mn1 FROM ranked GROUP BY 1, 2, 3),
shapes AS (
  SELECT *, {horner(LARGEST_WEIGHT, '(1/sqrt(n))')} + mn/sqrt(ss) AS an,
    {horner(SECOND_WEIGHT, '(1/sqrt(n))')} + mn1/sqrt(ss) AS an1
  FROM scores WHERE n > 5 AND var_pop > 0),
shapiro AS (
  SELECT r.feature, r.n, least(1.0, power(sum((x - mean) * CASE
      WHEN i = r.n THEN an WHEN i = 1 THEN -an WHEN i = r.n - 1 THEN an1 WHEN i = 2 THEN -an1
      ELSE m / sqrt((ss - 2*mn*mn - 2*mn1*mn1)/(1 - 2*an*an - 2*an1*an1)) END), 2)
    / (r.n * any_value(r.var_pop))) AS w
  FROM ranked r JOIN shapes s ON s.feature = r.feature GROUP BY r.feature, r.n)"""

ANDERSON = f"""zs AS (
  SELECT feature, n, i, (x - mean)/sqrt(var_pop*n/(n - 1)) AS z FROM ranked WHERE var_pop > 0),
anderson AS (
  SELECT feature, n, -n - sum((2*i - 1)*{log_cdf('z')} + (2*(n - i) + 1)*{log_cdf('(-z)')})/n
    AS a2 FROM zs GROUP BY feature, n)"""

SHAPIRO_CASE = "CASE " + " ".join(
    f"WHEN n >= {start} THEN {critical}" for start, critical in sorted(SHAPIRO_CRITICAL, reverse=True)
) + " END::DOUBLE"
VERDICT = f"""verdict AS (
  SELECT *, CASE WHEN a2 < anderson_critical AND w > coalesce(shapiro_critical, -1)
    THEN 'normal' ELSE 'unknown' END AS distribution FROM (
    SELECT feature, n, w, a2,
      round({ANDERSON_CRITICAL[5.0]}::DOUBLE/(1 + 4.0/n - 25.0/(n*n)), 3) AS anderson_critical,
      {SHAPIRO_CASE} AS shapiro_critical
    FROM stats LEFT JOIN shapiro USING (feature, n) LEFT JOIN anderson USING (feature, n)))"""
NUMERIC_VERDICT = f"{NUMERIC}, {order_statistics('numeric_study')}, {SHAPIRO}, {ANDERSON}, {VERDICT}"
BOTH_STUDIES = f"""{NUMERIC}, {GAPPY}, both_studies AS (
  SELECT * FROM numeric_study UNION ALL SELECT * FROM gappy)"""

ORACLE["normal_features"] = f"""
WITH {NUMERIC_VERDICT} SELECT feature, n FROM verdict WHERE distribution = 'normal'"""

ORACLE["feature_vectors"] = f"""
WITH {NUMERIC}, pieces AS (
  SELECT feature, sample_id // 128 AS piece, list(x ORDER BY sample_id) AS v
  FROM numeric_study GROUP BY 1, 2)
SELECT feature, piece::BIGINT AS piece, len(v)::BIGINT AS n, {r6('v[1]')} AS head,
  {r6('v[len(v)]')} AS tail, {r6('list_sum(v)')} AS total FROM pieces"""

ORACLE["patient_map"] = f"""
SELECT vec_id AS sample_id, len(embedding)::BIGINT AS n_features,
  {r6('embedding[1]::DOUBLE')} AS d00, {r6('embedding[18]::DOUBLE')} AS d17 FROM embeddings"""

LABEL = "CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END::DOUBLE"

ORACLE["feature_drop"] = f"""
SELECT vec_id AS sample_id, label, len(v)::BIGINT AS n_features, {r6('v[1]')} AS head,
  {r6('v[5]')} AS fifth, {r6('list_sum(v)')} AS total FROM (
  SELECT vec_id, {LABEL} AS label, list_concat(embedding[2:5], embedding[7:63])::DOUBLE[] AS v
  FROM embeddings)"""

ORACLE["dedupe_ordered"] = """
SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS position FROM lineitem
GROUP BY l_partkey"""

ORACLE["na_counts"] = f"""
WITH {MIXED}
SELECT feature, count(*) FILTER ({is_na('raw')}) AS n_na FROM mixed GROUP BY feature"""

ORACLE["feature_stats"] = f"""
WITH {BOTH_STUDIES}
SELECT feature, count(*) AS n, {r6('avg(x)')} AS mean, {r6('stddev_pop(x)')} AS std,
  {r6('min(x)')} AS low, {r6('max(x)')} AS high,
  round_even(stddev_pop(x)*100, 0)/100 AS std_bucket
FROM both_studies GROUP BY feature"""

ORACLE["family_counts"] = f"""
WITH {MIXED}, {FAMILIES}, study AS (
  SELECT v.feature, sample_id, num AS x FROM valid v JOIN families f ON f.feature = v.feature
  WHERE family = 'Numerical' AND num IS NOT NULL),
{order_statistics('study')}, {SHAPIRO}, {ANDERSON}, {VERDICT}
SELECT count(*) AS n_features, count(*) FILTER (family = 'Binary') AS n_binary,
  count(*) FILTER (family = 'Numerical') AS n_numerical,
  count(*) FILTER (family = 'Categorical') AS n_categorical,
  count(*) FILTER (family = 'Other') AS n_other,
  (SELECT count(*) FROM verdict WHERE distribution = 'normal') AS n_normal,
  (SELECT count(*) FROM verdict WHERE distribution <> 'normal') AS n_unknown
FROM families"""


def uniform(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5({seed} || '|' || {key}), 1, 8))::BIGINT / 4294967296.0)"


ORACLE["split_sizes"] = f"""
SELECT count(*) AS n, count(*) FILTER (t) AS n_train, count(*) FILTER (NOT t) AS n_test
FROM (SELECT {uniform(f"'{SPLIT_SEED}'", 'vec_id')} < {TRAIN_FRACTION} AS t FROM embeddings)"""

ORACLE["error_rate"] = f"""
SELECT count(*) AS n, count(*) FILTER (wrong) AS n_wrong, {r6('avg(wrong::INT)')} AS error
FROM (SELECT quality <> (n_chars > 600)::INT AS wrong FROM labels JOIN documents USING (doc_id))"""

# -------------------------------------------------------------------------- statistical tests

ORACLE["shapiro_w"] = f"""
WITH {BOTH_STUDIES}, {order_statistics('both_studies')}, {SHAPIRO}
SELECT feature, n, {r6('w')} AS w FROM stats LEFT JOIN shapiro USING (feature, n)"""

ORACLE["shapiro_threshold"] = f"""
SELECT user_id, n, {SHAPIRO_CASE} AS critical FROM (
  SELECT user_id, count(*) AS n FROM events GROUP BY user_id)"""

ORACLE["anderson_a2"] = f"""
WITH {NUMERIC}, {order_statistics('numeric_study', scored=False)}, {ANDERSON}
SELECT feature, n, {r6('a2')} AS a2 FROM stats LEFT JOIN anderson USING (feature, n)"""

ORACLE["normality_verdict"] = f"""
WITH {NUMERIC_VERDICT}
SELECT feature, n, {r6('w')} AS w, {r6('a2')} AS a2, anderson_critical, shapiro_critical,
  distribution FROM verdict"""

ORACLE["anderson_levels"] = f"""
WITH {NUMERIC}, {order_statistics('numeric_study', scored=False)}, {ANDERSON}
SELECT feature, level, round(value/(1 + 4.0/n - 25.0/(n*n)), 3) AS critical,
  a2 < round(value/(1 + 4.0/n - 25.0/(n*n)), 3) AS below
FROM stats LEFT JOIN anderson USING (feature, n), (VALUES (15.0::DOUBLE, 0.576::DOUBLE),
  (10.0, 0.656), (5.0, 0.787), (2.5, 0.918), (1.0, 1.092)) v(level, value)"""

ORACLE["non_finite_counts"] = f"""
WITH {NUMERIC} SELECT feature, count(*) FILTER (odd) AS n_non_finite, count(*) FILTER (NOT odd) AS n,
  {r6('avg(x) FILTER (NOT odd)')} AS mean
FROM (SELECT *, sample_id % 50 = 0 OR sample_id % 70 = 1 AS odd FROM numeric_study) GROUP BY feature"""

ORACLE["anova_members"] = f"""
WITH {NUMERIC}, spread AS (SELECT feature, stddev_pop(x) AS s FROM numeric_study GROUP BY feature)
SELECT round_even(s, 2) AS std_bucket, feature FROM spread"""

ORACLE["ks_uniform"] = f"""
WITH {GAPPY}, limits AS (
  SELECT feature, count(*) AS n, min(x) AS lo, max(x) AS hi FROM gappy GROUP BY 1),
steps AS (
  SELECT l.feature, n, (x - lo)/(hi - lo) AS f,
    row_number() OVER (PARTITION BY l.feature ORDER BY x) AS i
  FROM gappy g JOIN limits l ON l.feature = g.feature WHERE hi > lo),
distances AS (
  SELECT feature, n, max(greatest(i/n - f, f - (i - 1)/n)) AS ks_d FROM steps GROUP BY 1, 2),
scaled AS (SELECT *, (sqrt(n) + 0.12 + 0.11/sqrt(n))*ks_d AS lam FROM distances),
tested AS (
  SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(
    range(1, 101), lambda j: 2*(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END)*exp(-2.0*j*j*lam*lam)))))
    END AS ks_p FROM scaled)
SELECT feature, n, {r6('ks_d')} AS ks_d, {r6('ks_p')} AS ks_p,
  CASE WHEN ks_p >= 0.05 THEN 'uniform' ELSE 'unknown' END AS distribution FROM tested"""


def kolmogorov(d: str, n: str) -> str:
    """Asymptotic p, up to 80 values that of the exact distribution: rows (H, v) of a recursion that
    multiplies a vector by the matrix n times."""
    lam = f"((sqrt({n}) + 0.12 + 0.11/sqrt({n}))*{d})"
    return (f"CASE WHEN {lam} < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101), "
            f"lambda j: 2*(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END)*exp(-2.0*j*j*{lam}*{lam}))))) END")


def ks_laws(source: str, laws: dict[str, str]) -> str:
    """CTEs up to `tested`: every feature of `source` against the CDFs `laws` of x, lo, hi, mu, sd."""
    law_rows = " UNION ALL ".join(
        f"SELECT feature, n, '{law}' AS law, max(greatest(i/n - f, f - (i - 1)/n)) AS d "
        f"FROM (SELECT feature, n, i, {cdf} AS f FROM placed) GROUP BY feature, n" for law, cdf in laws.items())
    sign = "CASE WHEN i < j - 1 THEN 0.0 ELSE 1.0 END"
    corner = "CASE WHEN i = m AND j = 1 AND 2*h > 1 THEN power(2*h - 1, m) ELSE 0.0 END"
    entry = (f"({sign} - CASE WHEN j = 1 THEN power(h, i) ELSE 0.0 END "
             f"- CASE WHEN i = m THEN power(h, m - j + 1) ELSE 0.0 END + {corner}) / exp(lgamma(greatest(i - j + 1, 0) + 1.0))")
    return f"""limits AS (
  SELECT feature, count(*) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS mu, stddev_pop(x) AS sd
  FROM {source} GROUP BY 1),
placed AS (
  SELECT l.*, x, row_number() OVER (PARTITION BY l.feature ORDER BY x) AS i
  FROM {source} s JOIN limits l ON l.feature = s.feature WHERE hi > lo),
distances AS ({law_rows}),
small AS (SELECT DISTINCT n, d, greatest(1, ceil(n*d))::INT AS k FROM distances WHERE n <= 80),
shaped AS (SELECT n, d, k, 2*k - 1 AS m, k - n*d AS h FROM small),
matrices AS (
  SELECT n, d, k, list_transform(range(1, m + 1), lambda i: list_transform(range(1, m + 1), lambda j: {entry})) AS rows
  FROM shaped),
powers AS (
  WITH RECURSIVE steps AS (
    SELECT n, d, k, rows, 0::BIGINT AS t, list_transform(range(1, 2*k), lambda i: CASE WHEN i = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v
    FROM matrices
    UNION ALL
    SELECT n, d, k, rows, t + 1, list_transform(rows, lambda r: list_inner_product(r, v)*(t + 1)/n) FROM steps WHERE t < n)
  SELECT n, d, least(1.0, greatest(0.0, 1 - v[k])) AS p FROM steps WHERE t = n),
tested AS (
  SELECT feature, law, x.n, x.d, coalesce(powers.p, {kolmogorov('x.d', 'x.n')}) AS p
  FROM distances x LEFT JOIN powers ON powers.n = x.n AND powers.d = x.d)"""


def normal_law(z: str) -> str:
    return f"CASE WHEN {z} > 0 THEN 1 - exp({log_cdf(f'(-({z}))')}) ELSE exp({log_cdf(f'({z})')}) END"


ORACLE["ks_laws"] = f"""
WITH {NUMERIC}, both_studies AS (
  SELECT feature, x FROM numeric_study UNION ALL
  SELECT 'c' || o_custkey AS feature, o_totalprice::DOUBLE AS x FROM orders),
{ks_laws('both_studies', {'uniform': '(x - lo)/(hi - lo)', 'normal': normal_law('(x - mu)/sd'),
                          'exponential': '1 - exp(-(x - lo)/(mu - lo))'})}
SELECT feature, law, n, {r6('d')} AS ks_d, {r6('p')} AS ks_p,
  CASE WHEN p >= 0.05 THEN law ELSE 'unknown' END AS distribution FROM tested"""

ORACLE["ks_standard_normal"] = f"""
WITH {NUMERIC}, scaled AS (SELECT feature, x*8 AS x FROM numeric_study),
{ks_laws('scaled', {'normal': normal_law('x')})}
SELECT feature, n, {r6('d')} AS ks_d, {r6('p')} AS ks_p,
  CASE WHEN p >= 0.05 THEN law ELSE 'unknown' END AS distribution FROM tested"""


def pairs(source: str) -> str:
    return f"""feature_names AS (SELECT DISTINCT feature FROM {source}),
all_pairs AS (
  SELECT a.feature AS feature_x, b.feature AS feature_y FROM feature_names a, feature_names b),
aligned AS (
  SELECT a.feature AS feature_x, b.feature AS feature_y, a.x AS x, b.x AS y
  FROM {source} a JOIN {source} b ON a.sample_id = b.sample_id)"""


def matrix(extra: str, x: str, y: str, rows: str) -> str:
    return f"""{extra}
grouped AS (
  SELECT feature_x, feature_y, count(*) AS n,
    count(*) <= 2 OR min({x}) = max({x}) OR min({y}) = max({y}) AS degenerate,
    covar_pop({x}, {y}) AS sxy, stddev_pop({x}) AS sx, stddev_pop({y}) AS sy
  FROM {rows} GROUP BY 1, 2),
coefficients AS (
  SELECT feature_x, feature_y, coalesce(n, 0) AS n, coalesce(degenerate, true) AS degenerate,
    CASE WHEN coalesce(degenerate, true) THEN 0.0
    WHEN feature_x = feature_y THEN 1.0 ELSE greatest(-1.0, least(1.0, sxy/(sx*sy))) END AS r
  FROM all_pairs LEFT JOIN grouped USING (feature_x, feature_y)),
matrix AS (
  SELECT *, CASE WHEN degenerate THEN 0.0 ELSE {correlation_p('r', 'n')} END AS p
  FROM coefficients)"""


MATRIX_COLUMNS = f"feature_x, feature_y, n, {r6('r')} AS r, {r6('p')} AS p, degenerate"

ORACLE["pairwise_align"] = f"""
WITH {GAPPY}, {pairs('gappy')}
SELECT feature_x, feature_y, count(x) AS n, {r6('avg(x)')} AS mean_x, {r6('avg(y)')} AS mean_y
FROM all_pairs LEFT JOIN aligned USING (feature_x, feature_y)
WHERE feature_x <= feature_y GROUP BY 1, 2"""

ORACLE["pearson_matrix"] = f"""
WITH {BOTH_STUDIES}, {pairs('both_studies')}, {matrix('', 'x', 'y', 'aligned')}
SELECT {MATRIX_COLUMNS} FROM matrix"""

ORACLE["pearson_non_finite"] = f"""
WITH {NUMERIC}, finite AS (SELECT * FROM numeric_study
  WHERE NOT (sample_id % 50 = 0 AND feature = 'd03')
    AND (NOT (sample_id % 70 = 1 AND feature < 'd02') OR sample_id % 50 = 0 AND feature = 'd03')),
{pairs('finite')}, {matrix('', 'x', 'y', 'aligned')}
SELECT {MATRIX_COLUMNS} FROM matrix"""

ORACLE["spearman_matrix"] = f"""
WITH {GAPPY}, {pairs('gappy')}, pair_ranks AS (
  SELECT feature_x, feature_y,
    rank() OVER (PARTITION BY feature_x, feature_y ORDER BY x)
      + (count(*) OVER (PARTITION BY feature_x, feature_y, x) - 1)/2.0 AS rx,
    rank() OVER (PARTITION BY feature_x, feature_y ORDER BY y)
      + (count(*) OVER (PARTITION BY feature_x, feature_y, y) - 1)/2.0 AS ry
  FROM aligned), {matrix('', 'rx', 'ry', 'pair_ranks')}
SELECT {MATRIX_COLUMNS} FROM matrix"""

ORACLE["corr_heatmap"] = f"""
WITH {NUMERIC}, {pairs('numeric_study')}, cells AS (
  SELECT feature_x, feature_y, CASE WHEN feature_x = feature_y THEN 1.0
    ELSE covar_pop(x, y)/(stddev_pop(x)*stddev_pop(y)) END AS r FROM aligned GROUP BY 1, 2),
labels AS (
  SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS pos
  FROM (SELECT DISTINCT feature FROM numeric_study))
SELECT a.pos AS "row", b.pos AS col, feature_x, feature_y,
  CASE WHEN r < 0.001 THEN 0.0 ELSE {r6('r')} END AS cell
FROM cells JOIN labels a ON a.feature = feature_x JOIN labels b ON b.feature = feature_y"""

USERS = "SELECT 'user_' || user_id AS feature, event_type AS raw FROM events"

ORACLE["class_counts"] = f"SELECT feature, raw, count(*) AS n FROM ({USERS}) GROUP BY 1, 2"

ORACLE["chisq_gof"] = f"""
WITH obs AS (
  {USERS} UNION ALL SELECT 'event_type', event_type FROM events
  UNION ALL SELECT 'priority', o_orderpriority FROM orders
  UNION ALL SELECT 'single', 'x' FROM orders),
counts AS (SELECT feature, raw, count(*) AS o FROM obs GROUP BY 1, 2),
sizes AS (SELECT feature, count(*) AS k, sum(o)::BIGINT AS n FROM counts GROUP BY 1),
tests AS (
  SELECT feature, k, n, sum(power(o - n/k, 2)/(n/k)) AS chi2
  FROM counts JOIN sizes USING (feature) GROUP BY 1, 2, 3)
SELECT feature, k AS n_classes, n, CASE WHEN k > 1 THEN {r6('chi2')} ELSE 0.0 END AS chi2,
  CASE WHEN k > 1 THEN {r6(chi_square_p('chi2', '(k - 1)'))} ELSE 0.0 END AS p FROM tests"""

ORACLE["binomial_test"] = f"""
WITH obs AS (
  {USERS} UNION ALL SELECT 'quality', quality::VARCHAR FROM labels
  UNION ALL SELECT 'toxic', toxic::VARCHAR FROM labels
  UNION ALL SELECT 'status', o_orderstatus FROM orders),
counts AS (SELECT feature, raw, count(*) AS c FROM obs GROUP BY 1, 2),
two AS (
  SELECT feature, list(c ORDER BY c) AS cs FROM counts GROUP BY 1 HAVING count(*) > 1),
lows AS (SELECT feature, cs[1] AS low, cs[2] AS high, cs[1] + cs[2] AS n FROM two)
SELECT feature, low, high, {r6(binomial_p('low', 'n'))} AS p FROM lows"""

ANOVA = """groups AS (
  SELECT d.feature, count(*) AS n, avg(x) AS mean, var_pop(x) AS v,
    round_even(stddev_pop(x)*100, 0)/100 AS std_bucket
  FROM {source} d JOIN verdict USING (feature) WHERE distribution = 'normal' GROUP BY 1),
centres AS (
  SELECT std_bucket, count(*) AS k, sum(n)::BIGINT AS total, sum(n*mean)/sum(n) AS centre,
    sum(n*v) AS within FROM groups GROUP BY 1),
buckets AS (
  SELECT c.std_bucket, k, total, CASE WHEN k > 1 THEN
      (sum(n*power(mean - centre, 2))/(k - 1))/(any_value(within)/(total - k)) END AS f
  FROM groups g JOIN centres c USING (std_bucket) GROUP BY 1, 2, 3),
anova AS (
  SELECT std_bucket, k AS n_features, total AS n_values, f,
    CASE WHEN f IS NOT NULL THEN 1 - {p} END AS p
  FROM (SELECT *, (k - 1)/2.0 AS h1, (total - k)/2.0 AS h2,
    (k - 1)*f/((total - k) + (k - 1)*f) AS y FROM buckets))"""


def anova(source: str) -> str:
    return ANOVA.format(source=source, p=beta_series("h1", "h2", "y", 600))


ORACLE["anova_by_std"] = f"""
WITH {NUMERIC_VERDICT}, {anova('numeric_study')}
SELECT std_bucket, n_features, n_values, {r6('f')} AS f, {r6('p')} AS p FROM anova"""

# -------------------------------------------------------------------------------- enrichment

ORACLE["symbol_to_id"] = """
SELECT DISTINCT c_name AS symbol, c_custkey AS gene_id FROM customer
JOIN orders ON c_name = printf('Customer#%09d', o_custkey * 2)"""


def fisher(links: str, ids: str, universe: str) -> str:
    """CTEs up to `tests`: the 2x2 table, odds ratio and p of every pathway."""
    pmf = ("lgamma(m+1.0) - lgamma(x+1.0) - lgamma(m-x+1.0) + lgamma(u-m+1.0) "
           "- lgamma(s-x+1.0) - lgamma(u-m-s+x+1.0) - lgamma(u+1.0) + lgamma(s+1.0) "
           "+ lgamma(u-s+1.0)")
    return f"""links AS ({links}), ids AS ({ids}),
sizes AS (SELECT (SELECT count(*) FROM ids) AS s, ({universe}) AS u),
overlap AS (
  SELECT pathway, count(*) AS m, count(i.gene_id) AS k FROM links l
  LEFT JOIN ids i ON i.gene_id = l.gene_id GROUP BY pathway),
margins AS (SELECT * FROM overlap, sizes),
points AS (
  SELECT pathway, m, k, s, u, unnest(range(greatest(0, m + s - u), least(m, s) + 1)) AS x
  FROM margins),
likelihoods AS (SELECT *, {pmf} AS lp FROM points),
observed AS (SELECT pathway, lp AS lk FROM likelihoods WHERE x = k),
tests AS (
  SELECT pathway, k AS a, s - k AS b, m - k AS c, u - (m + s - k) AS d,
    CASE WHEN s = 0 OR s = u OR m = 0 OR m = u THEN 'nan'::DOUBLE
      WHEN (s - k)*(m - k) > 0 THEN k*(u - (m + s - k))/((s - k)*(m - k))
      WHEN k*(u - (m + s - k)) > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS odds_ratio,
    least(1.0, sum(exp(lp))) AS p,
    least(0.0, (any_value(lk) + ln(sum(exp(lp - lk))))/ln(10)) AS log10_p
  FROM likelihoods JOIN observed USING (pathway) WHERE lp <= lk + 1e-7
  GROUP BY pathway, k, s, m, u)"""


BRAND_LINKS = "SELECT DISTINCT p_brand AS pathway, p_partkey AS gene_id FROM part"
RETURNED = ("SELECT DISTINCT l_partkey AS gene_id FROM lineitem "
            "WHERE l_returnflag = 'R' AND l_quantity >= 45")
BRANDS = fisher(BRAND_LINKS, RETURNED, "SELECT count(*) FROM part")

ORACLE["pathway_overlap"] = f"WITH {BRANDS} SELECT pathway, m, k FROM overlap"
ORACLE["contingency_table"] = f"WITH {BRANDS} SELECT pathway, a, b, c, d FROM tests"
ORACLE["fisher_enrichment"] = f"""
WITH {BRANDS}
SELECT pathway, a, b, c, d, {r6('odds_ratio')} AS odds_ratio, {r6('p')} AS p,
  {r6('log10_p')} AS log10_p FROM tests"""

ORACLE["enrichment_top5"] = f"""
WITH {BRANDS}, top AS (SELECT * FROM tests ORDER BY log10_p, pathway LIMIT 5)
SELECT pathway, a, {r6('p')} AS p, {r6('log10_p')} AS log10_p,
  {r6('least(1.0, p*(SELECT count(*) FROM top))')} AS p_corrected FROM top"""

ORACLE["enrichment_document"] = f"""
WITH {BRANDS}, top AS (SELECT * FROM tests ORDER BY log10_p, pathway LIMIT 5),
ranked AS (SELECT *, row_number() OVER (ORDER BY log10_p, pathway) - 1 AS pos FROM top)
SELECT pos, pathway, {r6('least(1.0, p*(SELECT count(*) FROM top))')} AS p,
  (SELECT pathway FROM ranked WHERE pos = 0) AS top, (SELECT count(*) FROM ids) AS n_genes,
  'Bonferroni' AS correction, 'returned parts' AS custom, 'Completed' AS status FROM ranked"""
ORACLE["gene_listing"] = ORACLE["symbol_to_id"]

N_TESTS = "(SELECT count(*) FROM tests)"
SIDAK = f"least(1.0, p*0.05/(1 - power(0.95, 1.0/{N_TESTS})))"
ORACLE["correct_bonferroni"] = f"""
WITH {BRANDS}
SELECT pathway, {r6('p')} AS p, {r6(f'least(1.0, p*{N_TESTS})')} AS p_corrected FROM tests"""
ORACLE["correct_sidak"] = f"""
WITH {BRANDS} SELECT pathway, {r6('p')} AS p, {r6(SIDAK)} AS p_corrected FROM tests"""
ORACLE["correct_holm"] = f"""
WITH {BRANDS}, left_over AS (
  SELECT *, {N_TESTS} - (SELECT count(*) FROM tests o WHERE o.p < t.p) AS lp FROM tests t)
SELECT pathway, {r6('p')} AS p,
  {r6('least(1.0, CASE WHEN p/lp < 0.05 THEN p*lp ELSE p END)')} AS p_corrected FROM left_over"""

NATIONS = fisher(
    "SELECT 'nat' || c_nationkey AS pathway, c_custkey AS gene_id FROM customer",
    "SELECT DISTINCT o_custkey AS gene_id FROM orders WHERE o_totalprice >= 450000",
    "SELECT count(*) FROM customer")
ORACLE["enrichment_named"] = f"""
WITH {NATIONS}, top AS (
  SELECT *, {SIDAK} AS corrected FROM tests ORDER BY p, pathway LIMIT 5)
SELECT pathway, n_name AS name, {r6('p')} AS p, {r6('corrected')} AS p_corrected
FROM top LEFT JOIN nation ON pathway = 'nat' || n_nationkey"""

# ---------------------------------------------------------------------------- cross-validation

ORACLE["cv_split"] = f"""
SELECT o_orderkey, {uniform(f"'{SPLIT_SEED}'", 'o_orderkey')} < {TRAIN_FRACTION} AS training
FROM orders"""

ORACLE["cv_resample_sizes"] = f"""
SELECT run::BIGINT AS run, count(*) FILTER (t) AS n_train, count(*) FILTER (NOT t) AS n_validation
FROM (SELECT run, {uniform(f"(run + {SPLIT_SEED})", 'o_orderkey')} < {TRAIN_FRACTION} AS t
  FROM orders, range(5) r(run)) GROUP BY run"""

ORACLE["score_linear"] = f"""
WITH scores AS (
  SELECT vec_id, {LABEL} AS label, list_sum(list_transform(range(len(embedding)),
    lambda i: embedding[i + 1]::DOUBLE * ((i*37) % 11 - 5)/10.0)) AS score FROM embeddings)
SELECT vec_id AS sample_id, label, {r6('score')} AS score,
  CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM scores"""

NAMES = [f"d{i:02d}" for i in range(64)]  # width of the embeddings table
PACE = 150.0


def whole(runs: int) -> str:
    """Models (run, step, feature) with all features."""
    return (f"SELECT run::BIGINT AS run, 0::BIGINT AS step, feature FROM range({runs}) r(run), "
            f"(SELECT unnest([{quoted(NAMES)}]) AS feature)")


def eliminated(drop: float, floor: int) -> tuple[str, int]:
    """CTEs of a random elimination, one per step: every run loses the features whose md5 of seed,
    step and name come first. The number of steps follows from the sizes."""
    parts, size, step = [f"k0 AS MATERIALIZED ({whole(CV_RUNS)})"], len(NAMES), 0
    while size > floor:
        step, gone = step + 1, max(1, int(size * drop + 0.5))
        size -= gone
        parts.append(f"""k{step} AS MATERIALIZED (
  SELECT run, {step}::BIGINT AS step, feature FROM (SELECT run, feature, row_number() OVER (
    PARTITION BY run ORDER BY md5((run + {CV_SEED}) || '|{step}|' || feature), feature) AS nth
    FROM k{step - 1}) WHERE nth > {gone})""")
    return ", ".join(parts), step


def descent(name: str, steps: int, used: str, everyone: bool = False, pace: float | None = None) -> str:
    """CTEs of gradient steps for models (run, step, feature) given by the query `used`; a model whose
    weights have moved by less than the tolerance stays as it is. A fixed `pace` in place of a falling
    one goes on to the minimum."""
    spec = ALGORITHMS[name]
    train = "true" if everyone else f"{uniform(f'(run + {CV_SEED})', 'vec_id')} < {TRAIN_FRACTION}"
    slope = {"squared": "m - y", "logistic": "1/(1 + exp(-m)) - y",
             "hinge": "CASE WHEN (2*y - 1)*m < 1 THEN -(2*y - 1) ELSE 0 END"}[spec.loss]
    parts = [f"""{NUMERIC}, used AS MATERIALIZED ({used}),
sides AS MATERIALIZED (
  SELECT run, vec_id AS sample_id, {LABEL} AS y, {train} AS train
  FROM embeddings, (SELECT DISTINCT run FROM used)),
cells AS MATERIALIZED (
  SELECT u.run, u.step, u.feature, s.sample_id, s.y, s.train, d.x
  FROM used u JOIN numeric_study d ON d.feature = u.feature
  JOIN sides s ON s.run = u.run AND s.sample_id = d.sample_id),
w0 AS MATERIALIZED (SELECT run, step, feature, 0.0::DOUBLE AS w, true AS moving FROM used)"""]
    for t in range(1, steps + 1):
        gamma = pace or t ** -0.5
        if spec.penalty == "l2":
            update = f"w*(1 - {gamma!r}*{spec.strength}) - {gamma!r}*g"
        elif spec.penalty == "l1":
            update = (f"sign(w - {gamma!r}*g)*greatest(abs(w - {gamma!r}*g) "
                      f"- {gamma!r}*{spec.strength}, 0)")
        else:
            update = f"w - {gamma!r}*g"
        parts.append(f"""m{t} AS MATERIALIZED (
  SELECT run, step, sample_id, y, sum(x*w) AS m FROM cells JOIN w{t - 1}
  USING (run, step, feature) WHERE train AND moving GROUP BY ALL),
g{t} AS MATERIALIZED (
  SELECT c.run, c.step, c.feature, sum(c.x*s)/count(*) AS g FROM cells c
  JOIN (SELECT *, {slope} AS s FROM m{t}) m USING (run, step, sample_id) GROUP BY ALL),
w{t} AS MATERIALIZED (
  SELECT run, step, feature, new AS w, moving AND ({t} = 1 OR sqrt(sum(power(new - w, 2)) OVER m)
    >= {0 if pace else DESCENT_TOLERANCE} * greatest(sqrt(sum(new*new) OVER m), 1)) AS moving
  FROM (SELECT *, CASE WHEN moving THEN {update} ELSE w END AS new
    FROM w{t - 1} LEFT JOIN g{t} USING (run, step, feature)) WINDOW m AS (PARTITION BY run, step))""")
    rows = "true" if everyone else "NOT train"
    parts.append(f"""scored AS (
  SELECT run, step, sample_id, y, sum(x*w) AS m FROM cells JOIN w{steps}
  USING (run, step, feature) WHERE {rows} GROUP BY ALL),
errors AS (
  SELECT run, step, count(*) AS n, count(*) FILTER ((m > {spec.cut_off})::INT <> y) AS n_wrong,
    sqrt(avg(power(m - y, 2))) AS rmse FROM scored GROUP BY ALL),
curve AS (
  SELECT *, n_wrong/n AS error FROM errors JOIN (
    SELECT run, step, count(*) AS n_features, sum(w) AS weight_sum, sqrt(sum(w*w)) AS weight_norm
    FROM w{steps} GROUP BY ALL) USING (run, step))""")
    return ", ".join(parts)


for key, name in {"cv_svm": "SVM", "cv_logit": "LogisticRegressionWithSGD",
                  "cv_linreg": "LinearRegressionWithSGD", "cv_lasso": "LassoWithSGD"}.items():
    ORACLE[key] = f"""
WITH {descent(name, DESCENT_STEPS, whole(CV_RUNS))}
SELECT run, step, n_features, n, n_wrong, {r6('error')} AS error, {r6('rmse')} AS rmse,
  {r6('weight_sum')} AS weight_sum, {r6('weight_norm')} AS weight_norm FROM curve"""

ORACLE["logit_train_error"] = f"""
WITH {descent('LogisticRegressionWithSGD', DESCENT_STEPS, whole(1), everyone=True)}
SELECT n, n_wrong, {r6('error')} AS error FROM curve"""

# Every fit of the estimator must be optimal; only the validation rows are left to count.
ORACLE["cv_linreg_estimator"] = f"""
SELECT run::BIGINT AS run, any_value(len(embedding))::BIGINT AS n_features, count(*) AS n,
  true AS optimal FROM embeddings, range({CV_RUNS}) r(run)
WHERE NOT {uniform(f'(run + {CV_SEED})', 'vec_id')} < {TRAIN_FRACTION} GROUP BY run"""

ORACLE["eliminate_step"] = f"""
WITH features AS (
  SELECT DISTINCT unnest(range(len(embedding)))::BIGINT AS pos FROM embeddings),
drawn AS (
  SELECT pos, printf('d%02d', pos) AS feature, count(*) OVER () AS total,
    row_number() OVER (ORDER BY md5('{CV_SEED}|1|' || printf('d%02d', pos))) AS nth FROM features)
SELECT pos, feature FROM drawn WHERE nth > greatest(1, round(total*{CURVE_DROP}))"""

KEPT, LAST = eliminated(CURVE_DROP, CURVE_FLOOR)
ALL_KEPT = " UNION ALL ".join(f"SELECT * FROM k{step}" for step in range(LAST + 1))


def curve(name: str) -> str:
    return f"{KEPT}, " + descent(name, DESCENT_STEPS, ALL_KEPT) + f""", best AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(error, 4), n_features, step) AS nth
  FROM curve), chosen AS (
  SELECT b.run, b.step, b.n_features, b.error, w.feature, w.w FROM best b
  JOIN w{DESCENT_STEPS} w ON w.run = b.run AND w.step = b.step WHERE nth = 1)"""


CURVE = curve("LogisticRegressionWithSGD")

ORACLE["cv_document"] = f"""
WITH {curve("LinearRegressionWithSGD")}, curves AS (
  SELECT run, to_json(list({{'step': step, 'n_features': n_features, 'n_wrong': n_wrong}} ORDER BY step))::VARCHAR AS curve
  FROM curve GROUP BY run)
SELECT run, {r6('any_value(error)')} AS perf, any_value(step) AS step, any_value(n_features) AS n_features,
  any_value(curve) AS curve, {r6('sum(w)')} AS weight_sum, 'LinearRegressionWithSGD' AS algorithm,
  'LinearRegressionWithSGD {TRAIN_FRACTION} {CV_RUNS} {CURVE_DROP}' AS parameters, 'completed' AS status
FROM chosen JOIN curves USING (run) GROUP BY run"""

# A long descent: the vectors have length 1, so this pace is below 2 over the largest curvature.
ORACLE["cv_logit_lbfgs"] = f"""
WITH {KEPT}, {descent("LogisticRegressionWithLBFGS", 150, ALL_KEPT, pace=PACE)}
SELECT run, step, n_features, n, n_wrong, {r6('error')} AS error, round(weight_norm, 2) + 0.0 AS weight_norm
FROM curve"""

ORACLE["model_auc"] = f"""
WITH scores AS (
  SELECT run*2 + which AS model, {LABEL} AS y, list_sum(list_transform(range(len(embedding)),
    lambda i: embedding[i + 1]::DOUBLE * ((i*a) % 11 - 5)/10.0)) AS score
  FROM embeddings, range({CV_RUNS}) r(run), (VALUES (0, 37), (1, 17)) w(which, a)
  WHERE NOT {uniform(f'(run + {CV_SEED})', 'vec_id')} < {TRAIN_FRACTION})
SELECT p.model::BIGINT AS model, count(DISTINCT p.k) AS n_positive, count(DISTINCT n.k) AS n_negative,
  {r6('avg(CASE WHEN p.score > n.score THEN 1 WHEN p.score = n.score THEN 0.5 ELSE 0 END)')} AS auc
FROM (SELECT *, row_number() OVER () AS k FROM scores WHERE y = 1) p
JOIN (SELECT *, row_number() OVER () AS k FROM scores WHERE y = 0) n USING (model) GROUP BY ALL"""

ORACLE["elimination_curve"] = f"""
WITH {CURVE} SELECT run, step, n_features, n, n_wrong, {r6('error')} AS error FROM curve"""

ORACLE["best_model"] = f"""
WITH {CURVE}
SELECT run, step, n_features, {r6('error')} AS error, feature, {r6('w')} AS weight FROM chosen"""

CHAIN = fisher(
    "SELECT DISTINCT p_type || '-' || (p_partkey % 7) AS pathway, p_partkey AS gene_id FROM part",
    "SELECT DISTINCT p_partkey AS gene_id FROM part JOIN chosen "
    "ON feature = printf('d%02d', p_partkey)",
    "SELECT count(*) FROM part")
ORACLE["cv_enrichment"] = f"""
WITH {CURVE}, {CHAIN}, top AS (SELECT * FROM tests ORDER BY p, pathway LIMIT 5)
SELECT pathway, a, {r6('p')} AS p,
  {r6('least(1.0, p*(SELECT count(*) FROM top))')} AS p_corrected FROM top"""

# --------------------------------------------------------------------------- general testing

REPORT = f"""
WITH {MIXED}, {FAMILIES}, study AS (
  SELECT v.feature, sample_id, num AS x FROM valid v JOIN families f ON f.feature = v.feature
  WHERE family = 'Numerical' AND num IS NOT NULL),
{order_statistics('study')}, {SHAPIRO}, {ANDERSON}, {VERDICT}, {anova('study')},
{pairs('study')}, {matrix('', 'x', 'y', 'aligned')},
counts AS (
  SELECT feature, family, raw, count(*) AS o FROM valid JOIN families USING (feature)
  WHERE family IN ('Binary', 'Categorical') GROUP BY ALL),
class_sizes AS (
  SELECT feature, family, count(*) AS k, sum(o)::BIGINT AS n, list(o ORDER BY o) AS os
  FROM counts GROUP BY ALL),
goodness AS (
  SELECT feature, k, sum(power(o - n/k, 2)/(n/k)) AS chi2 FROM counts
  JOIN class_sizes USING (feature) WHERE class_sizes.family = 'Categorical' GROUP BY ALL),
two AS (
  SELECT feature, os[1] AS low, os[1] + os[2] AS n FROM class_sizes
  WHERE family = 'Binary' AND k > 1),
numbers AS (
  SELECT count(*) AS n_features, count(*) FILTER (family = 'Binary') AS n_binary,
    count(*) FILTER (family = 'Numerical') AS n_numerical,
    count(*) FILTER (family = 'Categorical') AS n_categorical,
    count(*) FILTER (family = 'Other') AS n_other,
    (SELECT count(*) FROM verdict WHERE distribution = 'normal') AS n_normal,
    (SELECT count(*) FROM verdict WHERE distribution <> 'normal') AS n_unknown FROM families),
report AS (
  SELECT 'NumberOfData' AS section, 'study' AS item, '' AS other, metric, value::DOUBLE AS value
  FROM (UNPIVOT numbers ON n_features, n_binary, n_numerical, n_categorical, n_other, n_normal,
    n_unknown INTO NAME metric VALUE value)
  UNION ALL SELECT 'NumberOfNAs', feature, '', 'n_na', n_na::DOUBLE FROM families
    WHERE family = 'Numerical'
  UNION ALL SELECT 'PearsonCorrelation', feature_x, feature_y, 'r', r FROM matrix
  UNION ALL SELECT 'PearsonCorrelation', feature_x, feature_y, 'p', p FROM matrix
  UNION ALL SELECT 'ChiSquareTest', feature, '', 'chi2', CASE WHEN k > 1 THEN chi2 ELSE 0 END
    FROM goodness
  UNION ALL SELECT 'ChiSquareTest', feature, '', 'p',
    CASE WHEN k > 1 THEN {chi_square_p('chi2', '(k - 1)')} ELSE 0 END FROM goodness
  UNION ALL SELECT 'BinomialTest', feature, '', 'p', {binomial_p('low', 'n')} FROM two
  UNION ALL SELECT 'AnovaTest', printf('%.2f', std_bucket), '', 'n_features', n_features FROM anova
  UNION ALL SELECT 'AnovaTest', printf('%.2f', std_bucket), '', 'f', f FROM anova
  UNION ALL SELECT 'AnovaTest', printf('%.2f', std_bucket), '', 'p', p FROM anova)
"""

ORACLE["general_testing_report"] = f"""{REPORT}
SELECT section, item, other, metric, {r6('value')} AS value FROM report"""


def first_rows(section: str, metric: str, column: str, value: str, order: str) -> str:
    return f"""(SELECT coalesce(to_json(list({{'feature': item, '{column}': {value}}} ORDER BY value {order}, item))::VARCHAR, '[]')
  FROM (SELECT * FROM report WHERE section = '{section}' AND metric = '{metric}' ORDER BY value {order}, item LIMIT 3))"""


MILLIONTHS = "round(value*1e6)::BIGINT"
ORACLE["general_testing_document"] = f"""{REPORT}
SELECT (SELECT to_json({{'n_features': n_features, 'n_binary': n_binary, 'n_numerical': n_numerical,
    'n_categorical': n_categorical, 'n_other': n_other, 'n_normal': n_normal, 'n_unknown': n_unknown}})::VARCHAR FROM numbers) AS numbers,
  {first_rows('BinomialTest', 'p', 'p', MILLIONTHS, 'ASC')} AS binomial,
  {first_rows('ChiSquareTest', 'p', 'p', MILLIONTHS, 'ASC')} AS chi_square,
  {first_rows('NumberOfNAs', 'n_na', 'n_na', 'value::BIGINT', 'DESC')} AS missing,
  (SELECT count(*) FROM report WHERE section = 'BinomialTest') AS n_binomial,
  (SELECT count(*) FROM report WHERE section = 'ChiSquareTest' AND metric = 'p') AS n_chi_square,
  (SELECT count(*) FROM report WHERE section = 'NumberOfNAs') AS n_missing,
  (SELECT count(*) FROM report WHERE section = 'AnovaTest' AND metric = 'p') AS n_anova, 'Completed' AS status"""
