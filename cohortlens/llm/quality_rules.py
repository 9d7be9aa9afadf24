"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import BLANKS, table

#: Fixed values of the base rule.
WINDOW, LEAST_WORDS, REPEAT_PERCENT, SYMBOLS = 8, 20, 30, "[#*$%&|<>]"
#: Frequent short words, by language; any of them counts.
STOP_WORDS = (
    "the of and to in is that it was for on are with as at be this have from or by an "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es "
    "le la les de des un une et est que pour dans qui sur pas au par avec il "
    "el los las y que en por con para una del se no su al lo como"
).split()

#: The same of further languages in Latin letters.
FURTHER_STOP_WORDS = (
    "il di che non per della sono con dei nel è più questo anche gli "
    "o os da do dos das em não uma mais foi ao como mas "
    "het een van niet dat voor met zijn op ook maar wordt door naar "
    "och att det som för på är av inte den til ikke og jeg har fra "
    "nie się na jest że do jak ale przez są oraz co v ve je že se by jako "
    "bir bu için ile olarak daha çok gibi ja ei hän oli mutta kuin että niin ovat "
    "és egy hogy nem az volt meg și nu este care din mai cu "
    "yang dan dengan untuk dari ini itu tidak pada là của và có cho không những các được"
).split()
#: Letters of these languages; the rule of stop words is for texts mainly in such letters.
LISTED_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff"


@dataclass(frozen=True)
class Rule:
    """A document fails when `measure` lies outside [low, high]; None is no bound."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios are per word, per character or per line; bounds lie far from plain prose.
RULES = (
    Rule("mean_word_chars", 1.5, 25.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("symbol_char_share", None, 0.05),
    Rule("dup_line_share", None, 0.6),
    Rule("stop_word_share", 0.005, None),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight that occur at least twice in the text.

    Hashes of windows only decide whether any window can repeat; where one may, the windows
    themselves are sorted, so the count is exact. Both need no more than n log n steps.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - WINDOW)

    def at(values: Column, i: Column) -> list[Column]:
        return [F.get(values, i + k) for k in range(WINDOW)]

    def doubled(hashes: Column, span: int) -> Column:
        """Hashes of twice as many words; an array in an array is bound once by transform."""
        return F.transform(hashes, lambda h: F.transform(
            h, lambda x, i: F.xxhash64(x, F.get(h, i + span))))

    hashed = F.array(F.transform(words, lambda w: F.xxhash64(w)))
    for span in (1, 2, 4):
        hashed = doubled(hashed, span)
    hashed = F.transform(hashed, lambda h: F.slice(h, 1, n - (WINDOW - 1)))
    unique = F.transform(hashed, lambda h: F.size(F.array_distinct(h)))[0]
    windows = F.sort_array(F.transform(
        starts, lambda i: F.struct(F.array(*at(words, i)).alias("w"), i.alias("i"))))

    def twice(ordered: Column) -> Column:
        def same(k: Column, step: int) -> Column:
            other = F.try_element_at(ordered, k + 1 + step)["w"]
            return F.coalesce(other == F.element_at(ordered, k + 1)["w"], F.lit(False))

        hit = F.filter(ordered, lambda _, k: F.when(k > 0, same(k, -1)).otherwise(F.lit(False))
                       | same(k, 1))
        return F.array_sort(F.transform(hit, lambda s: s["i"]))

    def covered(positions: Column) -> Column:
        gaps = F.transform(positions, lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.try_element_at(positions, k + 2) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)

    ordered = F.transform(F.array(windows), twice)
    exact = F.transform(ordered, covered)[0]
    short = n < WINDOW
    return F.when(short, 0).when(
        unique == n - (WINDOW - 1), 0).otherwise(exact).cast("long")


def mainly_listed(whole: Column) -> Column:
    """Half of the letters at least are of LISTED_LETTERS. Most texts have no other letter at all,
    which is quicker to see than the shares."""
    some_other = whole.rlike(f"[\\p{{L}}&&[^{LISTED_LETTERS}]]")
    return F.when(F.octet_length(whole) == F.length(whole), True).when(~some_other, True).otherwise(
        F.length(F.regexp_replace(whole, f"[^{LISTED_LETTERS}]+", "")) * 2
        >= F.length(F.regexp_replace(whole, "[^\\p{L}]+", "")))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct column `quality` with the base counts and the ratios of the rules.

    Null text counts as empty; ratios of an empty text are null and break no rule, as such a text
    fails the base rule anyway.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = words_of(whole)
    step = docs.withColumn("quality", F.struct(
        words.alias("words"),
        F.filter(F.split(whole, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).alias("n_symbols"),
        F.length(whole).alias("chars"),
        mainly_listed(whole).alias("listed"),
    ))
    q = F.col("quality")
    step = step.withColumn("quality", F.struct(
        F.size(q.words).cast("long").alias("n_words"),
        F.length(F.array_join(q.words, "")).cast("long").alias("word_chars"),
        q.n_symbols.cast("long").alias("n_symbols"),
        (F.size(q.lines) - F.size(F.array_distinct(q.lines))).cast("long").alias("n_dup_lines"),
        repeated_words(q.words).alias("n_repeat_words"),
        F.size(q.lines).alias("n_lines"),
        F.size(F.filter(q.words, lambda w: F.lower(w).isin(STOP_WORDS + FURTHER_STOP_WORDS))).alias("n_stop"),
        q.chars.alias("chars"), q.listed.alias("listed"),
    ))
    return step.withColumn("quality", F.struct(
        q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words,
        F.try_divide(q.word_chars, q.n_words).alias("mean_word_chars"),
        F.try_divide(q.n_symbols, q.n_words).alias("symbols_per_word"),
        F.try_divide(q.n_symbols, q.chars).alias("symbol_char_share"),
        F.try_divide(q.n_dup_lines, q.n_lines).alias("dup_line_share"),
        F.when(q.listed, F.try_divide(q.n_stop, q.n_words)).alias("stop_word_share"),
    ))


def verdict(quality: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(base_failed, kept) of a `quality` struct."""
    base = (quality.n_words < LEAST_WORDS) | (
        quality.n_repeat_words * 100 > quality.n_words * REPEAT_PERCENT)
    broken = F.lit(False)
    for rule in rules:
        value = quality[rule.measure]
        if rule.low is not None:
            broken = broken | F.coalesce(value < rule.low, F.lit(False))
        if rule.high is not None:
            broken = broken | F.coalesce(value > rule.high, F.lit(False))
    return base, ~base & ~broken


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with `quality`, `base_failed` and `kept`; a column of these names is replaced.

    One projection, no shuffle: a hot source, copies and repeated rows cost what other rows do.
    Null or empty text: zero counts, base_failed, not kept.
    """
    base, kept = verdict(F.col("quality"), rules)
    return measures(docs, text).withColumns({"base_failed": base, "kept": kept})


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with their columns."""
    judged = judge(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text")))
    # exploding an optional one-element array filters without the filter being pushed below the
    # projection, which would compute the measures twice
    one = F.when(F.col("kept"), F.array(F.col("row"))).otherwise(F.array().cast(
        judged.select(F.array("row").alias("r")).schema["r"].dataType))
    return judged.select(F.explode(one).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = F.col("quality")
    return judge(docs).select(
        "doc_id", q.n_words.alias("n_words"), q.word_chars.alias("word_chars"),
        q.n_symbols.alias("n_symbols"), q.n_dup_lines.alias("n_dup_lines"),
        q.n_repeat_words.alias("n_repeat_words"), "base_failed", "kept")


def sql(source: str = "documents") -> str:
    """DuckDB: the base counts and the rules over `source`, as columns of `judged`."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS + FURTHER_STOP_WORDS)))
    bounds = " AND ".join(
        [f"coalesce({r.measure} >= {r.low}, true)" for r in RULES if r.low is not None]
        + [f"coalesce({r.measure} <= {r.high}, true)" for r in RULES if r.high is not None])
    return f"""
q_texts AS (SELECT row_number() OVER () AS rid, s.*, coalesce(s.text, '') AS whole FROM {source} s),
q_words AS (SELECT *, list_filter(regexp_split_to_array(whole, '[\\x20\\x09-\\x0D]+'),
        lambda w: w <> '') AS words,
    list_filter(string_split(whole, chr(10)),
        lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM q_texts),
q_windows AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM q_words),
q_grams AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i:i + 7]) AS times FROM q_windows),
q_hits AS (SELECT DISTINCT rid, i + k AS p FROM q_grams, range(8) AS r(k) WHERE times > 1),
q_repeat AS (SELECT rid, count(*) AS n FROM q_hits GROUP BY rid),
q_counts AS (SELECT w.*, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(whole) - length(regexp_replace(whole, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS n_stop
    FROM q_words w LEFT JOIN q_repeat r USING (rid)),
q_ratios AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars,
    n_symbols / nullif(n_words, 0) AS symbols_per_word,
    n_symbols / nullif(length(whole), 0) AS symbol_char_share,
    n_dup_lines / nullif(len(lines), 0) AS dup_line_share,
    CASE WHEN 2 * length(regexp_replace(whole, '[^{LISTED_LETTERS}]+', '', 'g'))
        >= length(regexp_replace(whole, '[^\\p{{L}}]+', '', 'g')) THEN n_stop / nullif(n_words, 0) END AS stop_word_share,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q_counts),
judged AS (SELECT *, NOT base_failed AND {bounds} AS kept FROM q_ratios)"""


ORACLE = f"""WITH {sql().strip()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
FROM judged"""
