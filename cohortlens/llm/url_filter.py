"""URL filter: domain and path rules first, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import table


@dataclass(frozen=True)
class Rule:
    """`verdict` for urls of `host` and its subdomains whose path starts with `path`."""

    host: str
    path: str
    verdict: str


#: Fixed values of the stated rules.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: A strict term rejects alone; of the soft terms several distinct ones are needed.
STRICT = ("porn", "xxx", "adult", "casino", "casinos", "spam", "viagra", "escort", "malware",
          "phishing", "warez", "jackpot")
SOFT = ("bet", "bets", "betting", "free", "win", "winner", "cheap", "pill", "pills", "ads", "ad",
        "track", "tracker", "farm", "sex", "sexy", "loan", "loans", "crack", "bonus", "poker",
        "dating", "click", "offer", "deal", "prize")
SOFT_WEIGHT, REJECT_WEIGHT = 1, 2
#: Terms of a vocabulary table at most; all of them go to every task.
MOST_TERMS = 1_000_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary() -> dict[str, int]:
    """Weight by term; a url is rejected when the weights of its distinct terms reach REJECT_WEIGHT."""
    return dict.fromkeys(SOFT, SOFT_WEIGHT) | dict.fromkeys(STRICT, REJECT_WEIGHT)


def read_vocabulary(terms: DataFrame, languages: Sequence[str] | None = None) -> dict[str, int]:
    """Weights of a table (term, weight, language), of all languages or of some and those rows without
    one. Terms are lower-cased (A-Z); of a repeated term the largest weight counts; null or empty terms
    and weights that are null or not positive are left out. More than MOST_TERMS terms are an error."""
    rows = terms if languages is None else terms.where(F.col("language").isin(list(languages)) | F.col("language").isNull())
    rows = rows.select(F.trim(lower_ascii(F.col("term"))).alias("term"), F.col("weight").cast("int").alias("weight"))
    rows = rows.where("term <> '' AND weight > 0").groupBy("term").agg(F.max("weight").alias("weight"))
    found = rows.limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms")
    return {r["term"]: r["weight"] for r in found}


def lower_ascii(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, lower-cased; path: from there up to ? # or
    the end. Both empty without :// or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return (lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(
            F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"),
        )).otherwise(chosen)
    return chosen


def term_counter(weights: dict[str, int], reject_weight: int = REJECT_WEIGHT):
    """Pandas UDF: url -> (distinct strict hits, distinct soft hits, weight) of whole terms, percent
    escapes decoded and A-Z lower-cased."""
    items = sorted(weights.items())

    @F.pandas_udf("n_strict long, n_soft long, weight long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term, weight in items:
            automaton.add_word(term, (term, weight))
        if items:
            automaton.make_automaton()
        for urls in batches:
            rows = []
            for url in urls:
                hits = {}
                if url and items:
                    url = (unquote(url) if "%" in url else url).translate(_LOWER)
                    for end, (term, weight) in automaton.iter(url):
                        start = end + 1 - len(term)
                        if (start == 0 or not url[start - 1].isalnum()) and (
                                end + 1 == len(url) or not url[end + 1].isalnum()):
                            hits[term] = weight
                strict = sum(w >= reject_weight for w in hits.values())
                rows.append((strict, len(hits) - strict, sum(hits.values())))
            yield pd.DataFrame(rows, columns=["n_strict", "n_soft", "weight"])

    return count


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES,
               weights: dict[str, int] | None = None) -> DataFrame:
    """`pages` with host, path, rule, n_strict, n_soft and verdict (columns of these names are
    replaced).

    One pass without a shuffle. Terms count where no letter or digit stands beside them, also where
    the url writes them with percent escapes. A null or empty url has no rule and no hit: allow.
    Repeated rows are judged alike. `weights` is a vocabulary of one's own, as from `read_vocabulary`.
    """
    weights = vocabulary() if weights is None else weights
    host, path = host_and_path(F.col(url))
    hits = term_counter(weights)(F.col(url))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("_hits.weight") >= REJECT_WEIGHT, "block").otherwise("allow")
    return (
        pages.withColumns({"host": host, "path": path, "_hits": hits})
        .withColumns({"_rule": rule})
        .withColumns({
            "rule": F.col("_rule.rule"), "n_strict": F.col("_hits.n_strict"),
            "n_soft": F.col("_hits.n_soft"), "verdict": F.coalesce(F.col("_rule.verdict"), method)})
        .drop("_hits", "_rule")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select(
        "page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def _oracle() -> str:
    def hit(term: str) -> str:
        return f"regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])')::BIGINT"

    strict, soft = (" + ".join(map(hit, terms)) for terms in (STRICT, SOFT))
    ranked = sorted(RULES, key=lambda r: -len(r.host + r.path))

    def rule(value) -> str:
        return "CASE " + " ".join(
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) "
            f"AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in ranked) + " END"

    return f"""
WITH parts AS (
    SELECT page_id, translate(url_decode(coalesce(url, '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS u,
        CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
judged AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        ({strict})::BIGINT AS n_strict, ({soft})::BIGINT AS n_soft
    FROM parts)
SELECT page_id, host, path, {rule(lambda r: r.host + r.path)} AS rule,
    coalesce({rule(lambda r: r.verdict)},
        CASE WHEN {REJECT_WEIGHT} * n_strict + {SOFT_WEIGHT} * n_soft >= {REJECT_WEIGHT}
            THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM judged"""


ORACLE = _oracle()
