import pytest

from cohortlens.llm import url_filter as u
from tests.compare import difference, duck
from tests.llm.helpers import SF

CASES = [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/casino", "", "", None, "block"),
    ("http://a.example.NET/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/de/?q=/en/", "example.net", "/de/", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("http://x.example.com/de/a#casino", "x.example.com", "/de/a", "example.com/de/", "block"),
    ("http://casino.org/fr/", "casino.org", "/fr/", "org/fr/", "allow"),
    ("http://casino.org/en/", "casino.org", "/en/", None, "block"),
    ("http://casinova.org/en/", "casinova.org", "/en/", None, "allow"),
    ("http://a.org/free-free", "a.org", "/free-free", None, "allow"),
    ("http://a.org/FREE-bets", "a.org", "/FREE-bets", None, "block"),
    ("http://a.org/freebets", "a.org", "/freebets", None, "allow"),
    ("http://a.org/fréee-éfree", "a.org", "/fréee-éfree", None, "allow"),
    ("a://b://casino/x", "b:", "//casino/x", None, "block"),
    ("http://a.org/%63asin%6F/x", "a.org", "/%63asin%6F/x", None, "block"),
    ("http://a.org/%43ASINO%zz", "a.org", "/%43ASINO%zz", None, "block"),
    ("http://a.org/fr%65e%20b%65t", "a.org", "/fr%65e%20b%65t", None, "block"),
    ("http://a.org/xx%78x", "a.org", "/xx%78x", None, "allow"),
    ("http://a.org\n/x?free", "a.org\n", "/x", None, "allow"),
]


def test_cases(spark):
    rows = [(k, c[0], "clash") for k, c in enumerate(CASES)] * 2
    got = u.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        assert (r["url"], r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["page_id"]]


def test_long_url_empty_table_and_empty_vocabulary(spark):
    long = "http://a.org/" + "x" * 200_000 + "/casino"
    pages = spark.createDataFrame([(1, long)], "page_id long, url string")
    assert u.judge_urls(pages).first()["verdict"] == "block"
    assert u.judge_urls(pages, weights={"nothing": 2}).first()["verdict"] == "allow"
    assert u.judge_urls(pages.where("false")).count() == 0


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_the_sql(spark, sf):
    assert difference(u.query(spark, sf), duck(sf), u.ORACLE) is None


def test_thousands_of_terms_from_a_table(spark):
    """A vocabulary table against a plain search of every term."""
    import random
    import re

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdeiou") for _ in range(rng.randrange(3, 8))) for _ in range(9000)})
    rows = [(w.upper() if k % 9 == 0 else w, 2 if k % 40 == 0 else 1, ["en", "de", None][k % 3]) for k, w in enumerate(words)]
    rows += [(words[5], 2, "en"), (None, 1, "en"), (" ", 2, "en"), (words[7], 0, "en"), (words[8], None, "en"), ("größe", 2, "de")]
    table = spark.createDataFrame(rows, "term string, weight int, language string")
    every, some = u.read_vocabulary(table), u.read_vocabulary(table, ["de"])
    assert len(every) == len(words) + 1 and every[words[5]] == 2 and set(some) < set(every) and "größe" in some
    urls = ["http://a.org/" + rng.choice(["-", "/", "", "%2D"]).join(rng.choice(words) for _ in range(4)) for _ in range(300)]
    urls.append("http://a.org/Gr%C3%B6%C3%9Fe")
    got = u.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), weights=every).collect()
    for r in got:
        tokens = set(re.findall(r"[^\W_]+", u.unquote(r["url"]).lower()))
        hit = {t: every[t] for t in tokens & every.keys()}
        assert (r["n_strict"], r["n_soft"]) == (sum(w >= 2 for w in hit.values()), sum(w < 2 for w in hit.values())), r["url"]
        assert r["verdict"] == ("block" if sum(hit.values()) >= 2 else "allow")
