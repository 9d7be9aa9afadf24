import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import lexical_search as ls
from cohortlens.llm import queries
from tests.compare import difference, duck
from tests.llm.helpers import SF, changed, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, top=10):
    counts = [(doc, Counter(words(t))) for doc, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, c), size in zip(counts, sizes):
            score = 0
            for t in words(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * size * n // length)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def ranks(spark, docs, items, **options):
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rank int, score string")
    asked = spark.createDataFrame([(*i, 0.5) for i in items], "item_id long, text string, term double")
    return sorted(map(tuple, ls.ranked(table.repartition(4), asked, **options).collect()), key=str)


def test_query_equals_sql(spark):
    assert difference(queries.QUERIES["op11_lexical_search"](spark, SF), duck(SF), ls.ORACLE) is None


@pytest.mark.parametrize("block,round_", [(32_768, 16), (7, 1)])
def test_ranks_equal_brute_force(spark, monkeypatch, block, round_):
    """Ties, repeated rows, null ids and texts, other scripts, a very long text, repeated terms."""
    monkeypatch.setattr(ls, "BLOCK_DOCS", block)
    monkeypatch.setattr(ls, "FIRST_ROUND", round_)
    docs = [(k, prose(10 + 7 * (k % 9), k)) for k in range(60)]
    docs += [(100 + k, docs[3][1]) for k in range(15)] + [(3, docs[3][1]), (None, docs[3][1]), (None, docs[5][1])]
    docs += [(200, None), (201, ""), (202, "-- !! \x00"), (203, "Straße ÉCOLE école Привет 42"), (204, prose(40_000, 9))]
    items = [(1, docs[3][1]), (2, changed(docs[5][1], 3, 1)), (3, "STRASSE straße École привет Привет 42 42 42"),
             (4, None), (5, "zzz"), (6, "the and of " * 5), (2, docs[7][1]), (None, "the stone")]
    got = ranks(spark, docs, items)
    assert got == brute(docs, items)
    assert sorted(r[1] for r in got if r[0] == 1) == list(range(1, 11))


def test_batches_of_items_do_not_change_ranks(spark, monkeypatch):
    docs = [(k, prose(30, k)) for k in range(40)]
    items = [(k, prose(6, 100 + k)) for k in range(9)]
    whole = ranks(spark, docs, items, top=3)
    monkeypatch.setattr(ls, "ITEM_BYTES", 120)
    assert ranks(spark, docs, items, top=3) == whole == brute(docs, items, 3)


def test_empty_tables(spark):
    assert ranks(spark, [], [(1, "stone")]) == [] and ranks(spark, [(1, "stone")], []) == []


def test_search_stops_before_the_ends_of_the_lists():
    """One document has all rare terms: the sum behind the best positions falls below its score long
    before the lists end, and every position up to the best one has been seen."""
    rows = [(k, 50, [0, 1], [1 + k % 3, 1]) for k in range(5000)] + [(9000 + k, 50, [0, 1, 2], [9, 9, 9]) for k in range(3)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))],
        names=["doc_id", "n", "term", "tf"])
    lists = ls.ImpactLists([batch], 5003, 5003 * 50)
    reads = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop - key.start)
            return np.asarray(super().__getitem__(key))

    lists.doc = lists.doc.view(Counting)
    item = ls.Item(1, np.array([0, 1, 2]), np.array([10, 10, 900]))
    docs, scores = ls.best_documents(lists, item, 3, 0)
    assert set(lists.key[docs]) == {9000, 9001, 9002} and len(set(scores)) == 1
    assert sum(reads) < 1000 and all(np.diff(lists.impact[slice(*lists.span(0))]) <= 0)
    # an equal score elsewhere is met as well: the search only stops strictly below the kth score
    everyone, equal = ls.best_documents(lists, ls.Item(1, np.array([1]), np.array([5])), 2, 0)
    assert len(everyone) == 3 and len(set(equal)) == 1
