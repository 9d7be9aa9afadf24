import itertools
import random

import pytest

from cohortlens.llm import minhash_dedup as m
from tests.llm.helpers import SF, changed, documents, prose


def by_hand(texts, like):
    """Components over all pairs of distinct sets."""
    sets = [m.shingle_set(t or "", like.width) for t in texts]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        union = len(sets[a] | sets[b])
        if sets[a] and sets[b] and 100 * common >= like.percent * union:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def agree(spark, texts, like, partitions=3):
    rows = m.near_duplicates(documents(spark, texts).repartition(partitions), like).collect()
    assert len(rows) == len(texts)
    expected = by_hand(texts, like)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    return expected


EDGES = [None, "", " \n", "one", "ONE", "one two", "One two", "two one", "a b c d e", "a b c d e f", "é É x y z", "é é x y z"]


def test_edge_cases(spark):
    agree(spark, EDGES * 2, m.Likeness(width=2))


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups_larger_than_the_hubs(spark, width):
    texts = [prose(60, k) for k in range(20)]
    for base, size, most in ((100, 70, 9), (101, 40, 4), (102, 25, 14)):
        text = prose(90, base)
        texts += [changed(text, k % most, base * 1000 + k) for k in range(size)]
    texts += [texts[3]] * 30 + [texts[4] + " end"]
    random.Random(4).shuffle(texts)
    agree(spark, texts, m.Likeness(width=width))


def test_a_passage_and_a_word_pair_that_all_share(spark):
    passage = prose(60, 77)
    texts = [passage + " " + prose(40, k) for k in range(80)] + [passage + " " + prose(8, k) for k in range(200, 260)]
    agree(spark, texts + ["in the end " + prose(12, 300 + k) for k in range(60)], m.Likeness(width=2))


def test_tiles_find_all_pairs_between_components(spark, monkeypatch):
    """Without any help of hubs the tiles alone connect what they should."""
    like = m.Likeness(width=2)
    monkeypatch.setattr(m, "TILE", 8)
    texts = [changed(prose(80, 5), 1 + k % 8, k) for k in range(60)] + [prose(30, 500 + k) for k in range(5)]
    docs = documents(spark, texts)
    sketched = m.sketches(docs, like, "doc_id", "text")
    sets = m.stored(sketched.groupBy("digest").agg(
        m.F.min("doc_id").alias("rep"), m.F.first("n_shingles").alias("n"), m.F.first("sketch").alias("sketch")))
    lists = m.with_hubs(m.inverted_lists(sets, like), m.TURNS[:1])
    expected = [e[1] for e in by_hand(texts, like)]
    for edges in ([], [(expected[k], k) for k in range(30) if expected[k] != k]):
        known = spark.createDataFrame(edges, "a long, b long")
        parts = m.stored(m.components(known))
        rest = m.stored(m.unresolved(lists, parts))
        pairs = m.across(rest, docs.select("doc_id", "text"), parts, like)
        checked = m.verified(pairs, docs.select("doc_id", "text"), like)
        got = {r["id"]: r["component"] for r in m.components(known.unionByName(checked).unionByName(
            m.verified(m.estimated(m.hub_pairs(lists), sets, like), docs.select("doc_id", "text"), like))).collect()}
        assert [got.get(k, k) for k in range(len(texts))] == expected


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    text = prose(40, 1)
    docs = spark.createDataFrame(
        [(None, text, 1), (4, text, 1), (2, text + " x", 1), (2, text + " x", 1), (9, None, 1), (None, None, 1)],
        "doc_id long, text string, component_id int")
    rows = m.near_duplicates(docs, m.Likeness(width=2)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [
        (-1, -1, True), (-1, -1, True), (2, 2, True), (2, 2, True), (4, 2, False), (9, 9, True)]
    assert m.near_duplicates(docs.where("false")).count() == 0


def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    expected = by_hand([r["text"] for r in docs], m.Likeness(width=2))
    for r in m.query(spark, SF).collect():
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]


def test_sketch_filter_passes_linked_pairs():
    like = m.Likeness(width=2)
    assert 30 <= like.sketch_overlap() <= 38
    assert like.least_overlap(10) == 8 and like.least_overlap(51) == 41 and like.least_overlap(500) == like.sketch_overlap()


def test_documents_of_few_words_do_not_meet(spark):
    """Word pairs that many documents share bring only like documents into one list (F1)."""
    like, rng = m.Likeness(width=2), random.Random(8)
    words = prose(40, 9).split()
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(150)]
    texts += [texts[0] + " end", texts[1] + " end"]
    docs = documents(spark, texts)
    sets = m.stored(m.sketches(docs, like, "doc_id", "text").select(
        m.F.col("doc_id").alias("rep"), m.F.col("n_shingles").alias("n"), "sketch"))
    met = {r["rep"] for r in m.with_hubs(m.inverted_lists(sets, like), m.TURNS[:1]).collect()}
    assert {0, 1, 150, 151} <= met and len(met) < 20
    agree(spark, texts, like)


def test_linked_sets_share_a_key():
    like, rng = m.Likeness(width=2), random.Random(3)
    assert m.Likeness(percent=100).bands() == 1 and like.bands() < m.Likeness(percent=70).bands()
    factors = m.band_factors(like)
    for n in (5, 45, 300, 3000):
        for _ in range(40):
            values = m.np.array([rng.getrandbits(64) for _ in range(n)], dtype=m.np.uint64).view(m.np.int64)
            a, b = m.np.sort(values[n // 10:]), m.np.sort(values[:n - n // 10])
            assert (m.band_keys(a, factors) == m.band_keys(b, factors)).any()


def test_hashed_shingles_are_those_of_the_words(monkeypatch):
    """Of all texts at once, of slices, with blanks anywhere and words of any length."""
    rng = random.Random(1)
    parts = ["a", "B", "é", "\x1c", "\x85", "\xa0", "İ", "x" * 7, "x" * 8, "x" * 9, "y" * 64, "y" * 65, *" \t\n\x0b\x0c\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(800)] + [None, ""]
    for width in (1, 2, 5):
        expected = [m.shingle_set(t or "", width) for t in texts]
        column = m.pa.array(texts)
        found = m.shingle_hashes(column, width)
        assert [len(s) for s in found] == [len(s) for s in expected]
        assert len({s.tobytes() for s in found}) == len(set(expected))
        codes = m.shingle_codes(column, width)
        assert all(len(a) == len(b) for a, b in zip(codes, expected, strict=True))
        for a, b in itertools.combinations(range(0, 800, 16), 2):
            assert len(set(codes[a].tolist()) & set(codes[b].tolist())) == len(expected[a] & expected[b])
        cut = m.shingle_hashes(column.slice(301, 200), width)
        assert all((a == b).all() for a, b in zip(cut, found[301:501], strict=True))
    batch = m.pa.record_batch([column], ["text"])
    monkeypatch.setattr(m, "PORTION", 40)
    assert sum((p.column(0).to_pylist() for p in m.portions([batch], "text")), []) == texts
