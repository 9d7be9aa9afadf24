import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import byte_bpe as b
from tests.llm.helpers import SF, documents, prose

TEXTS = [None, "", " ", "  ", "a", "it's we'll don'T", "a   b\n\n  c\t", "tab nb em\x1cfs\x85nel", "漢字かな ñandú ß 😀👍🏽",
         "x" * 300 + " " + "ab" * 4000, "<|endoftext|> 123456789", prose(800, 1), prose(9, 2), prose(9, 2), "\n" * 50 + "é" * 700]

RANKS = b.read_ranks(b.VOCABULARY)
PAIRS = b.pair_ranks(RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=b.read_ranks(b.VOCABULARY), special_tokens={})


def test_ids_equal_the_library_and_decode_gives_the_text(spark, library):
    encoded = b.encode(documents(spark, TEXTS).repartition(2))
    rows = encoded.withColumn("bytes", b.decode(encoded["ids"])).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text), text[:30]
        assert bytes(r["bytes"]) == text.encode()
    assert b.encode(documents(spark, [])).count() == 0


def test_query_digests(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = b.query(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_pattern_splits_every_character_alike(library):
    single = {bytes([k]): k for k in range(256)}
    split = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=single, special_tokens={})
    ranks = b.read_ranks(b.VOCABULARY)
    assert split.n_vocab == 256 and len(ranks) == 50256
    for code in [*range(0x3100), 0xFEFF, 0x1F600, 0x10400]:
        if 0xD800 <= code < 0xE000:
            continue
        text = f"a {chr(code)}1 {chr(code)}{chr(code)}b"
        ids = [i for w in b.PATTERN.findall(text) for i in library.encode_ordinary(w)]
        assert ids == library.encode_ordinary(text), hex(code)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=80))
def test_heap_merges_as_the_plain_rule(data):
    ids = [RANKS[bytes([c])] for c in data]
    expected = list(ids)
    while True:
        found = [(PAIRS[p], k) for k, p in enumerate(zip(expected, expected[1:])) if p in PAIRS]
        if not found:
            break
        rank, k = min(found)
        expected[k:k + 2] = [rank]
    assert b.merged(ids, PAIRS) == expected


def test_words_start_afresh_and_rows_stay_small(spark, library, monkeypatch):
    """Words are folded once a task, numbers start again when there are too many, and no row holds
    more than a document or a word."""
    texts = [prose(60, k % 7) if k % 5 else None for k in range(300)] + ["w" * 600, "", prose(60, 1)]
    docs = documents(spark, texts).coalesce(1)
    rows = b.stream(docs, b.VOCABULARY, "doc_id", "text").collect()
    numbers = [r["number"] for r in rows if r["number"] is not None]
    assert numbers == list(range(len(numbers))) and len(rows) == len(numbers) + len(texts)
    for limits in ((40, 300_000, 1 << 19), (500_000, 25, 30)):
        for name, limit in zip(("NUMBERED", "SEGMENTS", "UNFOLD_WORDS"), limits):
            monkeypatch.setattr(b, name, limit)
        found = {r["doc_id"]: r["ids"] for r in b.encode(docs).collect()}
        assert found == {k: library.encode_ordinary(t or "") for k, t in enumerate(texts)}
    monkeypatch.setattr(b, "NUMBERED", 40)
    assert sum(r["number"] == 0 for r in b.stream(docs, b.VOCABULARY, "doc_id", "text").collect()) > 1


def test_bytes_of_the_ids_come_with_them(spark, monkeypatch):
    """Tokens of several bytes, characters cut between tokens, empty rows, and runs of few words."""
    docs = documents(spark, TEXTS).coalesce(1)
    for limit in (1 << 19, 9):
        monkeypatch.setattr(b, "UNFOLD_WORDS", limit)
        rows = b.encode(docs, with_bytes=True).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(len(TEXTS)))
        for r in rows:
            assert bytes(r["decoded"]) == (TEXTS[r["doc_id"]] or "").encode()
            assert bytes(r["raw"]) == np.array(r["ids"], "<u4").tobytes()


def test_one_pass_over_the_tokens_of_a_word_merges_as_the_heap(spark):
    """Words of random letters, repeated runs and cut characters; a step of the fold for each token that
    occurs in the word, not for each pair of neighbours at each merge."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeinrst thé漢"), n)).strip() or "x" for n in rng.integers(1, 60, 400)]
    words += ["aaaaaaa", "thethethe", " in", "ininin", "x" * 256, "é" * 100, "漢字" * 30]
    tree, data = b.TokenTree(RANKS), [w.encode() for w in words]
    ends = np.cumsum([*map(len, data)])
    found, counts = tree.found(np.frombuffer(b"".join(data), np.uint8), ends, ends - [*map(len, data)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    chars = [b.written(np.array([RANKS[bytes([c])] for c in d])) for d in data]
    rows = []
    for k, d in enumerate(data):
        own = found[bounds[k]:bounds[k + 1]].tolist()
        inside = {d[i:j] for i in range(len(d)) for j in range(i + 2, len(d) + 1)}
        assert own == sorted(RANKS[t] for t in inside if t in RANKS)
        rows.append((k, chars[k], own))
    table = spark.createDataFrame(rows, "k int, chars string, found array<int>")
    folded = table.select("k", b.fold_merges(table["chars"], table["found"], b.rank_map(b.halves(b.VOCABULARY))).alias("ids"))
    for r in folded.collect():
        ids, _ = b.numbers(pa.array([r["ids"]]))
        assert ids.tolist() == b.merged([RANKS[bytes([c])] for c in data[r["k"]]], PAIRS)


def test_ids_travel_as_text():
    ids = np.array([0, 127, 128, 2047, 2048, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFFFF, 0x10000, 0x10F7FF])
    texts = b.strings(ids, np.array([3, 0, 5, 4]))
    assert texts.to_pylist() == [b.written(ids[:3]), "", b.written(ids[3:8]), b.written(ids[8:])]
    found, sizes = b.numbers(texts.slice(1))
    assert found.tolist() == ids[3:].tolist() and sizes.tolist() == [0, 5, 4]


def test_a_vocabulary_whose_merges_fall(spark, tmp_path):
    """`abc` is made over `bc`, which has a higher rank than it; `dxe` by no merge."""
    tokens = [*(bytes([k]) for k in range(256)), b"abc", b"bc", b"dxe"]
    path = str(tmp_path / "own.tiktoken")
    (tmp_path / "own.tiktoken").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.read_ranks(path), special_tokens={})
    texts = ["abc abcabc bcbc", "dxe dxedxe", None, "é" * 300]
    assert {r["doc_id"]: r["ids"] for r in b.encode(documents(spark, texts), path).collect()} == {
        k: own.encode_ordinary(t or "") for k, t in enumerate(texts)}


def test_new_words_travel_some_at_a_time(spark, library, monkeypatch):
    texts = [prose(200, 1) + " " + "w" * 300, prose(50, 2)]
    monkeypatch.setattr(b, "NEW_WORDS", 7)
    docs = documents(spark, texts).coalesce(1)
    numbers = [r["number"] for r in b.stream(docs, b.VOCABULARY, "doc_id", "text").collect() if r["number"] is not None]
    assert numbers == list(range(len(numbers))) and len(numbers) > 7
    assert {r["doc_id"]: r["ids"] for r in b.encode(docs).collect()} == {k: library.encode_ordinary(t) for k, t in enumerate(texts)}
