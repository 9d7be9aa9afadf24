import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlens.llm import packing as p
from tests.llm.helpers import SF, documents, prose

TEXTS = [None, "", " ", "a", "a  b", "a   b\n\n c", " lead", "trail ", "tab\tx \n y", "it's we'll, 'tis.", "x<|endoftext|> y",
         "ñandú çé ß 漢字 😀 \u00a0x \u2003 y\x1c z", prose(3000, 1), "," * 5000, "z" * 20000, prose(50, 2), prose(50, 2)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(p.VOCABULARY)


def checked(rows, expected):
    """Every id in exactly one piece, sequences gapless and within the length."""
    for doc, ids in expected.items():
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= p.LENGTH
    return sequences


def test_pieces_hold_the_ids_of_the_library(spark, tokenizer):
    expected = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in enumerate(TEXTS)}
    checked(p.pack_documents(documents(spark, TEXTS)).collect(), expected)
    assert p.pack_documents(documents(spark, [])).count() == 0
    full = p.pack_documents(documents(spark, TEXTS[:4]), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in full} == {k: expected[k] for k in range(4)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab.,'s1é漢\u00a0\x1c", max_size=30), max_size=6))
def test_segments_give_the_ids_of_whole_texts(texts):
    tokenizer = Tokenizer.from_file(p.VOCABULARY)
    for text, ids in zip(texts, p.memory(p.VOCABULARY).encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=60))
def test_tree_packs_as_plain_first_fit_decreasing(lengths):
    where, offset = p.first_fit_decreasing(np.array(lengths), 16)
    room, expected = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        b = next((b for b, r in enumerate(room) if r >= lengths[k]), len(room))
        room += [16] * (b == len(room))
        expected[k] = (b, 16 - room[b])
        room[b] -= lengths[k]
    assert {k: (int(a), int(b)) for k, (a, b) in enumerate(zip(where, offset))} == expected


def test_query_wastes_little(spark, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = p.query(spark, SF).collect()
    expected = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in docs.items()}
    sequences = checked(rows, expected)
    assert sum(map(len, expected.values())) / (p.LENGTH * len(sequences)) > 0.98


def test_repeated_rows_and_rows_without_id_spread_over_the_groups(spark):
    """A third of all rows are one row, another third have neither id nor text."""
    rows = [(7, "the same text", 0)] * 2000 + [(None, None, 1)] * 2000 + [(100 + k, f"text {k}", 2) for k in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _group int").repartition(5)
    packed = p.pack(p.pieces(table), 40).collect()
    sizes = np.bincount([r["sequence_id"] >> 32 for r in packed], minlength=40)
    assert len(packed) == 6000 and sizes.max() <= 2 * sizes.mean() and sizes.min() > 0
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        assert [a for a, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
    again = p.pack(p.pieces(table), 40).collect()
    assert sorted(map(str, again)) == sorted(map(str, packed))


def test_single_words_have_the_ids_of_the_library(tokenizer):
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    words = [lead + a + b for lead in ("", " ") for a in letters for b in ("", "e", "ß", "Ġ", "ÿ")]
    words += [" internationalization", "Straßenbahnhaltestelle", " ñandúes", "x" * 3000]
    other = ["", " ", "  a", "a b", "漢字", " it's", "a1", "\na", "ab ", "a\u0301"]
    assert all(map(p.one_word, words)) and not any(map(p.one_word, other))
    found = p.memory(p.VOCABULARY).learn(words + other)
    assert found == [e.ids for e in tokenizer.encode_batch(words + other, add_special_tokens=False)]


def test_parts_are_looked_up_once_a_batch_and_texts_may_be_null(tokenizer):
    """Repeated parts reach the memory and the tokenizer once, whatever text of the batch holds them."""
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    texts = [None, "", " ", "stone river", "river stone river"] * 50 + ["stone\n river", " stone"]
    memory = p.SegmentMemory(p.memory(p.VOCABULARY).learn)
    expected = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for again in range(2):
        memory.number = Counted(memory.number)
        Counted.asked = 0
        assert [ids.tolist() for ids in memory.encode(pa.array(texts))] == expected
        assert Counted.asked <= 6
    assert [ids.tolist() for ids in memory.encode(pa.array(texts).slice(3, 9))] == expected[3:12]


def test_groups_are_packed_in_arrow(spark):
    """No row of a group becomes a Python object; its ids stay as they are."""
    packed = p.pack_documents(documents(spark, TEXTS), with_ids=True)
    assert "FlatMapGroupsInArrow" in packed._jdf.queryExecution().toString()
    for r in packed.collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_words_of_one_kind_are_encoded_in_one_text(tokenizer):
    """Behind a space or not; of the ids of each, none stands for what parts them."""
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    for lead in ("", " "):
        words = [lead + a + b for a in letters for b in ("", "e", "ß", "Ġ", "Ċ", "ÿ")] * 3
        sizes, ids = p.memory(p.VOCABULARY).words(words)
        expected = [e.ids for e in tokenizer.encode_batch(words, add_special_tokens=False)]
        assert sizes.tolist() == [*map(len, expected)] and ids.tolist() == sum(expected, [])


def test_words_around_line_ends_are_learnt_once(tokenizer):
    """Lines that end and begin with ever other pairs of words ask the tokenizer for no pair."""
    ends, begins = ["stone", "river", "ñandú", "a"], ["Moss", "Fern", "a", "Über"]
    between = ["\n", ".\n\n", "!?\n", "\n\n\n", ",\n\n"]
    texts = [f"x {a}{b}{c}{t} y{b}{c}" for a in ends for b in between for c in begins for t in ("", ".", "?!")]
    asked = []

    def learn(segments):
        asked.extend(segments)
        return p.memory(p.VOCABULARY).learn(segments)

    memory = p.SegmentMemory(learn)
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in memory.encode(texts)] == expected
    assert not any("\n" in s and len(s.strip(".,;:!?\n")) > 1 for s in asked) and len(asked) < 25
    whole = [*ends, *begins, *between, *(b + "a" for b in between), "a\n", "\na", "a\n\nb\nc", "a\n1", "a.\n b"]
    assert [i.tolist() for i in memory.encode(whole)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in whole]
