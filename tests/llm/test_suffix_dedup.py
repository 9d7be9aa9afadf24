import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import suffix_dedup as sd
from cohortlens.llm import queries
from cohortlens.llm.suffix_sort import Suffixes
from tests.compare import difference, duck
from tests.llm.helpers import SF, prose


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by counting every string of 200 bytes."""
    raws = [(t or "").encode() for _, t in rows]
    times = Counter(r[i:i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for (doc, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - 199):
            if times[raw[i:i + 200]] > 1:
                gone[i:i + 200] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def left(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, digest string")
    got = sd.without_repeats(table.repartition(3)).collect()
    for r in got:
        assert r["n_removed"] == sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_bytes"] - len(r["kept"])
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
                   for r in got], key=str)


@pytest.mark.parametrize("letters", [b"ab", b"a", b"abc", bytes(range(256)), b"\x00\xff"])
def test_two_stage_sort(letters):
    rng = random.Random(len(letters))
    for _ in range(60):
        text = bytes(rng.choice(letters) for _ in range(rng.randrange(1, 150)))
        wanted = np.zeros(len(text) + 2, dtype=bool)
        wanted[:len(text)] = [rng.random() < 0.6 for _ in text]
        found = Suffixes(text, wanted, 16)
        padded = text + b"\x00\xff" + bytes(24)
        keys = [padded[i:i + 16] for i in found.order]
        assert keys == sorted(keys) and len(set(found.order.tolist())) == len(keys)
        assert set(np.flatnonzero(wanted)) <= set(found.order.tolist())
        for k in range(1, len(keys)):
            same = next((i for i in range(16) if keys[k][i] != keys[k - 1][i]), 16)
            assert found.common[k] == same // 8 * 8


def test_greater_suffixes_are_placed_not_sorted(monkeypatch):
    sorted_directly = []
    inner = Suffixes._sorted
    monkeypatch.setattr(Suffixes, "_sorted", lambda self, starts, depth: sorted_directly.extend(starts) or inner(self, starts, depth))
    text = prose(400, 3).encode()
    found = Suffixes(text, np.append(np.ones(len(text), dtype=bool), [False, False]), 200)
    assert all(text[i:] < text[i + 1:] for i in sorted_directly if i < len(text) - 1)
    assert len(sorted_directly) < 0.6 * len(found.order)
    assert found.order[found.order < len(text)].tolist() == sorted(range(len(text)), key=lambda i: text[i:] + b"\x00\xff")


def fixture():
    rng = random.Random(5)
    passage, other = prose(45, 1), prose(80, 2)
    rows = [(k, prose(rng.randrange(20, 200), 100 + k)) for k in range(25)]
    rows += [(100 + k, prose(30, 200 + k) + " " + passage + " " + prose(25, 300 + k)) for k in range(30)]
    rows += [(200, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, None), (201, None), (202, ""), (203, "short")]
    rows += [(204, other + other), (205, "a" * 900), (206, "ab" * 300 + "c" + "ab" * 300), (207, "é" * 150 + "x" + "é" * 150)]
    rows += [(208, passage[:150] + "Q" + passage[151:]), (209, prose(30_000, 7)), (210, passage[:199]), (211, passage[:200]),
             (212, prose(60, 8) + other[40:300]), (213, "x\x00y" * 100)]
    return rows


@pytest.mark.parametrize("group,piece", [(4_000_000, 1 << 17), (2500, 1 << 17), (4_000_000, 700)])
def test_equals_brute_force(spark, monkeypatch, group, piece):
    """Copies, shared passages, repeats in one text, periods of one and two bytes, seams between
    pieces, and anchors spread over several groups."""
    monkeypatch.setattr(sd, "GROUP_BYTES", group)
    monkeypatch.setattr(sd, "PIECE", piece)
    rows = fixture()
    want = brute(rows)
    assert left(spark, rows) == want and sum(r[2] for r in want) > 10_000


def test_a_hot_anchor_is_spread_over_groups(spark, monkeypatch):
    """Of an anchor that nearly all documents share with different neighbours, windows are told apart
    in several tasks and counted together."""
    monkeypatch.setattr(sd, "GROUP_BYTES", 6000)
    passage = prose(50, 11)
    rows = [(k, prose(12, 1000 + k % 40) + str(k % 60) + " " + passage + " " + prose(12, 2000 + k % 35)) for k in range(150)]
    assert left(spark, rows) == brute(rows)


def test_query_over_the_table(spark):
    got = queries.QUERIES["op12_suffix_dedup"](spark, SF)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got.collect()), key=str) == brute([tuple(r) for r in rows])
    assert difference(got, duck(SF), sd.ORACLE) is None


def test_empty_table(spark):
    assert left(spark, []) == []
