import zlib
from collections import Counter

import numpy as np

from cohortlens.llm import sharding as s
from tests.llm.helpers import SF, documents


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_plain_loop_and_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2 ** 64, 3000, dtype=np.uint64)
    for n in (1, 2, 8, 9, 100):
        now, grown = s.jump(keys, n), s.jump(keys, n + 1)
        assert now.tolist() == [plain_jump(int(k), n) for k in keys]
        assert set(grown[grown != now].tolist()) <= {n}
        assert abs((grown != now).mean() - 1 / (n + 1)) < 0.03


def test_every_row_has_a_gapless_slot(spark):
    rows = s.query(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    by_shard = {}
    for r in rows:
        text = docs[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))


def test_nulls_repeated_rows_and_one_hot_key(spark):
    hot = [(7, f"t{k % 2}") for k in range(300)] + [(None, None), (None, ""), (8, "ä")]
    rows = s.assign(spark.createDataFrame(hot, "doc_id long, text string"), 3).collect()
    assert len({r["shard"] for r in rows if r["key"] == 7}) == 1
    assert len({r["shard"] for r in rows if r["key"] is None}) == 1
    assert {(r["size"], r["text_crc32"]) for r in rows if r["key"] is None} == {(1, 0)}
    shards = Counter(r["shard"] for r in rows)
    for shard, n in shards.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert s.assign(documents(spark, []), 3).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = documents(spark, [f"text {k}" for k in range(40)])
    s.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(40))
    assert back.columns == [*docs.columns, "shard"]


def test_the_type_of_the_key_does_not_move_rows(spark):
    from pyspark.sql import functions as F

    ids = spark.range(300).select(F.col("id"), F.col("id").cast("int").alias("small"), F.col("id").cast("string").alias("word"))
    placed = ids.select(*[s.shard_of(F.col(c), 8).alias(c) for c in ids.columns])
    assert placed.where("id <> small or id <> word").count() == 0 and placed.select("id").distinct().count() == 8


def test_clashing_columns_and_a_long_text(spark):
    rows = [(k, "x" * 300_000 if k == 3 else f"t{k}", 7, "old", 1) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, law string, row int")
    got = s.assign(docs, 3).collect()
    assert len(got) == 40 and {r["size"] for r in got if r["key"] == 3} == {300_001}
    for shard in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
