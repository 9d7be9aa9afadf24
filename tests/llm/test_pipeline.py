import corpus_pipeline as c
from cohortlens.llm import packing, pii
from cohortlens.llm.common import stored
from tests.llm.helpers import SF, changed, documents, prose
from tests.llm.test_minhash_dedup import by_hand as groups_by_hand
from tests.llm.test_quality_rules import by_hand as quality_by_hand


def stages(spark, docs):
    out = [docs]
    for _, stage in c.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return out


def test_each_stage_does_its_work_on_what_came_in(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, good, known, unique, hidden, packed = stages(spark, docs)
    for table in (good, known, unique, hidden):
        assert table.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in start.collect()}
    failed = {k for k, t in texts.items() if quality_by_hand(t)[-1]}
    left = {r["doc_id"] for r in good.collect()}
    assert failed and not failed & left
    rows = {r["doc_id"]: r for r in known.orderBy("doc_id").collect()}
    assert len(rows) >= 0.97 * len(left)
    ids = sorted(rows)
    parts = groups_by_hand([rows[k]["text"] for k in ids], c.minhash_dedup.Likeness())
    assert {r["doc_id"] for r in unique.collect()} == {ids[k] for k in {p[1] for p in parts}}
    for r in hidden.collect():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    whole = {}
    for r in packed.collect():
        whole.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    clear = {r["doc_id"]: r["text"] for r in hidden.collect()}
    assert set(whole) == set(clear)
    encoder = packing.memory(packing.VOCABULARY)
    for doc, pieces in whole.items():
        ids = [i for _, own in sorted(pieces) for i in own]
        assert ids == [*encoder.encode([clear[doc]])[0].tolist(), 0]


def test_clean_documents_stay_and_planted_ones_go(spark):
    base = prose(200, 1)
    texts = [prose(120, k) for k in range(10, 40)] + [base, changed(base, 3, 5), base, None, "", "word " * 300, "12 34 " * 60]
    *_, hidden, packed = stages(spark, documents(spark, texts))
    assert sorted(r["doc_id"] for r in hidden.collect()) == list(range(31))
    assert {r["doc_id"] for r in packed.collect()} == set(range(31))


def test_empty_table(spark):
    assert [t.count() for t in stages(spark, documents(spark, []))] == [0] * 6


def test_repeated_rows_and_copies_without_id_leave_one(spark):
    one, other, third = prose(120, 1), prose(120, 2), prose(120, 3)
    docs = spark.createDataFrame(
        [(5, one)] * 4 + [(None, other)] * 5 + [(None, third), (None, None), (None, None), (8, third), (9, third), (5, prose(90, 4))],
        "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    left = sorted((str(r["doc_id"]), str(r["text"])) for r in c.near_dedup(spark, docs, SF).collect())
    assert left == sorted([("5", one), ("None", other), ("None", third), ("None", "None"), ("8", third), ("5", prose(90, 4))])
