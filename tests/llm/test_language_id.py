import numpy as np

from pyspark.sql import functions as F

from cohortlens.llm import language_id as g
from tests.llm.helpers import DOCS, documents, prose


def test_held_out_accuracy_and_score(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in g.query(spark, sf).collect() if r["held_out"]]
    assert len(rows) > 150
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_learns_from_its_part_only(spark):
    docs = documents(spark, ["eins zwei"] * 40).selectExpr(
        "doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'xx', 'de') as lang")
    net = g.fit(docs)
    assert net.languages == ["de"]
    held = g.identify(docs, net).where(g.in_held_out(F.col("doc_id"))).collect()
    assert held and {(r["lang_pred"], r["score"]) for r in held} == {("de", 1.0)}


def test_nulls_letters_long_texts_and_clashing_columns(spark):
    rows = [(k, "the stone and the river " * 9, "en") for k in range(30)]
    rows += [(k, "le pierre et la rivière " * 9, "fr") for k in range(30, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = g.fit(docs)
    odd = spark.createDataFrame(
        [(1, None, None, 1), (2, "", "en", 1), (3, "123 !? ٣", None, 1), (None, "the stone and", None, 1),
         (5, "12 " * 100_000 + " la rivière et le", None, 1), (6, "the stone", None, 1), (6, "the stone", None, 1)],
        "doc_id long, text string, lang string, score int")
    got = g.identify(odd, net)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    by = got.collect()
    assert [r["lang_pred"] for r in by[:3]] == ["und"] * 3 and [r["score"] for r in by[:3]] == [0.0] * 3
    assert by[3]["lang_pred"] == "en" and by[4]["lang_pred"] in ("en", "fr")
    assert by[5]["lang_pred"] == by[6]["lang_pred"] == "en" and by[5]["score"] == by[6]["score"]
    assert g.fit(docs.where("false")) is None
    assert {r["lang_pred"] for r in g.identify(odd, None).collect()} == {"und"}


def test_whole_texts_are_read():
    net = g.train([b"aaaa" * 20, b"zzzz" * 20] * 40, ["a", "z"] * 40, epochs=10)
    langs, _ = g.scores_of(["a" * 300 + "z" * 60_000, "z" * 300 + "a" * 60_000], net)
    assert langs == ["z", "a"]


def test_slopes_reduce_the_loss():
    rng = np.random.default_rng(0)
    windows = [bytes(rng.integers(97, 110, 60).astype(np.uint8)) for _ in range(60)]
    windows += [bytes(rng.integers(105, 122, 60).astype(np.uint8)) for _ in range(60)]
    net = g.train(windows, ["x"] * 60 + ["y"] * 60)
    langs, _ = g.scores_of([w.decode() for w in windows], net)
    assert sum(a == b for a, b in zip(langs, ["x"] * 60 + ["y"] * 60)) > 110


def by_hand(text, net):
    """Language and probability by plain loops: every window alone, every filter at every byte."""
    if not text or not any(c.isalpha() for c in text):
        return g.UNKNOWN, 0.0
    data, total, size = text.encode(), np.zeros(len(net.languages)), 0
    for start in range(0, len(data), g.WINDOW):
        part = data[start:start + g.WINDOW]
        ids = list(part) + [g.PAD] * (g.WINDOW - len(part) + max(g.WIDTHS) - 1)
        top = np.full(len(net.bias), -np.inf)
        for at in range(g.WINDOW):
            seen = np.concatenate([net.embed[i] for i in ids[at:at + max(g.WIDTHS)]])
            top = np.maximum(top, seen @ net.filters)
        raw = np.maximum(top + net.bias, 0) @ net.out + net.out_bias
        total += (raw - raw.max() - np.log(np.exp(raw - raw.max()).sum())) * len(part)
        size += len(part)
    mean = total / size
    mean = mean - np.log(np.exp(mean - mean.max()).sum()) - mean.max()
    return net.languages[int(mean.argmax())], float(np.exp(mean.max()))


def test_batched_windows_equal_plain_loops(spark, monkeypatch):
    net = g.train([prose(40, k).encode()[:256] for k in range(8)] + [("ñandú él la " * 30).encode()[:256]] * 8,
                  ["en"] * 8 + ["es"] * 8, epochs=2)
    texts = [prose(90, 1), "él la ñandú " * 70, "x", "", None, "12 -- 34", "é" * 127 + "a" * 300, prose(700, 2), "Привет мир"]
    want = [by_hand(t, net) for t in texts]
    for chunk in (g.CHUNK, 2):
        monkeypatch.setattr(g, "CHUNK", chunk)
        langs, scores = g.scores_of(texts, net)
        assert langs == [w[0] for w in want]
        np.testing.assert_allclose(scores, [w[1] for w in want], atol=2e-5)
