import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import pii, span_tagger
from tests.llm.helpers import SF, documents, prose

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def by_hand(text):
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(PHONE, text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+01259 ()%é\n", max_size=60))
def test_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == by_hand(text)


def test_known_values():
    text = "é a.b@c-d.co.uk, 4532015112830366, 4532-0151-1283-0366, 1.2.3.4, 1.2.3.456, +1 (988) 555-2485, 00255.1.1.1"
    assert pii.base_spans(text) == by_hand(text) and len(pii.base_spans(text)) == 6


def test_long_runs_are_fast_and_right():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "@" * 100_000, "+1" * 100_000, "1 " * 200_000):
        pii.base_spans(text)
        pii.regions_of(text)


def test_query_columns(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = pii.query(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = by_hand(docs[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        every = r["spans"].split(",") if r["spans"] else []
        assert set(text.split(",") if text else []) <= set(every)


def labelled(n):
    texts = []
    for k in range(n):
        texts += [prose(12, k) + f" mail.{k % 9}@box{k % 5}.example.com " + prose(5, k + 1),
                  prose(9, k) + f" +1 ({200 + k % 700}) 555-{1000 + k % 9000} " + prose(9, k + 3),
                  prose(30, k + 7)]
    return texts


def test_tagger_adds_what_patterns_miss_and_leaves_clean_texts(spark):
    model = pii.fit(documents(spark, labelled(60)))
    texts = [prose(9, 1) + " 1 (300) 555-1234 " + prose(8, 2), prose(40, 5), "", "x" * 70_000 + " 1 (300) 555-1234 then",
             "+1 (300) 555-1234 and 12"]
    base = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(texts, base, model)
    assert any(k == "phone" and "300" in texts[0][a:b] for k, a, b in added[0])
    assert added[1] == added[2] == []
    for own, more in zip(base, added):
        assert all(e <= a or b <= s for _, s, e in own for _, a, b in more)


def test_redaction_keeps_rows_and_columns(spark):
    docs = documents(spark, [None, "", "a@b.co and a@b.co", "+1 (300) 555-1234", "none"]).selectExpr("*", "1 as base_spans")
    out = pii.redact(docs, None)
    assert out.columns == docs.columns
    assert [r["text"] for r in out.collect()] == [None, "", "<EMAIL> and <EMAIL>", "<PHONE>", "none"]
    assert pii.find(docs, None).columns == [*docs.columns[:-1], "base_spans", "all_spans"]
    assert pii.fit(docs.where("false")) is None and pii.redact(docs.where("false"), None).count() == 0


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    model = span_tagger.train([("ab 12", [("ip", 3, 5)])] * 4, steps=1, batch=4)
    ids = np.tile(span_tagger.character_ids("mail a@b.co +1 22"), (2, 1))
    tags = np.stack([span_tagger.tags_of(17, [("email", 5, 11)]), span_tagger.tags_of(17, [("phone", 12, 17)])])
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    _, grads = model.slopes(ids, tags)
    for name, weight in model.weights.items():
        at = tuple(rng.integers(0, s) for s in weight.shape)
        if name == "embed":
            at = (span_tagger.DIGIT, 0)
        kept, step = weight[at], 1e-3
        weight[at] = kept + step
        up, _ = model.slopes(ids, tags)
        weight[at] = kept - step
        down, _ = model.slopes(ids, tags)
        weight[at] = kept
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3, name


def test_spans_across_windows_are_joined():
    tags = span_tagger.tags_of(20, [("card", 2, 9), ("ip", 9, 12), ("card", 15, 20)])
    assert span_tagger.spans_of(tags) == [("card", 2, 9), ("ip", 9, 12), ("card", 15, 20)]


def test_regions_reach_the_ends_of_words():
    text = "write to maria.long @ verylongsubdomainname.department.example.com or call"
    assert [text[a:b] for a, b in pii.regions_of(text)] == [text.removesuffix(" or call")]
    long_ = "x" * 500 + "@" + "y" * 500
    whole = "a " * 40 + long_ + " b" * 40
    assert [whole[a:b].strip() for a, b in pii.regions_of(whole)] == [long_]


def test_best_paths_equal_all_paths():
    from itertools import product

    model = span_tagger.train([("a@b.co 12", [("email", 0, 6)])] * 4, steps=3, batch=4)
    ids = np.stack([span_tagger.character_ids(t) for t in ("a@b", "1.2", "+9x")])
    emit, _ = model.emissions(ids)
    w = model.weights
    got = model.best_paths(ids)
    tags = emit.shape[2]
    for k in range(len(ids)):
        score = {p: sum(emit[k, i, p[i]] for i in range(3)) + w["begin"][p[0]] + w["move"][p[0], p[1]] + w["move"][p[1], p[2]]
                 for p in product(range(tags), repeat=3)}
        best = max(score.values())
        assert score[tuple(got[k].tolist())] >= best - 1e-5


def test_a_sample_of_one_repeated_id_stays_bounded(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 20)
    docs = spark.createDataFrame([(None, t) for t in labelled(100)], "doc_id long, text string")
    assert 0 < len(pii.labelled_windows(docs, "text")) <= 40 * 2 * pii.WINDOWS_PER_DOC
