import re

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import quality_rules as q
from tests.compare import difference, duck
from tests.llm.helpers import SF, documents, prose


def by_hand(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit.update(p + k for p in places for k in range(8))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    base = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(hit), base)


TEXTS = [None, "", " \t\n", "one", prose(19, 1), prose(20, 2), prose(200, 3), prose(30, 4) + "\n" + prose(30, 4),
         "a b c d e f g h " * 30, "same line of words\n" * 40, "x| y* z# &&& " * 20, "é ü\u00a0ß " + prose(60, 5),
         "a b c d e f g h i a b c d e f g h", "word " * 20000, "\u2028".join(["thé"] * 50), prose(8, 6)]


def test_base_counts_equal_a_plain_count(spark):
    rows = q.judge(documents(spark, TEXTS)).orderBy("doc_id").collect()
    for text, row in zip(TEXTS, rows, strict=True):
        m = row["quality"]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"],
                row["base_failed"]) == by_hand(text), text and text[:40]
        assert not (row["base_failed"] and row["kept"])


def test_kept_documents_keep_their_columns_and_rows(spark):
    docs = documents(spark, [*TEXTS, prose(300, 9), prose(300, 9)]).selectExpr("*", "1 as quality", "2 as kept")
    kept = q.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {6, 16, 17}
    assert q.kept_documents(docs.where("false")).count() == 0


def test_query_runs_without_python_and_equals_the_sql(spark):
    df = q.query(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
    assert difference(df, duck(SF), q.ORACLE) is None


@pytest.mark.parametrize("measure", [r.measure for r in q.RULES])
def test_rules_name_measures(spark, measure):
    assert measure in q.measures(documents(spark, ["a"])).select("quality.*").columns


LANGUAGES = [
    "Вчера утром мы долго гуляли вдоль реки и говорили о книгах, которые каждый из нас прочитал прошлой зимой, пока за окном шёл тихий снег",
    "Χθες το πρωί περπατήσαμε πολλή ώρα δίπλα στο ποτάμι και μιλήσαμε για βιβλία που είχε διαβάσει ο καθένας μας τον περασμένο χειμώνα στο χωριό",
    "مشينا صباح أمس طويلا على ضفة النهر وتحدثنا عن الكتب التي قرأها كل واحد منا في الشتاء الماضي حين كان الثلج يتساقط بهدوء خلف النافذة",
    "어제 아침 우리는 강가를 오래 걸으며 지난 겨울에 각자 읽은 책 이야기를 나누었고 창밖에는 조용히 눈이 내렸으며 아이들은 마당에서 오랫동안 즐겁게 뛰어 놀고 있었다 그리고 밤이 왔다",
    "Eilen aamulla kävelimme pitkään joen rantaa pitkin ja puhuimme kirjoista joita kukin meistä oli lukenut viime talvena kun lumi satoi hiljaa ikkunan takana ja lapset leikkivät",
    "Wczoraj rano spacerowaliśmy długo wzdłuż rzeki i rozmawialiśmy o książkach, które każdy z nas przeczytał zeszłej zimy, kiedy za oknem padał cichy śnieg",
    "Gisteren liepen wij lang langs de rivier en spraken over boeken die ieder van ons vorige winter had gelezen terwijl het buiten zachtjes sneeuwde",
    "I går morse gick vi länge längs floden och talade om böcker som var och en av oss hade läst förra vintern medan snön föll utanför",
    "Ieri mattina abbiamo camminato a lungo lungo il fiume e parlato dei libri che ciascuno di noi aveva letto l'inverno scorso mentre fuori nevicava",
    "Dün sabah nehir boyunca uzun uzun yürüdük ve geçen kış her birimizin okuduğu kitaplar hakkında konuştuk bir de dışarıda kar yağıyordu çok sessizce",
    "Hôm qua chúng tôi đi dạo rất lâu dọc theo bờ sông và nói về những cuốn sách mà mỗi người đã đọc trong mùa đông năm ngoái khi tuyết rơi",
]


def test_clean_texts_in_other_languages_stay(spark):
    texts = LANGUAGES
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts + ["xq zv " + " ".join(f"brk{k}t" for k in range(40))])], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in q.kept_documents(rows).collect()) == list(range(len(LANGUAGES)))


def test_sql_is_the_same_rule_in_every_language(spark):
    """Whole texts, their halves and mixtures with another script, against the SQL."""
    import duckdb

    texts = LANGUAGES + [a + " " + b for a, b in zip(LANGUAGES, LANGUAGES[1:])] + [t[: len(t) // 2] for t in LANGUAGES]
    texts += [t for t in TEXTS if len(t or "") < 10_000]  # the SQL copies all words for every window
    texts += [t.replace(" ", " zzk ") for t in LANGUAGES] + ["xq zv " + " ".join(f"brk{k}t" for k in range(40))]
    docs = documents(spark, texts)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    m = F.col("quality")
    got = q.judge(docs).select("doc_id", m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words,
                               "base_failed", "kept")
    got = got.toDF("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert difference(got, con, q.ORACLE) is None
    assert 10 < got.where("kept").count() < len(texts) - 10
