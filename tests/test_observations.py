import re

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import anova as A
from cohortlens.operators import categorical as K
from cohortlens.operators import observations as O
from cohortlens.sources import readers, results

NA = {"", "N", "A", "NA", None}
NUMBER = re.compile(r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|nan|inf(inity)?)\s*$", re.I)
UNKNOWN = {"unknown", "uncertain"}
TOKENS = {"yes", "no", "1", "0", "1.0", "0.0", "present", "absent", "male", "female", "true", "t",
          "false", "f"}


def family(raws):
    """The inference rule, value by value."""
    v = [r for r in raws if r not in NA]
    if len(v) < 4 or len({x.lower() for x in v}) < 2:
        return "Other"
    known = [x for x in v if x.lower() not in UNKNOWN]
    if not known:
        return "Other"
    by_token = "Binary" if known[0].lower() in TOKENS else "Categorical"
    decider = v[1] if v[0].lower() in UNKNOWN else v[0]
    if not NUMBER.match(decider):
        return by_token
    if float(decider) not in (0, 1):
        return "Numerical"
    for x in v:
        if not NUMBER.match(x):
            return by_token
        if float(x) not in (0, 1):
            return "Numerical"
    return "Binary"


STUDY = {
    "num": ["1.5", "2", "NA", "3e2", "-4"], "num01": ["1", "0", "1", "2.5", "0"],
    "bin01": ["1", "0", "1.0", "0", "NA"], "yesno": ["Yes", "no", "NO", "yes"],
    "cat": ["red", "blue", "red", "green"], "maybe": ["yes", "maybe", "no", "x"],
    "few": ["1", "2", "3", "NA"], "constant": ["Same", "same", "SAME", "same"],
    "allna": ["NA", "", "N", "A", None], "unknown1": ["unknown", "1.5", "2.5", "3.5"],
    "unknown2": ["unknown", "Uncertain", "1.5", "2.5", "3.5"],
    "unknown01": ["unknown", "1", "0", "1", "0"], "onlyunknown": ["unknown", "uncertain"] * 3,
    "late": ["1", "0", "x", "5", "1"], "suffix": ["1d", "2d", "3d", "4d"],
    "under": ["1_0", "2", "3", "4"], "nan": ["nan", "1", "2", "inf"], "space": [" 7", "8 ", "9", "1"],
    "mid": ["5", "unknown", "unknown", "7", "9"], "zero": ["0.00", "0", "1", "1"],
    "unk0.00": ["Unknown", "0.00", "1", "0", "1"], "one": ["1"],
}


@pytest.fixture(scope="module")
def obs(spark):
    rows = [(f, i, r) for f, raws in STUDY.items() for i, r in enumerate(raws)]
    return spark.createDataFrame(rows, "feature string, sample_id bigint, raw string")


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_families(obs, parts):
    got = {r["feature"]: r for r in O.feature_families(obs.repartition(parts)).collect()}
    assert {f: got[f]["family"] for f in STUDY} == {f: family(raws) for f, raws in STUDY.items()}
    for f, raws in STUDY.items():
        assert got[f]["n_na"] == sum(r in NA for r in raws)


def test_large_positions(spark, obs):
    # positions beyond 2^53 keep their order
    shifted = obs.withColumn("sample_id", F.col("sample_id") + (1 << 57))
    got = {r["feature"]: r["family"] for r in O.feature_families(shifted).collect()}
    assert got == {f: family(raws) for f, raws in STUDY.items()}


def test_typed_values(obs):
    typed = O.typed_values(obs, O.feature_families(obs))
    late = [(r["raw"], r["value"], r["unparsed"]) for r in
            typed.where("feature = 'unknown1'").orderBy("sample_id").collect()]
    assert late == [("unknown", None, True), ("1.5", 1.5, False), ("2.5", 2.5, False), ("3.5", 3.5, False)]
    assert typed.where("feature = 'cat' and value is not null").count() == 0
    assert typed.where("raw in ('NA', '')").count() == 0


def test_empty(spark, obs):
    none = obs.where("sample_id < 0")
    families = O.feature_families(none)
    assert families.count() == 0 and O.typed_values(none, families).count() == 0
    assert K.chi_square_equal(K.class_counts(none)).count() == 0
    assert K.binomial_test(K.class_counts(none)).count() == 0


def test_vectors_and_maps(spark):
    values = spark.createDataFrame([(f, i, i * 1.0) for f in "ab" for i in range(10)],
                                   "feature string, sample_id bigint, value double").repartition(4)
    got = {(r["feature"], r["piece"]): r["vector"] for r in O.feature_vectors(values, 4).collect()}
    assert got["a", 0] == [0, 1, 2, 3] and got["b", 2] == [8, 9] and len(got) == 6
    maps = {r["sample_id"]: r["values"] for r in O.patient_maps(values).collect()}
    assert maps[3] == {"a": 3.0, "b": 3.0}
    points = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "sample_id bigint, features array<double>")
    assert O.drop_positions(points, [0, 2]).first()["features"] == [2.0, 4.0]


def test_categorical(spark):
    rows = [("a", "x")] * 6 + [("a", "y")] * 2 + [("a", "X")] * 4 + [("b", "x")] * 3
    obs = spark.createDataFrame([(f, i, r) for i, (f, r) in enumerate(rows)],
                                "feature string, sample_id bigint, raw string")
    counts = K.class_counts(obs)
    chi = {r["feature"]: r for r in K.chi_square_equal(counts).collect()}
    assert chi["a"]["chi2"] == pytest.approx(2.0) and chi["a"]["p"] == pytest.approx(0.36787944117)
    assert (chi["b"]["chi2"], chi["b"]["p"]) == (0.0, 0.0)
    binomial = {r["feature"]: r for r in K.binomial_test(counts).collect()}
    assert (binomial["a"]["low"], binomial["a"]["high"]) == (2, 4) and "b" not in binomial
    assert binomial["a"]["p"] == pytest.approx(0.6875)


def test_anova(spark):
    groups = {"a": [1.0, 2, 3], "b": [2.0, 3, 4], "c": [5.0, 6, 7], "lone": [0.0, 10, 20],
              "big1": [1e9 + 1, 1e9 + 11], "big2": [1e9 + 2, 1e9 + 12]}
    rows = [(f, float(x)) for f, xs in groups.items() for x in xs]
    values = spark.createDataFrame(rows, "feature string, value double")
    got = {r["std_bucket"]: r for r in A.anova_by_deviation(O.value_summary(values)).collect()}
    assert got[0.82]["n_features"] == 3 and got[0.82]["f"] == pytest.approx(13.0)
    # F(2, 6): p = (1 + 2F/6)^-3
    assert got[0.82]["p"] == pytest.approx((1 + 2 * 13 / 6) ** -3)
    assert got[8.16]["f"] is None and got[8.16]["p"] is None
    assert got[5.0]["f"] == pytest.approx(0.02)


def test_round_half_even(spark):
    got = spark.range(1).select(*[O.round_half_even(F.lit(x)).alias(str(i)) for i, x in
                                  enumerate((0.125, 0.375, 0.1349, 2.5))]).first()
    assert list(got) == [0.12, 0.38, 0.13, 2.5]


def test_readers(spark, tmp_path):
    path = tmp_path / "points.txt"
    path.write_text("1 0.5 2\n0 x 3\n1 4 5e1\n")
    got = readers.labeled_points(readers.read_lines(spark, str(path))).orderBy("sample_id").collect()
    assert [(r["label"], r["features"]) for r in got] == [(1, [0.5, 2]), (0, [None, 3]), (1, [4, 50])]
    lines = spark.createDataFrame([("f1 f2 f3",)], "line string")
    assert [tuple(r) for r in readers.feature_names(lines).collect()] == [(0, "f1"), (1, "f2"), (2, "f3")]
    lines = spark.createDataFrame([("NA\t1\tNA\t3",)], "line string")
    assert [tuple(r) for r in readers.feature_lines(lines).collect()] == [
        ("NA", 0, "1"), ("NA", 1, "NA"), ("NA", 2, "3")]
    lines = spark.createDataFrame([(0, "A\t1"), (1, "B\t"), (2, "A\t7")], "sample_id bigint, line string")
    assert [tuple(r) for r in readers.symbol_map(lines).collect()] == [("A", 7)]
    lines = spark.createDataFrame([("path:hsa00010\thsa:10327",)], "line string")
    assert tuple(readers.pathway_links(lines).first()) == ("hsa00010", 10327)
    lines = spark.createDataFrame([("path:hsa1\tGlycolysis - Homo sapiens (human)",)], "line string")
    assert tuple(readers.pathway_names(lines).first()) == ("hsa1", "Glycolysis")
    fields = spark.createDataFrame([("A1 B2\tC3  D4",)], "field string")
    assert [r["symbol"] for r in readers.gene_list(fields).collect()] == ["A1", "B2", "C3", "D4"]


def test_result_update(spark, tmp_path):
    target = spark.createDataFrame([(1, "old", 1.0), (2, "old", 2.0)], "id int, status string, perf double")
    updates = spark.createDataFrame([(2, "new", None, 5), (3, "new", 9.0, 6)],
                                    "id int, status string, perf double, extra int")
    got = [tuple(r) for r in results.update_existing(target, updates, "id").orderBy("id").collect()]
    assert got == [(1, "old", 1.0, None), (2, "new", None, 5)]
    out = str(tmp_path / "results")
    results.write_results(target, out)
    with pytest.raises(Exception):
        results.write_results(target, out)
