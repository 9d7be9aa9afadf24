import numpy as np
import pytest

from cohortlens.operators import elimination as EL
from cohortlens.operators import linear_models as L
from cohortlens.operators.splits import resample_sizes, split
from cohortlens.plans.cross_validation import cross_validate, prepare


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 6))
    y = (x @ np.array([1.5, -1, 0.5, 0, 0, 0]) + rng.normal(0, 0.5, 300) > 0).astype(float)
    return x, y


@pytest.fixture(scope="module")
def points(spark, data):
    x, y = data
    rows = [(i, float(y[i]), [float(v) for v in x[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, "sample_id bigint, label double, features array<double>").repartition(5)


def descend(x, y, spec, mask, iterations, tolerance):
    w = np.zeros(x.shape[1])
    for t in range(1, iterations + 1):
        m = x @ w
        if spec.loss == "squared":
            s = m - y
        elif spec.loss == "logistic":
            s = 1 / (1 + np.exp(-m)) - y
        else:
            side = 2 * y - 1
            s = np.where(side * m < 1, -side, 0)
        g = x.T @ s / len(y) * mask
        step = t ** -0.5
        if spec.penalty == "l2":
            new = w * (1 - step * spec.strength) - step * g
        else:
            new = w - step * g
            if spec.penalty == "l1":
                new = np.sign(new) * np.maximum(abs(new) - step * spec.strength, 0)
        moved = np.linalg.norm(new - w)
        w = new
        if t > 1 and moved < tolerance * max(np.linalg.norm(w), 1):
            break
    return w


def side(spark, points, seed, fraction):
    train, rest = split(points, seed, fraction)
    return sorted(r[0] for r in train.select("sample_id").collect()), \
        sorted(r[0] for r in rest.select("sample_id").collect())


def test_split(spark, points):
    train, rest = side(spark, points, 7, 0.7)
    assert sorted(train + rest) == list(range(300)) and 170 < len(train) < 250
    assert side(spark, points.repartition(64), 7, 0.7) == (train, rest)
    sizes = {r["run"]: r["n_train"] for r in resample_sizes(points, [7, 8], 0.7).collect()}
    assert sizes[0] == len(train) and sizes[1] != 0


@pytest.mark.parametrize("name", ["SVM", "LogisticRegressionWithSGD", "LinearRegressionWithSGD", "LassoWithSGD"])
def test_gradient_models_match_plain_descent(spark, points, data, name):
    x, y = data
    spec = L.algorithm(name)
    masks = np.array([[1] * 6, [1, 1, 0, 1, 0, 1], [1] * 6])
    runs = [0, 0, 1]
    got = L.fit_by_gradient(prepare(points, [5, 6], 0.8), masks, runs, spec, iterations=30)
    for model, run in enumerate(runs):
        rows, _ = side(spark, points, 5 + run, 0.8)
        want = descend(x[rows], y[rows], spec, masks[model], 30, 1e-3)
        np.testing.assert_allclose(got[model], want, atol=1e-10)


def test_validation_errors(spark, points, data):
    x, y = data
    w = np.array([[1.0, -1, 0, 0, 0, 0], [0.1, 0, 0, 0, 0, 0]])
    got = {r["model"]: r for r in L.validation_errors(prepare(points, [5, 6], 0.8), w, [0, 1], 0.0).collect()}
    for model in (0, 1):
        _, rest = side(spark, points, 5 + model, 0.8)
        margin = x[rest] @ w[model]
        wrong = ((margin > 0) != y[rest]).sum()
        assert (got[model]["n"], got[model]["n_wrong"]) == (len(rest), wrong)
        assert got[model]["rmse"] == pytest.approx(np.sqrt(((margin - y[rest]) ** 2).mean()))


@pytest.mark.parametrize("order,name", [("random", "SVM"), ("weights", "LinearRegressionWithSGD")])
def test_cross_validate(points, order, name):
    result = cross_validate(points, list("abcdef"), name, runs=2, seed=4, drop=0.34, floor=2,
                            order=order, iterations=10)
    curve = sorted(result.curve.collect())
    assert [(r["run"], r["step"], r["n_features"]) for r in curve] == [
        (run, step, n) for run in (0, 1) for step, n in enumerate((6, 4, 3, 2))]
    used = result.weights.groupBy("run", "step").count().collect()
    assert {(r["run"], r["step"]): r["count"] for r in used} == {
        (run, step): n for run in (0, 1) for step, n in enumerate((6, 4, 3, 2))}
    best = {r["run"]: r for r in result.best().collect()}
    for run in (0, 1):
        mine = [r for r in curve if r["run"] == run]
        low = min(round(r["error"], 4) for r in mine)
        assert best[run]["n_features"] == min(
            r["n_features"] for r in mine if round(r["error"], 4) == low)
    docs = result.documents().collect()
    assert len(docs) == 2 and all(len(d["PerformanceCurve"]) == 4 for d in docs)
    if order == "weights":
        last = {r["feature"] for r in result.weights.where("step = 3 and run = 0").collect()}
        assert last == {"a", "b"}


def test_estimators(points):
    result = cross_validate(points, list("abcdef"), "LogisticRegressionWithLBFGS", floor=6)
    assert result.curve.first()["error"] < 0.2
    for name in ("SVM", "LassoWithSGD"):
        result = cross_validate(points, list("abcdef"), name, floor=6, engine="estimator")
        assert result.curve.first()["error"] < 0.4


@pytest.mark.parametrize("name", ["LinearRegressionWithSGD", "LassoWithSGD"])
def test_products_give_the_weights_of_all_passes(points, name):
    """One pass for the squared loss, with the weights of a pass per iteration."""
    prepared, masks, spec = prepare(points, [5, 6], 0.8), np.array([[1] * 6, [1, 1, 0, 1, 0, 1], [1] * 6]), L.algorithm(name)
    once = L.fit_by_gradient(prepared, masks, [0, 0, 1], spec)
    every = L.fit_by_gradient(prepared, masks, [0, 0, 1], spec, gram_values=0)
    np.testing.assert_allclose(once, every, atol=1e-9)
    assert np.abs(once).max() > 0.1


def test_gradients_summed_by_tasks_or_by_the_driver_agree(points, monkeypatch):
    prepared, spec = prepare(points, [5, 6], 0.8), L.algorithm("SVM")
    direct = L.fit_by_gradient(prepared, np.ones((2, 6)), [0, 1], spec, iterations=5)
    monkeypatch.setattr(L, "DIRECT_VALUES", 0)
    shuffled = L.fit_by_gradient(prepared, np.ones((2, 6)), [0, 1], spec, iterations=5)
    np.testing.assert_allclose(direct, shuffled, atol=1e-12)


def test_products_make_one_job_sequence(spark, points, monkeypatch):
    calls = []
    monkeypatch.setattr(L, "_mean_gradients", lambda *a: calls.append(a))
    L.fit_by_gradient(prepare(points, [5], 0.8), np.ones((1, 6)), [0], L.algorithm("LinearRegressionWithSGD"))
    assert not calls


def test_lbfgs_reaches_the_minimum_for_all_steps_together(points, data, monkeypatch):
    """All runs and steps share the passes; each gradient falls below 1e-6 of that at zero."""
    x, y = data
    noisy = (np.random.default_rng(8).random(300) < 1 / (1 + np.exp(-x @ np.array([1.0, -1, 0.5, 0, 0, 0])))).astype(float)
    spark = points.sparkSession
    rows = [(i, float(noisy[i]), [float(v) for v in x[i]]) for i in range(300)]
    table = spark.createDataFrame(rows, "sample_id bigint, label double, features array<double>").repartition(3)
    masks = np.array([[1] * 6, [1, 1, 0, 1, 0, 1], [1, 0, 0, 0, 0, 0], [1] * 6])
    runs, passes = [0, 0, 0, 1], []
    inner = L._mean_gradients
    monkeypatch.setattr(L, "_mean_gradients", lambda *a: passes.append(1) or inner(*a))
    got = L.fit_by_lbfgs(prepare(table, [5, 6], 0.8), masks, runs, L.algorithm("LogisticRegressionWithLBFGS"))
    for model, run in enumerate(runs):
        train, _ = side(spark, table, 5 + run, 0.8)
        at_fit = x[train].T @ (1 / (1 + np.exp(-x[train] @ got[model])) - noisy[train]) * masks[model]
        at_zero = x[train].T @ (0.5 - noisy[train]) * masks[model]
        assert np.abs(at_fit).max() < 1e-6 * np.abs(at_zero).max()
        assert not got[model][masks[model] == 0].any()
    assert len(passes) < 40  # of all models together
    with pytest.raises(ValueError):
        L.fit_by_lbfgs(table, masks, runs, L.algorithm("SVM"))


def test_lbfgs_ends_where_classes_can_be_separated(spark):
    rows = [(i, float(i >= 5), [float(i) - 4.5]) for i in range(10)]
    table = spark.createDataFrame(rows, "sample_id bigint, label double, features array<double>")
    flags = table.selectExpr("label", "features", "array(true) AS in_train")
    got = L.fit_by_lbfgs(flags, np.ones((1, 1)), [0], L.algorithm("LogisticRegressionWithLBFGS"), passes=30)
    assert np.isfinite(got).all() and got[0, 0] > 1


def test_auc_counts_pairs_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 2)).round(1)
    y = (x[:, 0] + rng.normal(0, 1, 400) > 0.3).astype(float)
    rows = [(float(y[i]), [float(v) for v in x[i]], [bool(i % 4), bool(i % 3)]) for i in range(400)]
    table = spark.createDataFrame(rows, "label double, features array<double>, in_train array<boolean>").repartition(7)
    weights, runs = np.array([[1.0, 0.0], [0.5, 0.5], [-1.0, 0.0], [0.0, 0.0]]), [0, 1, 0, 1]
    for task_rows in (L.TASK_ROWS, 9):
        got = {r["model"]: r for r in L.model_auc(table, weights, runs, task_rows=task_rows).collect()}
        for model, run in enumerate(runs):
            rest = np.array([i for i in range(400) if not rows[i][2][run]])
            score = x[rest] @ weights[model]
            up, down = score[y[rest] == 1], score[y[rest] == 0]
            want = ((up[:, None] > down) + (up[:, None] == down) / 2).mean()
            assert got[model]["auc"] == pytest.approx(want, abs=1e-12)
            assert (got[model]["n_positive"], got[model]["n_negative"]) == (len(up), len(down))
        assert got[3]["auc"] == 0.5
    one_class = table.where("label = 1")
    assert L.model_auc(one_class, weights, runs).where("auc IS NOT NULL").count() == 0


def test_curve_of_many_features_stays_in_tables(spark, monkeypatch):
    """20,000 features x 60 steps: weights become rows in tasks, not on the driver."""
    import tracemalloc

    rng = np.random.default_rng(1)
    names = [f"gene{i:05d}" for i in range(20_000)]
    rows = [(i, float(i % 2), rng.normal(0, 1, 20_000).tolist()) for i in range(12)]
    table = spark.createDataFrame(rows, "sample_id bigint, label double, features array<double>").repartition(2).cache()
    table.count()
    del rows
    tracemalloc.start()
    result = cross_validate(table, names, "SVM", drop=0.06, floor=530, iterations=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    curve = result.curve.orderBy("step").collect()
    assert len(curve) >= 60 and curve[0]["n_features"] == 20_000
    sizes = {r["step"]: r["count"] for r in result.weights.groupBy("step").count().collect()}
    assert sizes == {r["step"]: r["n_features"] for r in curve}
    assert peak < 400_000_000
    table.unpersist()


def test_cross_validate_gives_auc_on_request(points):
    plain = cross_validate(points, list("abcdef"), "LinearRegressionWithSGD", floor=6)
    with_auc = cross_validate(points, list("abcdef"), "LinearRegressionWithSGD", floor=6, auc=True)
    assert "auc" not in plain.curve.columns and with_auc.curve.first()["auc"] > 0.9


def test_arguments(points):
    for bad in (dict(name="SGD"), dict(name="SVM", order="rfe"), dict(name="SVM", engine="x"),
                dict(name="SVM", train_fraction=1.0), dict(name="SVM", drop=0)):
        with pytest.raises(ValueError):
            cross_validate(points, list("abcdef"), **bad)


def test_elimination(spark):
    assert [EL.drop_count(n, 0.1) for n in (4, 25, 100)] == [1, 3, 10]
    assert EL.drop_count(50, 7) == 7
    names = [f"f{i}" for i in range(10)]
    schedule = EL.random_schedule(names, 3, 0.3, 4)
    assert [len(s) for s in schedule] == [10, 7, 5, 3]
    table = spark.createDataFrame(list(enumerate(names)), "pos int, feature string")
    left = {r["feature"] for r in EL.eliminate_step(table, 3, 1, 0.3).collect()}
    assert left == set(schedule[1])
    assert EL.next_features(["a"], 5, {"a": 1}) == ["a"]
    masks = EL.random_masks(names, 3, 0.3, 4)
    assert [[n for n, kept in zip(names, m) if kept] for m in masks] == schedule
    left = EL.smallest_dropped(np.array([1, 1, 0, 1], bool), np.array([2.0, 1, 0, 1]), list("abcd"), 1)
    assert left.tolist() == [True, False, False, True]
    assert EL.smallest_dropped(np.array([1, 0], bool), np.zeros(2), list("ab"), 5).tolist() == [True, False]
