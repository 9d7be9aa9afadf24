"""Linear models: descent for many models at once, and `pyspark.ml` fits.

Repeated splits and elimination steps give many models over the same points. They are trained
together: a pass over the points serves every model, each task multiplies its rows with the weight
matrix, and one summed gradient per model and task is shuffled. The squared loss needs one pass in
all, for the products of features that its gradients consist of; the logistic loss without penalty
is fitted by L-BFGS, whose line searches share the passes. Weights (models x features) and, for the
squared loss, the products (runs x features x features, up to `GRAM_VALUES`) visit the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.ranking import TASK_ROWS, with_pieces
from cohortlens.session import cut

# Tasks whose gradients of one model are summed first, so that no reducer meets all tasks.
GRADIENT_SHARES = 32
# Up to so many values of all tasks' gradients together the driver adds them up, without a shuffle.
DIRECT_VALUES = 4_000_000
# Largest number of products of two features, over all runs, that is brought together.
GRAM_VALUES = 16_000_000
# Steps of L-BFGS remembered, passes at most, and the share of the first gradient that ends a fit.
MEMORY, PASSES, FLATNESS = 10, 400, 1e-7


@dataclass(frozen=True)
class Algorithm:
    loss: str  # hinge, logistic or squared
    penalty: str  # none, l1 or l2
    strength: float
    cut_off: float  # a score above it predicts label 1

    @property
    def by_gradient(self) -> bool:
        return self.loss != "logistic" or self.penalty != "none"


# Names, penalties and strengths of the available algorithms.
ALGORITHMS = {
    "SVM": Algorithm("hinge", "l2", 0.01, 0.0),
    "LogisticRegressionWithLBFGS": Algorithm("logistic", "none", 0.0, 0.0),
    "LogisticRegressionWithSGD": Algorithm("logistic", "l2", 0.01, 0.0),
    "LinearRegressionWithSGD": Algorithm("squared", "none", 0.0, 0.5),
    "LassoWithSGD": Algorithm("squared", "l1", 0.01, 0.5),
}


def algorithm(name: str) -> Algorithm:
    if name not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {list(ALGORITHMS)}")
    return ALGORITHMS[name]


def score(weights: Sequence[float], intercept: float = 0.0) -> Column:
    """Linear score of the `features` array, as a native expression."""
    # one literal for all weights: an expression each would outgrow generated code
    w = F.split(F.lit(",".join(repr(float(v)) for v in weights)), ",").cast("array<double>")
    products = F.zip_with("features", w, lambda x, v: x * v)
    return F.aggregate(products, F.lit(float(intercept)), lambda total, x: total + x)


def error_rate(scored: DataFrame, label: str = "label", prediction: str = "prediction"
               ) -> DataFrame:
    """(n, n_wrong, error): share of rows whose prediction is not the label."""
    wrong = F.count_if(F.col(label) != F.col(prediction))
    n = F.count(F.lit(1))
    return scored.agg(n.alias("n"), wrong.alias("n_wrong"),
                      F.try_divide(wrong.cast("double"), n).alias("error"))


def _arrays(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label column, feature matrix and training flags of a batch of points."""
    rows = batch.num_rows
    y = batch.column(0).to_numpy(zero_copy_only=False)[:, None]
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
    used = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
    return y, x, used


def _summed(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Sum `n` and the vector `total` of every key, in two steps, as one key's rows come from every
    task."""
    share = F.pmod(F.spark_partition_id(), F.lit(GRADIENT_SHARES))
    summed = partial.withColumn("share", share)
    for by in ([*keys, "share"], keys):
        summed = summed.groupBy(*by).agg(
            F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total")).alias("total")
        ).withColumn("total", vector_to_array("total"))
    return summed


def _gradient_task(weights: np.ndarray, run_of_model: list[int], loss: str):
    """Task: sums over its training rows, for every model the gradient and behind it the loss."""

    def gradients(batches):
        import numpy as np
        import pyarrow as pa

        features, models = weights.shape
        total = np.zeros((features + 1, models))
        count = np.zeros(models, dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y, x, used = _arrays(batch)
            used = used[:, run_of_model]
            margin = x @ weights
            if loss == "squared":
                slope, cost = margin - y, (margin - y) ** 2 / 2
            elif loss == "logistic":
                slope = 1.0 / (1.0 + np.exp(-margin)) - y
                cost = np.logaddexp(0.0, margin) - y * margin
            else:
                side = 2.0 * y - 1.0
                slope = np.where(side * margin < 1.0, -side, 0.0)
                cost = np.maximum(0.0, 1.0 - side * margin)
            total[:-1] += x.T @ (slope * used)
            total[-1] += (cost * used).sum(axis=0)
            count += used.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(models)), pa.array(count),
             pa.array(list(total.T), type=pa.list_(pa.float64()))],
            names=["model", "n", "total"])

    return gradients


def _tasks(points: DataFrame) -> int:
    numbered = points.select(F.spark_partition_id().alias("task"))
    return (numbered.agg(F.max("task")).first()[0] or 0) + 1


def _mean_gradients(points: DataFrame, weights: np.ndarray, run_of_model: list[int], loss: str,
                    tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """(gradients (features x models), losses), means over the training rows of each model."""
    partial = points.select("label", "features", "in_train").mapInArrow(
        _gradient_task(weights, run_of_model, loss), "model long, n long, total array<double>")
    features, models = weights.shape
    if tasks * models * (features + 1) > DIRECT_VALUES:
        partial = _summed(partial, ["model"])
    table = partial.toArrow()  # a row per model, or per model and task where these are few
    total, count = np.zeros((models, features + 1)), np.zeros(models)
    if table.num_rows:
        model = table.column("model").to_numpy()
        vectors = table.column("total").combine_chunks().flatten().to_numpy().reshape(len(model), -1)
        np.add.at(total, model, vectors)
        np.add.at(count, model, table.column("n").to_numpy())
    total = (total / np.maximum(count, 1.0)[:, None]).T
    return total[:-1], total[-1]


def products(points: DataFrame, features: int, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """(X'X, X'y) over the training rows of every run, divided by their number: all that gradients
    of the squared loss need, in one pass."""

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((runs, features, features + 1))
        count = np.zeros(runs, dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y, x, used = _arrays(batch)
            both = np.concatenate([x, y], axis=1)
            for run in range(runs):
                total[run] += x[used[:, run]].T @ both[used[:, run]]
            count += used.sum(axis=0)
        for run in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(features, run)), pa.array(np.arange(features)), pa.array(np.full(features, count[run])),
                 pa.array(list(total[run]), type=pa.list_(pa.float64()))],
                names=["run", "position", "n", "total"])

    partial = points.select("label", "features", "in_train").mapInArrow(
        multiply, "run long, position long, n long, total array<double>")
    both = np.zeros((runs, features, features + 1))
    table = _summed(partial, ["run", "position"]).toArrow()  # one row per run and feature
    rows = table.column("total").combine_chunks().flatten().to_numpy().reshape(-1, features + 1)
    both[table.column("run").to_numpy(), table.column("position").to_numpy()] = (
        rows / table.column("n").to_numpy()[:, None])
    return both[:, :, :-1], both[:, :, -1]


def check_points(points: DataFrame, width: int) -> None:
    """Raise where a vector is null, of another width than the names, or holds a null or non-finite
    cell, or where a label is missing; one pass, the message gives the counts."""
    cells = F.coalesce("features", F.array().cast("array<double>"))
    bad = {
        "null vectors": F.col("features").isNull(),
        f"vectors of another width than {width}": F.col("features").isNotNull() & (
            F.size(cells) != width),
        "vectors with a null or non-finite cell": F.exists(
            cells, lambda x: F.coalesce(~(F.abs(x) < float("inf")), F.lit(True))),
        "missing or non-finite labels": F.coalesce(~(F.abs("label") < float("inf")), F.lit(True)),
    }
    counts = points.agg(*[F.count_if(test).alias(what) for what, test in bad.items()]).first()
    found = [f"{counts[what]} {what}" for what in bad if counts[what]]
    if found:
        raise ValueError("points cannot be used: " + ", ".join(found))


def fit_by_gradient(points: DataFrame, masks: np.ndarray, run_of_model: Sequence[int],
                    spec: Algorithm, iterations: int = 100, tolerance: float = 1e-3,
                    gram_values: int = GRAM_VALUES) -> np.ndarray:
    """Weights (models x features) after full-batch gradient descent with step 1/sqrt(t).

    `points` has (label, features, in_train), `in_train` one flag per run; `masks` (models x
    features) says which features a model uses. A model stops once its weights move by less than
    `tolerance` of their length. The squared loss is descended on the products of features, after
    one pass over the points; beyond `gram_values` products it takes a pass per iteration like the
    others, with the same weights.
    """
    runs = np.asarray(run_of_model)
    allowed = np.asarray(masks, dtype=float).T
    features, models = allowed.shape
    by_products = spec.loss == "squared" and (runs.max() + 1) * features ** 2 <= gram_values
    if by_products:
        square, cross = products(points, features, int(runs.max()) + 1)
    else:
        tasks = _tasks(points)
    weights = np.zeros_like(allowed)
    active = np.ones(models, dtype=bool)
    for t in range(1, iterations + 1):
        open_models = np.flatnonzero(active)
        current = weights[:, open_models]
        if by_products:
            gradient = np.empty_like(current)
            for run in np.unique(runs[open_models]):
                own = runs[open_models] == run
                gradient[:, own] = square[run] @ current[:, own] - cross[run][:, None]
        else:
            gradient, _ = _mean_gradients(points, current, runs[open_models].tolist(), spec.loss, tasks)
        gradient = gradient * allowed[:, open_models]
        step = 1.0 / np.sqrt(t)
        if spec.penalty == "l2":
            moved = current * (1.0 - step * spec.strength) - step * gradient
        else:
            moved = current - step * gradient
            if spec.penalty == "l1":
                moved = np.sign(moved) * np.maximum(np.abs(moved) - step * spec.strength, 0.0)
        weights[:, open_models] = moved
        if t > 1:
            shift = np.linalg.norm(moved - current, axis=0)
            settled = shift < tolerance * np.maximum(np.linalg.norm(moved, axis=0), 1.0)
            active[open_models[settled]] = False
        if not active.any():
            break
    return weights.T


def _direction(gradient: np.ndarray, moves: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray:
    """L-BFGS directions of all models (features x models) by the two-loop recursion. A model whose
    curvature along a remembered step is not positive skips that step."""
    q = gradient.copy()
    found = []
    for s, y in zip(reversed(moves), reversed(turns)):
        curve = (s * y).sum(axis=0)
        usable = curve > 1e-10 * (y * y).sum(axis=0)
        alpha = np.where(usable, (s * q).sum(axis=0) / np.where(usable, curve, 1.0), 0.0)
        q -= alpha * y
        found.append((alpha, curve, usable))
    scale = np.ones(q.shape[1])
    for s, y in zip(moves, turns):  # the last step that a model made gives its scale
        curve, length = (s * y).sum(axis=0), (y * y).sum(axis=0)
        usable = curve > 1e-10 * length
        scale = np.where(usable, curve / np.where(usable, length, 1.0), scale)
    q *= scale
    for (s, y), (alpha, curve, usable) in zip(zip(moves, turns), reversed(found)):
        beta = np.where(usable, (y * q).sum(axis=0) / np.where(usable, curve, 1.0), 0.0)
        q += (alpha - beta) * s
    return -q


def fit_by_lbfgs(points: DataFrame, masks: np.ndarray, run_of_model: Sequence[int], spec: Algorithm,
                 passes: int = PASSES, flatness: float = FLATNESS) -> np.ndarray:
    """Weights (models x features) at the minimum of a smooth loss without penalty.

    All models, of all runs and elimination steps, share each pass over the points: it evaluates
    loss and gradient of every open model at its own trial point. A model that finds enough descent
    there moves on, another one halves its step and waits for the next pass. A model ends when the
    largest part of its gradient is below `flatness` of that at zero, when its step cannot be made
    shorter, or after `passes`; classes that can be separated have no minimum and end that way.
    """
    if spec.loss != "logistic" or spec.penalty != "none":
        raise ValueError("L-BFGS fits the logistic loss without penalty")
    runs = np.asarray(run_of_model)
    allowed = np.asarray(masks, dtype=float).T
    models, tasks = allowed.shape[1], _tasks(points)

    def evaluate(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gradient, loss = _mean_gradients(points, at, runs[which].tolist(), spec.loss, tasks)
        return gradient * allowed[:, which], loss

    weights = np.zeros_like(allowed)
    gradient, loss = evaluate(weights, np.arange(models))
    first = np.abs(gradient).max(axis=0)
    # remembered steps of a model are columns of these; zeros stand for steps that it did not make
    moves: list[np.ndarray] = []
    turns: list[np.ndarray] = []
    direction = _direction(gradient, [], [])
    step = 1.0 / np.maximum(np.linalg.norm(gradient, axis=0), 1.0)
    active = first > 0
    for _ in range(passes):
        which = np.flatnonzero(active)
        if not len(which):
            break
        trial = weights[:, which] + step[which] * direction[:, which]
        new_gradient, new_loss = evaluate(trial, which)
        slope = (gradient[:, which] * direction[:, which]).sum(axis=0)
        good = new_loss <= loss[which] + 1e-4 * step[which] * slope
        # at the limit of the loss's digits the gradient decides
        good |= (np.abs(new_loss - loss[which]) <= 1e-14 * np.abs(loss[which])) & (
            np.abs(new_gradient).max(axis=0) < np.abs(gradient[:, which]).max(axis=0))
        short = which[~good]
        step[short] /= 2
        active[short[step[short] < 1e-12]] = False
        done = which[good]
        if not len(done):
            continue
        move, turn = np.zeros_like(weights), np.zeros_like(weights)
        move[:, done] = trial[:, good] - weights[:, done]
        turn[:, done] = new_gradient[:, good] - gradient[:, done]
        weights[:, done], gradient[:, done], loss[done] = trial[:, good], new_gradient[:, good], new_loss[good]
        moves, turns = [*moves, move][-MEMORY:], [*turns, turn][-MEMORY:]
        found = _direction(gradient[:, done], [m[:, done] for m in moves], [t[:, done] for t in turns])
        uphill = (found * gradient[:, done]).sum(axis=0) >= 0
        direction[:, done] = np.where(uphill, -gradient[:, done], found)
        step[done] = 1.0
        active[done[np.abs(gradient[:, done]).max(axis=0) <= flatness * first[done]]] = False
    return weights.T


def _estimator(name: str, iterations: int):
    common = {"featuresCol": "used", "labelCol": "label", "fitIntercept": False,
              "standardization": False, "maxIter": iterations}
    spec = ALGORITHMS[name]
    if spec.loss == "hinge":
        return LinearSVC(regParam=spec.strength, **common)
    if spec.loss == "logistic":
        return LogisticRegression(regParam=spec.strength, tol=1e-9, **common)
    return LinearRegression(
        regParam=spec.strength, elasticNetParam=1.0 if spec.penalty == "l1" else 0.0, **common)


def fit_by_estimator(points: DataFrame, masks: np.ndarray, run_of_model: Sequence[int], name: str,
                     iterations: int = 100) -> np.ndarray:
    """The same models by `pyspark.ml` estimators, one fit each."""
    masks = np.asarray(masks, dtype=bool)
    vectors = points.select("label", "in_train", array_to_vector("features").alias("all")).persist(
        StorageLevel.MEMORY_AND_DISK)
    weights = np.zeros(masks.shape)
    for model, mask in enumerate(masks):
        kept = np.flatnonzero(mask)
        slicer = VectorSlicer(inputCol="all", outputCol="used", indices=[int(i) for i in kept])
        training = slicer.transform(vectors.where(F.col("in_train")[run_of_model[model]]))
        weights[model, kept] = _estimator(name, iterations).fit(training).coefficients.toArray()
    vectors.unpersist()
    return weights


def _scoring_task(weights: np.ndarray, run_of_model: list[int], cut_off: float, validation: bool):
    def scores(batches):
        import numpy as np
        import pyarrow as pa

        models = weights.shape[1]
        count, wrong = np.zeros(models, np.int64), np.zeros(models, np.int64)
        square = np.zeros(models)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y, x, used = _arrays(batch)
            used = used[:, run_of_model] != validation
            margin = x @ weights
            count += used.sum(axis=0)
            wrong += (used & ((margin > cut_off) != y)).sum(axis=0)
            square += np.where(used, (margin - y) ** 2, 0.0).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(models)), pa.array(count), pa.array(wrong), pa.array(square)],
            names=["model", "n", "n_wrong", "square_error"])

    return scores


def validation_errors(points: DataFrame, weights: np.ndarray, run_of_model: Sequence[int],
                      cut_off: float, validation: bool = True) -> DataFrame:
    """(model, n, n_wrong, error, rmse) on each model's validation (or training) rows, one pass."""
    partial = points.select("label", "features", "in_train").mapInArrow(
        _scoring_task(np.asarray(weights).T.copy(), list(run_of_model), cut_off, validation),
        "model long, n long, n_wrong long, square_error double")
    n, wrong = F.sum("n"), F.sum("n_wrong")
    return partial.groupBy("model").agg(
        n.alias("n"), wrong.alias("n_wrong"),
        F.try_divide(wrong.cast("double"), n).alias("error"),
        F.sqrt(F.try_divide(F.sum("square_error"), n)).alias("rmse"),
    )


def model_scores(points: DataFrame, weights: np.ndarray, run_of_model: Sequence[int],
                 validation: bool = True) -> DataFrame:
    """(model, score, positives, negatives) of each model's validation (or training) rows, equal
    scores of a batch collapsed; one pass for all models."""
    columns, runs = np.asarray(weights).T.copy(), list(run_of_model)

    def scores(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            y, x, used = _arrays(batch)
            used = used[:, runs] != validation
            margin = x @ columns + 0.0  # no negative zero
            for model in range(columns.shape[1]):
                own = used[:, model]
                value, at = np.unique(margin[own, model], return_inverse=True)
                positive = np.bincount(at, weights=y[own, 0] > 0.5, minlength=len(value)).astype(np.int64)
                count = np.bincount(at, minlength=len(value))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), model)), pa.array(value), pa.array(positive),
                     pa.array(count - positive)], names=["model", "score", "positives", "negatives"])

    return points.select("label", "features", "in_train").mapInArrow(
        scores, "model long, score double, positives long, negatives long")


def model_auc(points: DataFrame, weights: np.ndarray, run_of_model: Sequence[int],
              validation: bool = True, task_rows: int = TASK_ROWS) -> DataFrame:
    """(model, n_positive, n_negative, auc): the share of pairs of a positive and a negative row
    that the score puts in order, ties counting half; null where a model's rows have one class.

    Scores are collapsed to one row per value. Those of a model are put in order piece by piece, and
    the negatives of the pieces before are added to each.
    """
    scored = model_scores(points, weights, run_of_model, validation)
    runs = cut(scored.groupBy("model", "score").agg(
        F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives")))
    totals = runs.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    placed, pieces = with_pieces(runs, ["model"], "score", totals, task_rows)
    before = Window.partitionBy("model", "piece").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("negatives").over(before), F.lit(0))
    sums = placed.withColumn("lower", lower).groupBy("model", "piece").agg(
        F.sum(F.col("positives") * (F.col("lower") + F.col("negatives") / 2.0)).alias("ordered"),
        F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"))
    earlier = Window.partitionBy("model").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("negatives").over(earlier), F.lit(0))  # one row per model and piece
    found = sums.withColumn("offset", offset).groupBy("model").agg(
        F.sum("positives").alias("n_positive"), F.sum("negatives").alias("n_negative"),
        F.sum(F.col("ordered") + F.col("positives") * F.col("offset")).alias("ordered"))
    pairs = F.col("n_positive").cast("double") * F.col("n_negative")
    return found.select("model", "n_positive", "n_negative", F.try_divide("ordered", pairs).alias("auc"))
