"""Cross-validation: repeated splits, model fits, feature elimination and model choice."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.elimination import best_models, random_masks, smallest_dropped
from cohortlens.operators.linear_models import (
    MEMORY, algorithm, check_points, fit_by_estimator, fit_by_gradient, fit_by_lbfgs, model_auc,
    validation_errors,
)
from cohortlens.operators.splits import in_training
from cohortlens.session import cut

# Largest weight matrix (models x features) sent to tasks at once, in values.
WEIGHTS_PER_BATCH = 8_000_000


@dataclass(frozen=True)
class CrossValidationResult:
    """`curve`: (run, step, n_features, n, n_wrong, error, rmse[, auc]) per model;
    `weights`: (run, step, feature, weight) per model and feature used. Both are written tables."""

    curve: DataFrame
    weights: DataFrame
    settings: dict

    def best(self) -> DataFrame:
        return best_models(self.curve)

    def best_weights(self) -> DataFrame:
        return self.weights.join(
            F.broadcast(self.best().select("run", "step")), ["run", "step"], "left_semi")

    def documents(self) -> DataFrame:
        """One result row per run, as it is stored: the chosen model's error and size, the curve (a
        row per elimination step) and the settings. Features and weights of the chosen model are the
        table `best_weights`, keyed by run, as they may be many."""
        best = self.best().select(
            "run", F.col("error").alias("ModelPerf"), F.col("step").alias("ModelStep"),
            F.col("n_features").alias("NumberOfFeatures"))
        curve = self.curve.groupBy("run").agg(
            F.array_sort(F.collect_list(F.struct("step", "n_features", "n_wrong", "error"))).alias("PerformanceCurve"))
        settings = self.settings
        text = " ".join(str(settings[k]) for k in ("algorithm", "train_fraction", "runs", "drop"))
        return best.join(curve, "run").select(
            "run", "ModelPerf", "ModelStep", "NumberOfFeatures", F.lit(0.0).alias("ModelIntercept"),
            "PerformanceCurve",
            F.lit(settings["algorithm"]).alias("AlgorithmUsed"),
            F.lit(settings["train_fraction"]).alias("kfold"),
            F.lit(settings["runs"]).alias("Resampling"),
            F.lit(text).alias("WorkflowSpecificParameters"),
            F.lit(settings["drop"]).alias("NumberOfFeaturesToRemove"),
            F.current_timestamp().alias("EndTime"), F.lit("completed").alias("Status"),
        )


def prepare(points: DataFrame, seeds: Sequence[int], train_fraction: float) -> DataFrame:
    """Points with one training flag per run; all runs share one table."""
    flags = F.array(*[in_training(s, F.col("sample_id"), train_fraction) for s in seeds])
    return points.select("label", "features", flags.alias("in_train"))


def _fit(points, masks, runs, name, engine, iterations, tolerance) -> np.ndarray:
    spec = algorithm(name)
    if engine == "estimator":
        return fit_by_estimator(points, masks, runs, name, iterations)
    # L-BFGS holds two vectors of weights for every step that it remembers
    per_batch = max(1, WEIGHTS_PER_BATCH // masks.shape[1] // (1 if spec.by_gradient else 2 * MEMORY))
    parts = []
    for i in range(0, len(masks), per_batch):
        batch = masks[i:i + per_batch], runs[i:i + per_batch], spec
        parts.append(fit_by_gradient(points, *batch, iterations, tolerance) if spec.by_gradient
                     else fit_by_lbfgs(points, *batch))
    return np.vstack(parts)


def weight_table(spark: SparkSession, models: DataFrame, features: Sequence[str], masks: np.ndarray,
                 weights: np.ndarray) -> DataFrame:
    """(run, step, feature, weight) of the features that each model uses. `models` has a row per
    model; tasks turn their models' rows of the matrices into table rows, written once, so that the
    driver holds no row per model and feature."""
    names = np.asarray(features, dtype=object)
    shared = spark.sparkContext.broadcast((names, np.asarray(masks, dtype=bool), np.asarray(weights)))

    def unfold(batches):
        import pyarrow as pa

        names, masks, weights = shared.value
        for batch in batches:
            for model, run, step in zip(*(c.to_pylist() for c in batch.columns)):
                kept = np.flatnonzero(masks[model])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(kept), run)), pa.array(np.full(len(kept), step)),
                     pa.array(names[kept], pa.string()), pa.array(weights[model, kept])],
                    names=["run", "step", "feature", "weight"])

    table = cut(models.select("model", "run", "step").mapInArrow(
        unfold, "run bigint, step bigint, feature string, weight double"))
    shared.unpersist()
    return table


def cross_validate(points: DataFrame, features: Sequence[str], name: str, *,
                   train_fraction: float = 0.8, runs: int = 1, seed: int = 0, drop: float = 0.1,
                   floor: int = 100, order: str = "random", engine: str = "gradient",
                   iterations: int = 100, tolerance: float = 1e-3, auc: bool = False
                   ) -> CrossValidationResult:
    """Train, prune and validate models over repeated splits.

    `points` is (sample_id, label, features); `features` names the positions. Each step drops a
    share (`drop` < 1) or a count of features until at most `floor` are left: at random, or with
    `order="weights"` those with the smallest absolute weight. A random order is known before any
    fit, so all its models, of all runs and steps, are trained together. `auc` adds the area under
    the ROC curve of the validation rows, in one more pass.
    """
    if order not in ("random", "weights"):
        raise ValueError("order must be 'random' or 'weights'")
    if engine not in ("gradient", "estimator"):
        raise ValueError("engine must be 'gradient' or 'estimator'")
    if not 0 < train_fraction < 1:
        raise ValueError("train_fraction must lie between 0 and 1")
    if drop <= 0 or runs < 1:
        raise ValueError("drop must be positive and runs at least 1")
    spec = algorithm(name)
    features = list(features)
    seeds = [seed + run for run in range(runs)]
    spark = points.sparkSession
    prepared = prepare(points, seeds, train_fraction).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        check_points(prepared, len(features))
        fit = partial(_fit, prepared, name=name, engine=engine, iterations=iterations, tolerance=tolerance)
        if order == "random":
            steps = [random_masks(features, s, drop, floor) for s in seeds]
            of_model = [(run, step) for run in range(runs) for step in range(len(steps[run]))]
            masks = np.vstack(steps)
            weights = fit(masks, [run for run, _ in of_model])
        else:
            of_model, masks, weights = _pruned_models(fit, features, runs, drop, floor)
        # one row per model
        models = spark.createDataFrame(
            [(i, run, step, int(masks[i].sum())) for i, (run, step) in enumerate(of_model)],
            "model bigint, run bigint, step bigint, n_features bigint").repartition(len(of_model), "model")
        run_of_model = [run for run, _ in of_model]
        errors = validation_errors(prepared, weights, run_of_model, spec.cut_off)
        curve = models.join(errors, "model", "left")
        columns = ["run", "step", "n_features", F.coalesce("n", F.lit(0)).alias("n"),
                   F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"), "error", "rmse"]
        if auc:
            curve = curve.join(model_auc(prepared, weights, run_of_model), "model", "left")
            columns.append("auc")
        curve = cut(curve.select(*columns))
    finally:
        prepared.unpersist()
    settings = {"algorithm": name, "train_fraction": train_fraction, "runs": runs, "drop": drop}
    table = weight_table(spark, models, features, masks, weights)
    return CrossValidationResult(curve, table, settings)


def _pruned_models(fit, features, runs, drop, floor):
    """Models of an elimination by weight: each step needs the weights of the one before."""
    of_model, masks, weights = [], [], []
    kept = np.ones((runs, len(features)), dtype=bool)
    while True:
        fitted = fit(kept, list(range(runs)))
        of_model += [(run, len(weights)) for run in range(runs)]
        masks.append(kept)
        weights.append(fitted)
        if kept[0].sum() <= max(floor, 1):
            return of_model, np.vstack(masks), np.vstack(weights)
        kept = np.vstack([smallest_dropped(kept[run], np.abs(fitted[run]), features, drop) for run in range(runs)])
