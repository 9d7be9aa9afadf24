"""Stepwise removal of features and the choice among the models it yields."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_count(features: int, drop: float) -> int:
    """How many features one step removes: a share below 1, otherwise a count."""
    if drop >= 1:
        return int(drop)
    return max(1, math.floor(features * drop + 0.5))


def draw(seed: int, step: int, feature: str) -> str:
    """Random but reproducible removal order of a step: smallest digest goes first."""
    return hashlib.md5(f"{seed}|{step}|{feature}".encode()).hexdigest()


def eliminate_step(features: DataFrame, seed: int, step: int, drop: float) -> DataFrame:
    """(pos, feature) left after one random step; the table has one row per feature."""
    total = features.agg(F.count(F.lit(1)).alias("total"))
    share = F.greatest(F.lit(1), F.floor(F.col("total") * drop + 0.5))
    dropped = F.lit(int(drop)) if drop >= 1 else share
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(step)), F.col("feature")))
    order = F.row_number().over(Window.orderBy(digest, "feature"))
    return (
        features.withColumn("nth", order).join(F.broadcast(total), F.lit(True))  # one row
        .where(F.col("nth") > dropped).select("pos", "feature")
    )


def next_features(kept: list[str], drop: float, order: dict[str, object]) -> list[str]:
    """`kept` without the features that come first in `order`; never empty."""
    gone = min(drop_count(len(kept), drop), len(kept) - 1)
    first = set(sorted(kept, key=lambda f: (order[f], f))[:gone])
    return [f for f in kept if f not in first]


def random_schedule(features: list[str], seed: int, drop: float, floor: int) -> list[list[str]]:
    """All feature lists of a random elimination; they do not depend on any fitted model."""
    lists = [list(features)]
    while len(lists[-1]) > max(floor, 1):
        step = len(lists)
        lists.append(next_features(
            lists[-1], drop, {f: draw(seed, step, f) for f in lists[-1]}))
    return lists


def smallest_dropped(kept: np.ndarray, size: np.ndarray, features: Sequence[str], drop: float) -> np.ndarray:
    """The mask `kept` without the features of smallest size, ties by name; never empty."""
    inside = np.flatnonzero(kept)
    gone = min(drop_count(len(inside), drop), len(inside) - 1)
    order = sorted(inside.tolist(), key=lambda i: (size[i], features[i]))
    left = kept.copy()
    left[order[:gone]] = False
    return left


def random_masks(features: Sequence[str], seed: int, drop: float, floor: int) -> np.ndarray:
    """`random_schedule` as a mask (steps x features)."""
    masks = [np.ones(len(features), dtype=bool)]
    while masks[-1].sum() > max(floor, 1):
        inside = np.flatnonzero(masks[-1])
        step = len(masks)
        order = sorted(inside.tolist(), key=lambda i: (draw(seed, step, features[i]), features[i]))
        left = masks[-1].copy()
        left[order[:min(drop_count(len(inside), drop), len(inside) - 1)]] = False
        masks.append(left)
    return np.array(masks)


def best_models(curve: DataFrame) -> DataFrame:
    """Per run the lowest error to four decimals, the fewest features among ties."""
    order = Window.partitionBy("run").orderBy(F.round("error", 4), "n_features", "step")
    return curve.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == 1).drop("nth")
