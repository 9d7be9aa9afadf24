"""Moments of ranks of all feature pairs, ranks taken among the samples that both features have.

What deletion leaves of a feature depends on its partner's missing samples only, so a feature is
ranked once for every distinct set of present samples (a mask), not once for every partner. Each
sample carries a bitmap of the masks it belongs to. One task has a feature in value order and ranks
it under all masks of a block of partners by running sums over the bitmaps. Ranks then travel as
arrays, one per feature, block of partners and chunk of samples; there is no row per sample and
pair. Tasks over two blocks of features and a chunk multiply them as matrices.

Features with more rows than a task should hold are cut into pieces at approximate quantiles; ranks
within a piece are exact and are moved by the rows of the pieces before it. A value that fills more
than a piece is a piece of its own, spread over several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.ranking import with_pieces
from cohortlens.session import cut, lookup_side

# Features per block, samples per chunk, rows of a feature that one task ranks: with a mask for every
# feature, a task of two blocks holds 2 x 2048 x 64 x 64 ranks. With fewer features or masks a chunk
# takes more samples, up to MOST_SAMPLES: a piece gives a row to every chunk it has samples of, so
# short chunks would make rows grow with the square of the samples.
BLOCK_FEATURES = 64
CHUNK_SAMPLES = 2048
MOST_SAMPLES = 1 << 17
PIECE_ROWS = 250_000

_RANKS = ("left int, right int, chunk int, idx bigint, mask int, piece int, samples array<bigint>, "
          "twice array<bigint>")
_MOMENTS = (
    "i bigint, j bigint, n bigint, sx double, sy double, sxx double, syy double, sxy double, "
    "min_x double, max_x double, min_y double, max_y double"
)


def one_per_cell(values: DataFrame) -> DataFrame:
    """One row per feature and sample; of repeated ones the largest value counts."""
    return values.groupBy("feature", "sample_id").agg(F.max("value").alias("value"))


def number_features(values: DataFrame) -> DataFrame:
    """(feature, idx, mask, n): one row per feature. Features present in the same samples have one
    mask; both numbers start at 0 and features of one mask are neighbours."""
    sample = F.xxhash64("sample_id")
    prints = values.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(sample).alias("a"),
        F.bit_xor(F.xxhash64("sample_id", F.lit(1))).alias("b"))
    # windows over one row per feature
    order = Window.orderBy("n", "a", "b", "feature")
    numbered = prints.select(
        "feature", "n", (F.row_number().over(order) - 1).cast("bigint").alias("idx"),
        (F.dense_rank().over(Window.orderBy("n", "a", "b")) - 1).cast("int").alias("mask"))
    return cut(numbered)


def _mask_bits(cells: DataFrame, numbered: DataFrame) -> DataFrame:
    """(sample_id, bits): which masks each sample belongs to, read off one feature of each mask."""
    masks = numbered.agg(F.max("mask")).first()[0] + 1
    shown = lookup_side(numbered.groupBy("mask").agg(F.min("idx").alias("idx")))
    listed = cells.select("idx", "sample_id").join(shown, "idx").groupBy("sample_id").agg(F.collect_list("mask").alias("masks"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                sizes = np.diff(part.column(1).offsets.to_numpy())
                dense = np.zeros((part.num_rows, masks), dtype=bool)
                dense[np.repeat(np.arange(part.num_rows), sizes), part.column(1).flatten().to_numpy()] = True
                rows = [r.tobytes() for r in np.packbits(dense, axis=1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())],
                                                 names=["sample_id", "bits"])

    return listed.mapInArrow(pack, "sample_id bigint, bits binary")


def _rank_task(spans: list[tuple[int, int]], block: int):
    """Task: a piece of one feature in value order, ranked under the masks of a block of partners.
    Ranks are doubled, so that ties stay whole numbers, and 0 where the mask lacks the sample. One
    row per chunk; the row with chunk -1 counts the piece's samples of each mask."""

    def ranks(key, frame):
        import numpy as np
        import pandas as pd

        idx, piece, part, partner = (int(k) for k in key)
        low, high = spans[partner]
        frame = frame.sort_values("value", kind="stable")
        value = frame["value"].to_numpy()
        packed = np.frombuffer(b"".join(frame["bits"]), dtype=np.uint8).reshape(len(frame), -1)
        inside = np.unpackbits(packed[:, low // 8:high // 8 + 1], axis=1)[
            :, low % 8:low % 8 + high - low + 1]
        running = np.zeros((len(frame) + 1, inside.shape[1]), dtype=np.int64)
        np.cumsum(inside, axis=0, out=running[1:])
        if piece % 2:  # one value spread over tasks: its ranks follow from the counts of all of them
            twice = inside.astype(np.int64)
        else:
            first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            run = np.repeat(np.arange(len(first)), np.diff(first, append=len(frame)))
            below, upto = running[first], running[np.append(first[1:], len(frame))]
            twice = np.where(inside, (below + upto + 1)[run], 0)
        chunk = frame["chunk"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        cuts = np.flatnonzero(np.diff(chunk[order])) + 1
        samples, mask = frame["sample_id"].to_numpy(), int(frame["mask"].iloc[0])
        own = idx // block
        head = (min(own, partner), max(own, partner))
        rows = [(*head, int(chunk[rows_[0]]), idx, mask, piece, samples[rows_], twice[rows_].reshape(-1))
                for rows_ in np.split(order, cuts)]
        rows.append((*head, -1, idx, mask, piece, None, running[-1]))
        return pd.DataFrame(rows, columns=["left", "right", "chunk", "idx", "mask", "piece", "samples", "twice"])

    return ranks


def _with_shift(ranked: DataFrame) -> DataFrame:
    """Add `shift`, what doubled ranks under each mask move by: twice the samples of the pieces
    before, and for a piece of one value as much as its own samples."""
    keys = ["left", "right", "idx"]
    counts = ranked.where("chunk = -1").select(*keys, "piece", F.posexplode("twice").alias("m", "n"))
    counts = counts.groupBy(*keys, "piece", "m").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*keys, "m").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = 2 * F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("n") * (F.col("piece") % 2)
    moved = counts.select(*keys, "piece", F.struct("m", shift.alias("shift")).alias("entry"))
    moved = moved.groupBy(*keys, "piece").agg(F.array_sort(F.collect_list("entry"))["shift"].alias("shift"))
    return ranked.join(moved, [*keys, "piece"])


def _moment_task(spans: list[tuple[int, int]], block: int, features: int):
    """Task: moments of the ranks of all pairs of two blocks within one chunk of samples."""

    def moments(key, frame):
        import numpy as np
        import pandas as pd

        left, right = int(key[0]), int(key[1])
        universe = np.unique(np.concatenate(frame["samples"].to_list()))
        shape = (min(block, features - left * block), min(block, features - right * block))
        out = {name: np.zeros(shape) for name in ("n", "sx", "sy", "sxx", "syy", "sxy")}
        out |= {"min_x": np.full(shape, np.inf), "max_x": np.full(shape, -np.inf)}
        out |= {"min_y": np.full(shape, np.inf), "max_y": np.full(shape, -np.inf)}

        def side(own, partner):
            """({mask: its features' places in the block}, ranks by (place, partner's mask, sample))"""
            low, high = spans[partner]
            dense = np.zeros((min(block, features - own * block), high - low + 1, len(universe)))
            masks: dict[int, set[int]] = {}
            rows = frame[frame["idx"] // block == own]
            for idx, mask, samples, twice, shift in zip(
                    rows["idx"], rows["mask"], rows["samples"], rows["twice"], rows["shift"]):
                ranks = twice.reshape(len(samples), -1)
                if shift is not None:
                    ranks = ranks + np.asarray(shift) * (ranks > 0)
                dense[idx % block][:, np.searchsorted(universe, samples)] = ranks.T
                masks.setdefault(int(mask), set()).add(int(idx % block))
            return {m: np.array(sorted(own_)) for m, own_ in masks.items()}, dense

        x_of, x_all = side(left, right)
        y_of, y_all = (x_of, x_all) if left == right else side(right, left)
        for a, i in x_of.items():
            for b, j in y_of.items():
                x, y = x_all[i, b - spans[right][0]], y_all[j, a - spans[left][0]]
                common = x[0] > 0  # the samples of both masks, for all features of these masks
                x, y, at = x[:, common], y[:, common], np.ix_(i, j)
                if not x.shape[1]:
                    continue
                out["n"][at] = x.shape[1]
                out["sx"][at], out["sy"][at] = x.sum(axis=1)[:, None], y.sum(axis=1)[None]
                out["sxx"][at], out["syy"][at] = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None]
                out["sxy"][at] = x @ y.T
                out["min_x"][at], out["max_x"][at] = x.min(axis=1)[:, None], x.max(axis=1)[:, None]
                out["min_y"][at], out["max_y"][at] = y.min(axis=1)[None], y.max(axis=1)[None]
        i, j = np.meshgrid(np.arange(shape[0]) + left * block, np.arange(shape[1]) + right * block, indexing="ij")
        keep = i <= j
        columns = {"i": i, "j": j} | out
        columns["n"] = out["n"].astype(np.int64)
        return pd.DataFrame({name: matrix[keep] for name, matrix in columns.items()})

    return moments


def chunk_samples(chunk: int, block: int, features: int, masks: int) -> int:
    """Samples of a chunk that hold as many ranks as `chunk` samples of full blocks do."""
    ranks = min(block, max(features, 1)) * masks
    return max(chunk, min(MOST_SAMPLES, chunk * block * block // ranks))


def rank_moments(values: DataFrame, numbered: DataFrame, block: int = BLOCK_FEATURES,
                 chunk: int = CHUNK_SAMPLES, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(i, j, n, sums over the doubled ranks) of every pair i <= j of the numbered features.

    `values` has one row per feature and sample. Pairs without a common sample have n = 0.
    """
    features = numbered.count()
    blocks = math.ceil(features / block)
    samples = values.agg(F.approx_count_distinct("sample_id")).first()[0]
    # one row per block of features
    own = F.expr(f"CAST(idx div {block} AS INT)")
    spans = {r["own"]: (r["low"], r["high"]) for r in numbered.groupBy(own.alias("own")).agg(
        F.min("mask").alias("low"), F.max("mask").alias("high")).collect()}
    spans = [spans[k] for k in range(blocks)]
    masks = max((high - low + 1 for low, high in spans), default=1)
    chunks = max(1, math.ceil(samples / chunk_samples(chunk, block, features, masks)))

    names = lookup_side(numbered.select("feature", "idx", "mask"))
    cells = values.join(names, "feature").select("idx", "mask", "sample_id", "value")
    totals = numbered.select("idx", "n")
    placed, pieces = with_pieces(cells, ["idx"], "value", totals, piece_rows)
    # rows of a value that fills several pieces are dealt by sample, to as many tasks
    part = F.when(F.col("full"), F.pmod(F.xxhash64("sample_id", F.lit(1)), F.col("width") + 1)).otherwise(F.lit(0))
    placed = placed.select(
        "idx", "mask", "sample_id", "value", part.cast("int").alias("part"),
        (2 * F.col("piece") + F.col("full").cast("int")).cast("int").alias("piece"),
        F.pmod(F.xxhash64("sample_id"), F.lit(chunks)).cast("int").alias("chunk"))
    placed = placed.join(_mask_bits(cells, numbered), "sample_id")
    partners = F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))).alias("partner")
    ranked = placed.select("*", partners).groupBy("idx", "piece", "part", "partner").applyInPandas(
        _rank_task(spans, block), _RANKS)
    if pieces > 1:
        ranked = _with_shift(cut(ranked))
    else:
        ranked = ranked.withColumn("shift", F.lit(None).cast("array<bigint>"))
    partial = ranked.where("chunk >= 0").groupBy("left", "right", "chunk").applyInPandas(
        _moment_task(spans, block, features), _MOMENTS)
    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    return partial.groupBy("i", "j").agg(
        *[F.sum(name).alias(name) for name in sums],
        F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"),
        F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"))
