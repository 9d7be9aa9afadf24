"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cohortlens.llm.common import slices, table
from cohortlens.session import cut, lookup_side

UNKNOWN = "und"
#: Bytes of a window, value of the padding, widths of the filters.
WINDOW, PAD, WIDTHS = 256, 256, (2, 3, 4)
#: Bound of the training sample: documents of each language and windows of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 4
CHUNK = 192
#: Small samples are gone through as often as this many batches need.
LEAST_STEPS = 300
LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Byte embedding, filters of several widths side by side (rows beyond a filter's width are
    zero), maximum over the window, softmax."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, ids: np.ndarray) -> np.ndarray:
        """(windows, WINDOW, widest x dims): every byte's embedding beside those of the next ones."""
        widest = max(WIDTHS)
        padded = np.full((len(ids), WINDOW + widest - 1), PAD, dtype=ids.dtype)
        padded[:, :WINDOW] = ids
        x = self.embed[padded]
        return np.concatenate([x[:, k:k + WINDOW] for k in range(widest)], axis=2)

    def pooled(self, patches: np.ndarray) -> np.ndarray:
        flat = patches.reshape(-1, patches.shape[2]) @ self.filters
        return flat.reshape(len(patches), WINDOW, -1)

    def log_probabilities(self, ids: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.pooled(self.patches(ids)).max(axis=1) + self.bias, 0)
        return log_softmax(hidden @ self.out + self.out_bias)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(windows: list[bytes], labels: list[str], dims: int = 8, per_width: int = 12,
          epochs: int = 8, batch: int = 128, rate: float = 3e-3, seed: int = 5) -> Network:
    """Adam on cross entropy with equal weight for every language; half of the windows are cut
    short at random, so that short texts are learnt too."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    widest, units = max(WIDTHS), per_width * len(WIDTHS)
    mask = np.zeros((widest * dims, units), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width * dims, k * per_width:(k + 1) * per_width] = 1
    net = Network(
        languages, rng.normal(0, 0.5, (257, dims)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(units, np.float32),
        rng.normal(0, 0.1, (units, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32))
    net.embed[PAD] = 0
    x = padded_windows(windows)
    y = np.array([languages.index(v) for v in labels])
    weight = len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))
    names = ("embed", "filters", "bias", "out", "out_bias")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    for _ in range(max(epochs, LEAST_STEPS // -(-len(x) // batch))):
        order = rng.permutation(len(x))
        for start in range(0, len(x), batch):
            own = order[start:start + batch]
            ids = x[own].copy()
            keep = np.where(rng.random(len(own)) < 0.5, WINDOW, rng.integers(12, WINDOW, len(own)))
            ids[np.arange(WINDOW)[None] >= keep[:, None]] = PAD
            patches = net.patches(ids)
            raw = net.pooled(patches)
            best = raw.argmax(axis=1)
            top = np.take_along_axis(raw, best[:, None], 1)[:, 0] + net.bias
            hidden = np.maximum(top, 0)
            slope = np.exp(log_softmax(hidden @ net.out + net.out_bias))
            slope[np.arange(len(own)), y[own]] -= 1
            slope *= (weight[y[own]] / len(own))[:, None]
            back = (slope @ net.out.T) * (top > 0)
            chosen = patches[np.arange(len(own))[:, None], best]
            spread = np.einsum("bf,df->bfd", back, net.filters).reshape(
                len(own), units, widest, dims)
            padded = np.pad(ids, ((0, 0), (0, widest - 1)), constant_values=PAD)
            at = padded[np.arange(len(own))[:, None, None], best[:, :, None] + np.arange(widest)]
            embed = np.zeros_like(net.embed)
            np.add.at(embed, at.reshape(-1), spread.reshape(-1, dims))
            embed[PAD] = 0
            slopes = {"embed": embed, "filters": np.einsum("bfd,bf->df", chosen, back) * mask,
                      "bias": back.sum(0), "out": hidden.T @ slope, "out_bias": slope.sum(0)}
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * slopes[n]
                second[n] = 0.999 * second[n] + 0.001 * slopes[n] ** 2
                change = rate * (first[n] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, n, (getattr(net, n) - change).astype(np.float32))
    return net


def padded_windows(windows: list[bytes]) -> np.ndarray:
    out = np.full((len(windows), WINDOW), PAD, dtype=np.int16)
    for row, window in zip(out, windows):
        row[:len(window)] = np.frombuffer(window, np.uint8)
    return out


def in_held_out(doc_id):
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, id_col: str, text: str, lang: str) -> tuple[list, list]:
    """Windows of a bounded sample: at most SAMPLE_DOCS documents of every language, drawn at random
    row by row, and SAMPLE_WINDOWS windows spread over each of them. Held-out documents and those without
    language or text are left out."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"),
                         F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_held_out(F.col("id")))
    counts = cut(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    drawn = usable.withColumn("draw", F.rand(3))
    near = drawn.join(lookup_side(counts), "lang").where(F.col("draw") * F.col("n") < 2 * SAMPLE_DOCS + 20)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, lang_, value in zip(*(c.to_pylist() for c in batch.columns)):
                data = value.encode()
                n = -(-len(data) // WINDOW)
                for k in sorted({j * n // SAMPLE_WINDOWS for j in range(SAMPLE_WINDOWS)} & set(range(n))):
                    rows.append((doc, lang_, data[k * WINDOW:(k + 1) * WINDOW]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(r[0]) for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.binary())], names=["id", "lang", "window"])

    order = Window.partitionBy("lang").orderBy("draw", "id", "text")
    chosen = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS)
    rows = chosen.select("id", "lang", "text").mapInArrow(
        windows, "id string, lang string, window binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["id"], bytes(r["window"])))
    return [bytes(r["window"]) for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network for `docs`, or None where no document can be learnt from."""
    windows, labels = training_windows(docs, id_col, text, lang)
    return train(windows, labels) if labels else None


def scores_of(texts: list[str | None], net: Network) -> tuple[list[str], list[float]]:
    """Language and probability of whole texts: mean log probability over all windows of a text,
    weighted by their bytes. UNKNOWN with score 0 for null and for texts without a letter."""
    total = np.zeros((len(texts), len(net.languages)))
    size = np.zeros(len(texts))
    owner: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if held:
            own, ids = np.concatenate(owner), np.concatenate(parts)
            for start in range(0, held, CHUNK):
                block = ids[start:start + CHUNK]
                n = (block != PAD).sum(axis=1)
                np.add.at(total, own[start:start + CHUNK], net.log_probabilities(block) * n[:, None])
                np.add.at(size, own[start:start + CHUNK], n)
        owner.clear()
        parts.clear()
        held = 0

    known = [bool(t) and LETTER.search(t) is not None for t in texts]
    for k, value in enumerate(texts):
        if not known[k]:
            continue
        data = np.frombuffer(value.encode("utf-8", "replace"), np.uint8)
        for start in range(0, len(data), WINDOW * 8 * CHUNK):
            piece = data[start:start + WINDOW * 8 * CHUNK]
            n = -(-len(piece) // WINDOW)
            ids = np.full(n * WINDOW, PAD, dtype=np.int16)
            ids[:len(piece)] = piece
            owner.append(np.full(n, k))
            parts.append(ids.reshape(n, WINDOW))
            held += n
            if held >= 8 * CHUNK:
                flush()
    flush()
    mean = log_softmax(total / np.maximum(size, 1)[:, None])
    best = mean.argmax(axis=1)
    return ([net.languages[b] if k else UNKNOWN for b, k in zip(best, known)],
            [float(np.exp(m[b])) if k else 0.0 for m, b, k in zip(mean, best, known)])


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (columns of these names are replaced). Rows are judged one
    by one in whole texts; copies get the same answer. Without a network every text is UNKNOWN."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if net is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    at = names.index(text)
    kept = docs.select(*names)
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores = scores_of(batch.column(at).to_pylist(), net)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*names, "lang_pred", "score"])

    return kept.mapInArrow(predict, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs)
    return identify(docs.select("doc_id", "text"), net).select(
        "doc_id", in_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
