"""Vector code compression: codebooks per part of the vector, entries found by Orchard search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import slices, stored, table
from cohortlens.session import lookup_side

#: Parts of a vector, entries of a codebook, rounds of assigning and averaging, scale of components.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                   label: str = "label") -> DataFrame:
    """(vec_id, label, cells): components as integers, without vectors that are null or hold a null
    or non-finite component. Cells stay within the bound under which no squared distance of a whole
    vector leaves a long: 2^27 for 64 components, i.e. components of half a million."""
    v = F.col(vector).cast("array<double>")
    # of an empty vector, too, the bound is that of one component
    bound = F.floor(F.sqrt(F.lit(2.0 ** 60) / F.greatest(F.size(v), F.lit(1))))
    cells = F.transform(v, lambda x: F.greatest(-bound, F.least(bound, F.floor(
        F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x)) * SCALE))).cast("int"))
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return vectors.where(v.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), cells.alias("cells"))


def first_entries(kept: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks (part, entry, position) out of the vectors with the smallest ids; equal ids go by
    content, null ids come last. None where the vectors cannot be cut into equal parts."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("cells").asc()]
    width = kept.orderBy(*order).select(F.size("cells")).limit(1).collect()
    if not width or width[0][0] == 0 or width[0][0] % parts:
        return None
    rows = kept.where(F.size("cells") == width[0][0]).orderBy(*order).limit(entries).collect()
    first = np.array([r["cells"] for r in rows], dtype=np.int64)
    return first.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


class Neighbours:
    """For every entry of one codebook the other entries, nearest first, with squared distances."""

    def __init__(self, book: np.ndarray):
        self.book = book
        gap = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(gap, axis=1, kind="stable")
        self.gap = np.take_along_axis(gap, self.order, axis=1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for every point, ties to the lower entry.

        All points walk at the same time, each along the list of its present entry. An entry met is
        marked; a better one (nearer, or as near with a lower number) becomes the present entry and
        its list begins. A walk ends at an entry farther from the present one than twice the
        point's distance: by the triangle inequality that entry and all behind it are farther from
        the point than the present one.
        """
        n, size = len(points), len(self.book)
        here = np.zeros(n, dtype=np.int64)
        best = ((points - self.book[0]) ** 2).sum(axis=1)
        visited = np.zeros((n, size), dtype=bool)
        visited[:, 0] = True
        place = np.zeros(n, dtype=np.int64)
        walking = np.arange(n)
        while len(walking):
            at, step = here[walking], place[walking]
            going = step < size
            going[going] = self.gap[at[going], step[going]] <= 4 * best[walking[going]]
            walking, at, step = walking[going], at[going], step[going]
            entry = self.order[at, step]
            place[walking] = step + 1
            fresh = ~visited[walking, entry]
            who, what = walking[fresh], entry[fresh]
            visited[who, what] = True
            gap = ((points[who] - self.book[what]) ** 2).sum(axis=1)
            better = (gap < best[who]) | ((gap == best[who]) & (what < here[who]))
            who, what = who[better], what[better]
            here[who], best[who], place[who] = what, gap[better], 0
        return here, best


def _assignments(books: np.ndarray, batch: pa.RecordBatch, cells: int) -> Iterator[tuple]:
    """(rows with that many cells, their parts, entries, squared distances) of a batch."""
    parts, _, width = books.shape
    column = batch.column(cells)
    known = np.flatnonzero(np.diff(column.offsets.to_numpy()) == parts * width)
    if not len(known):
        return
    own = column.take(pa.array(known)).flatten().to_numpy().astype(np.int64).reshape(len(known), parts, width)
    lists = [Neighbours(book) for book in books]
    found = [lists[p].nearest(own[:, p, :]) for p in range(parts)]
    yield known, own, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def averaged(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floors of the means of the parts assigned to each entry. A task
    sends one row per part, entry and position; what comes back is as large as the codebooks."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(books), np.zeros((parts, entries), dtype=np.int64)
        for batch in slices(batches, 8192):
            for _, own, codes, _ in _assignments(books, batch, 0):
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], own[:, p, :])
                    count[p] += np.bincount(codes[:, p], minlength=entries)
        used = np.repeat(count.reshape(-1), width)
        slot = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(total.reshape(-1)[slot]), pa.array(used[slot])],
            names=["slot", "total", "n"])

    # decimals: a sum of cells may leave a long on a table of many far vectors
    sums = kept.select("cells").mapInArrow(add, "slot long, total long, n long").groupBy("slot").agg(
        F.sum(F.col("total").cast("decimal(19,0)")).alias("total"), F.sum("n").alias("n"))
    new = books.reshape(-1).copy()
    for row in sums.collect():
        new[row["slot"]] = int(row["total"]) // row["n"]
    return new.reshape(books.shape)


def encoded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error); null code and error for vectors of another length."""
    kind = kept.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            codes, errors = np.full(batch.num_rows, None, dtype=object), np.full(batch.num_rows, None, dtype=object)
            for rows, _, found, gaps in _assignments(books, batch, 2):
                codes[rows] = [bytes(c).hex() for c in found.astype(np.uint8)]
                errors[rows] = gaps.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                names=["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "cells").mapInArrow(
        code, f"vec_id long, label {kind}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """((vec_id, code, error, label_error) of every usable vector, codebooks).

    Vectors that are null or hold null or non-finite components are dropped, others all stay;
    repeated rows and null ids count as vectors of their own. The length of the vector with the
    smallest id is that of the table: vectors of other lengths, and all vectors where it is 0 or no
    multiple of `parts`, have null code and error and add nothing to an average or a label's sum.
    With fewer vectors than `entries` the codebooks are shorter. An empty table gives no rows.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    kept = stored(usable_vectors(vectors, id_col, vector, label))
    books = first_entries(kept, parts, entries)
    if books is None:
        rows = kept.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"),
                           F.lit(None).cast("long").alias("label_error"))
        return rows, None
    for _ in range(rounds):
        books = averaged(kept, books)
    coded = stored(encoded(kept, books))
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(19,0)")).cast("long").alias("label_error"))
    sums = lookup_side(sums.withColumnRenamed("label", "_label"))
    rows = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return rows.select("vec_id", "code", "error", "label_error"), books


def digest(books: np.ndarray | None) -> str:
    """sha256 of all entries' components by part, entry and position, joined by commas."""
    flat = [] if books is None else books.reshape(-1).tolist()
    return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def bits_per_component(width: int, parts: int = PARTS, entries: int = ENTRIES) -> float:
    return parts * math.ceil(math.log2(entries)) / width


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return rows.withColumn("codebooks_sha256", F.lit(digest(books)))


def _oracle() -> str:
    """The same by comparing every part with every entry."""
    assign = """
a{r} AS (SELECT vec_id, part, x, arg_min(entry, (gap, entry)) AS entry, min(gap) AS gap FROM (
  SELECT p.vec_id, p.part, p.x, b.entry,
    list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS gap
  FROM parts p JOIN b{r} b USING (part)) GROUP BY vec_id, part, x)"""
    average = """
m{r} AS (SELECT part, entry, list(cell ORDER BY pos) AS x FROM (
  SELECT part, entry, pos, floor(sum(x[pos])::DOUBLE / count(*))::BIGINT AS cell
  FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS pos FROM a{r}) GROUP BY part, entry, pos)
  GROUP BY part, entry),
b{s} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (part, entry))"""
    steps = "".join(f",{assign.format(r=r)}" + (f",{average.format(r=r, s=r + 1)}" if r < ROUNDS else "")
                    for r in range(ROUNDS + 1))
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x
  FROM kept, range({PARTS}) t(part)),
first_ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS (SELECT part, entry, x FROM parts JOIN first_ids USING (vec_id)){steps},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books"""


ORACLE = _oracle()
