"""Exact removal of repeated passages: suffix arrays over the places where a passage can repeat.

A window is any `SPAN` bytes of a document. Every window has an anchor, the `GRAM` bytes in it whose
hash is smallest; equal windows have equal anchors at the same place. Neighbouring windows with one
anchor are a record, a segment of text of at most 2 * SPAN - GRAM bytes. Records whose anchor occurs
once cannot repeat. Records of equal segments repeat as a whole. Only distinct segments with one
anchor are compared as text, by suffix arrays over groups of anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import slices, stored, table
from cohortlens.llm.suffix_sort import Suffixes
from cohortlens.session import lookup_side

SPAN, GRAM = 200, 50
#: Windows whose anchors are worked out at a time, and bytes of segments in one suffix array.
PIECE, GROUP_BYTES = 1 << 17, 1_500_000
_PLACE = np.uint64(18)  # bits of a place in a piece
#: Odd multiplier of the rolling hash and its inverse modulo 2^64.
_MULTIPLIER = 0x9E3779B97F4A7C15


def _powers(x: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x, dtype=np.uint64)]))


class Anchors:
    """(hash of the anchor, first window, last window) of every record of a text."""

    def __init__(self) -> None:
        self.up = _powers(_MULTIPLIER, PIECE + SPAN)
        self.down = _powers(pow(_MULTIPLIER, -1, 1 << 64), PIECE + SPAN)

    def _grams(self, byte: np.ndarray) -> np.ndarray:
        n = len(byte)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((byte.astype(np.uint64) + np.uint64(1)) * self.down[:n], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * self.up[:n - GRAM + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h

    def of(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        width = SPAN - GRAM + 1
        for start in range(0, len(text) - SPAN + 1, PIECE):
            h = self._grams(np.frombuffer(text[start:start + PIECE + SPAN - 1], dtype=np.uint8))
            # smallest of `width` neighbours, by doubling; the leftmost of equal ones
            low = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
            reach = 1
            while 2 * reach <= width:
                low = np.minimum(low[:-reach], low[reach:])
                reach *= 2
            if reach < width:
                low = np.minimum(low[:len(low) - (width - reach)], low[width - reach:])
            first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
            last = np.append(first[1:], len(low)) - 1
            place = (low[first] & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
            yield h[place], first + start, last + start


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def records(docs: DataFrame, text: str) -> DataFrame:
    """(row, digest, anchor, segment, first, last): one row per document with its records; `segment`
    is a hash of the record's text. Null text is empty. `row` is fixed once this is stored."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in slices(batches):
            digests, columns = [], [[], [], [], []]
            for raw in batch.column(0).to_pylist():
                raw = raw or b""
                digests.append(_digest(raw))
                parts = list(anchors.of(raw))
                whole = [np.concatenate(p) for p in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
                segments = [xxhash.xxh3_64_intdigest(raw[a:b + SPAN]) for a, b in zip(whole[1].tolist(), whole[2].tolist())]
                for column, value in zip(columns, [whole[0].astype(np.uint64).view(np.int64),
                                                   np.array(segments, dtype=np.uint64).view(np.int64), *whole[1:]]):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), *(pa.array(c, pa.list_(pa.int64())) for c in columns[:2]),
                 *(pa.array(c, pa.list_(pa.int32())) for c in columns[2:])],
                names=["digest", "anchor", "segment", "first", "last"])

    kinds = "digest binary, anchor array<long>, segment array<long>, first array<int>, last array<int>"
    found = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(find, kinds)
    return found.withColumn("row", F.monotonically_increasing_id())


def packed_texts(docs: DataFrame, text: str, id_col: str | None = None) -> DataFrame:
    """(digest, packed[, doc_id]): texts compressed, as they are about to be shuffled."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(t) for t in texts], pa.binary()), pa.array([squeeze.compress(t) for t in texts], pa.binary()),
                 *batch.columns[1:]], names=["digest", "packed"] + ["doc_id"] * (id_col is not None))

    chosen, kinds = [F.col(text).cast("binary").alias("text")], "digest binary, packed binary"
    if id_col is not None:
        chosen, kinds = [*chosen, F.col(id_col).cast("long").alias("doc_id")], kinds + ", doc_id long"
    return docs.select(*chosen).mapInArrow(pack, kinds)


def segment_texts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(bucket, tile, row, first, single, content): the texts of the segments that `wanted` lists by
    document: (digest, row, segments of (first, width, single, bucket, tile))."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        done = set()  # copies of a text give its segments once
        for batch in slices(batches):
            out = [[] for _ in range(6)]
            for digest, packed, row, parts in zip(*(c.to_pylist() for c in batch.columns)):
                if digest in done:
                    continue
                done.add(digest)
                raw = unpack.decompress(packed)
                for p in parts:
                    content = raw[p["first"]:p["first"] + p["width"] + SPAN - 1]
                    for column, value in zip(out, (p["bucket"], p["tile"], row, p["first"], p["single"], content)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             names=["bucket", "tile", "row", "first", "single", "content"])

    joined = packed_texts(docs, text).join(wanted, "digest").select("digest", "packed", "row", "segments")
    return joined.mapInArrow(cut, "bucket long, tile int, row long, first int, single boolean, content binary")


_FOUND = "row long, first int, last int, high long, low long, n int"


def _compared(frame: pd.DataFrame) -> pd.DataFrame:
    """Ranges of windows of single segments that repeat in this group. Of an anchor that is spread
    over several groups also a hash of every distinct window, for the other groups: with its place
    where it occurs once, without where it is known to repeat."""
    frame = frame.drop_duplicates(["row", "first"])  # a retried or split copy
    contents = frame["content"].to_list()
    lengths = np.array([len(c) for c in contents], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    text = b"".join(contents)
    edge = np.zeros(len(text) + 3, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths - (SPAN - 1), -1)
    wanted = np.cumsum(edge[:len(text) + 2]) > 0
    suffixes = Suffixes(text, wanted, SPAN)
    order = suffixes.order
    run = np.cumsum(suffixes.common < SPAN) - 1  # the first has nothing before it
    owner = np.searchsorted(starts, order, side="right") - 1
    real = wanted[order]
    single = frame["single"].to_numpy()
    owner = np.minimum(owner, len(single) - 1)
    times = np.bincount(run, weights=real * np.where(single[owner], 1, 2), minlength=run[-1] + 1 if len(run) else 0)
    repeated = np.sort(order[real & single[owner] & (times[run] > 1)])
    whose = np.searchsorted(starts, repeated, side="right") - 1
    breaks = np.flatnonzero((np.diff(repeated) > 1) | (np.diff(whose) > 0)) + 1
    begin, end = np.append(0, breaks).astype(np.int64), np.append(breaks, len(repeated)) - 1
    if not len(repeated):
        begin = end = np.zeros(0, dtype=np.int64)
    rows, firsts = frame["row"].to_numpy(), frame["first"].to_numpy()

    def place(at: np.ndarray, who: np.ndarray) -> np.ndarray:
        return at - starts[who] + firsts[who]

    out = pd.DataFrame({"row": rows[whose[begin]], "first": place(repeated[begin], whose[begin]),
                        "last": place(repeated[end], whose[begin]), "high": None, "low": None, "n": None})
    if frame["tile"].iloc[0] >= 0:
        kept, at = np.unique(run[real], return_index=True)
        at, who, n = order[real][at], owner[real][at], np.minimum(times[kept], 2).astype(int)
        hashes = [xxhash.xxh3_128_intdigest(text[a:a + SPAN]) for a in at.tolist()]
        more = pd.DataFrame({"row": rows[who], "first": place(at, who), "last": place(at, who),
                             "high": [(h >> 64) - (1 << 63) for h in hashes],
                             "low": [(h & (1 << 64) - 1) - (1 << 63) for h in hashes], "n": n})
        out = pd.concat([out, more], ignore_index=True)
    return out.astype({"high": "Int64", "low": "Int64", "n": "Int32"})


def repeated_windows(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """((row, digest) of one document per distinct text, (row, first, last, kind) ranges of windows:
    kind 0 repeats, 1 does not as far as it is a whole record of kind 0, 2 repeats all the same)."""
    found = stored(records(docs, text))
    texts = found.groupBy("digest").agg(F.min("row").alias("row"))
    flat = found.select("row", F.inline(F.arrays_zip("anchor", "segment", "first", "last")))
    anchors = flat.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"))
    # stored, so that the join has plain shuffles on both sides, of which Spark divides hot anchors
    anchors = stored(anchors.where("n > 1").select("anchor", (F.col("low") < F.col("high")).alias("mixed")))
    likely = stored(flat.join(anchors, "anchor"))
    # equal segments: as many windows each, so the width is that of any; a row that is the smallest
    # for a segment is the smallest of its text too
    kinds = stored(likely.where("mixed").groupBy("anchor", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min_by("first", "row").alias("first"),
        F.min(F.col("last") - F.col("first") + 1).alias("width")))
    bytes_ = F.col("width") + SPAN - 1
    groups = max(1, -(-(kinds.agg(F.sum(bytes_)).first()[0] or 0) // GROUP_BYTES))
    spread = kinds.groupBy("anchor").agg(F.sum(bytes_).alias("bytes")).where(F.col("bytes") > GROUP_BYTES // 2)
    spread = lookup_side(spread.select("anchor", F.ceil(F.col("bytes") * 2 / GROUP_BYTES).cast("int").alias("tiles")))
    tile = F.coalesce(F.pmod(F.xxhash64("segment"), F.col("tiles")).cast("int"), F.lit(-1))
    placed = kinds.join(spread, "anchor", "left").withColumn("tile", tile).withColumn(
        "bucket", F.when(F.col("tile") < 0, F.pmod(F.xxhash64("anchor"), F.lit(groups))).otherwise(F.col("anchor")))
    wanted = placed.groupBy("row").agg(F.collect_list(F.struct(
        "first", "width", (F.col("n") == 1).alias("single"), "bucket", "tile")).alias("segments"))
    wanted = wanted.join(texts, "row").select("digest", "row", "segments")
    compared = stored(segment_texts(docs, text, wanted).groupBy("bucket", "tile").applyInPandas(_compared, _FOUND))
    apart = compared.where("n is not null")
    again = apart.groupBy("high", "low").agg(F.sum("n").alias("times")).where("times > 1")
    elsewhere = apart.where("n = 1").join(again, ["high", "low"])
    single = kinds.where("n = 1").select("row", "first", (F.col("first") + F.col("width") - 1).alias("last"))
    ranges = likely.select("row", "first", "last", F.lit(0).alias("kind")).unionByName(
        single.withColumn("kind", F.lit(1)))
    for more in (compared.where("n is null"), elsewhere):
        ranges = ranges.unionByName(more.select("row", "first", "last", F.lit(2).alias("kind")))
    return texts, ranges


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept): what is left of every document, as bytes,
    when each byte is removed that lies in SPAN bytes which also start anywhere else.

    Null text is empty; texts under SPAN bytes stay whole. Repeated rows are documents of their own,
    so each is a copy of the other and both go; so do rows without id. Matches are told by the
    input and never cross documents, but may lie in one document and overlap. `spans` are the
    maximal removed runs (start, end exclusive). An empty table gives no rows.
    """
    texts, ranges = repeated_windows(docs, text)
    listed = ranges.groupBy("row").agg(F.collect_list(F.struct("first", "last", "kind")).alias("ranges"))
    listed = listed.join(texts, "row").select("digest", "ranges")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            out = [[] for _ in range(5)]
            for packed, ranges_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = unpack.decompress(packed)
                alone = {r["first"] for r in ranges_ or [] if r["kind"] == 1}
                used = [(r["first"], r["last"] + SPAN) for r in ranges_ or []
                        if r["kind"] == 2 or r["kind"] == 0 and r["first"] not in alone]
                spans, kept, at = [], [], 0
                for begin, end in sorted(used):
                    if spans and begin <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([begin, end])
                for begin, end in spans:
                    kept.append(raw[at:begin])
                    at = end
                kept.append(raw[at:])
                row = (len(raw), sum(b - a for a, b in spans), len(spans),
                       [{"start": a, "stop": b} for a, b in spans], b"".join(kept))
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])),
                     pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    joined = packed_texts(docs, text, id_col).join(listed, "digest", "left").select("doc_id", "packed", "ranges")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                     "spans array<struct<start: int, stop: int>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same by the md5 of every window, over texts as hex, cut into pieces as a substring is looked
#: for from the start.
ORACLE = f"""
WITH sized AS (SELECT r, doc_id, hex(b) AS h, octet_length(b)::BIGINT AS n FROM (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents)),
pieces AS (SELECT r, n, p, substring(h, 1000*p + 1, 1000 + {2 * SPAN - 2}) AS part
  FROM (SELECT r, h, n, unnest(range((n - {SPAN}) // 500 + 1)) AS p FROM sized WHERE n >= {SPAN})),
windows AS (SELECT r, 500*p + k AS i, md5_number(substring(part, 2*k + 1, {2 * SPAN})) AS w FROM (
  SELECT r, p, part, unnest(range(least(500, n - {SPAN - 1} - 500*p))) AS k FROM pieces)),
hits AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY w) AS times FROM windows) WHERE times > 1),
marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {SPAN} THEN 0 ELSE 1 END AS fresh FROM hits),
runs AS (SELECT r, min(i) AS a, max(i) + {SPAN} AS z FROM (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM marked) GROUP BY r, g),
spans AS (SELECT r, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a)::BIGINT AS n_removed,
  count(*)::BIGINT AS n_spans FROM runs GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(len(a) + 1), lambda k: substring(h,
    2*(CASE WHEN k = 0 THEN 0 ELSE z[k] END) + 1,
    2*(CASE WHEN k = len(a) THEN n ELSE a[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE z[k] END))), '') END)) AS kept_sha256
FROM sized LEFT JOIN spans USING (r)"""
