"""Ranked lexical search: the ten best documents of every item, by best positions in impact lists."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import slices, stored, table

TOP = 10
#: Bytes of item text that are searched for in one pass over the documents; postings of a block of
#: documents that is searched at a time, and documents in it at most.
ITEM_BYTES, BLOCK_POSTINGS, BLOCK_DOCS = 4_000_000, 2_000_000, 32_768
#: Rows of every list that a round of sorted accesses reads; later rounds read twice as many.
FIRST_ROUND = 16

# Terms are runs of ASCII letters and digits and of bytes of other characters; A-Z are lower-cased.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class Item:
    """An item's terms by number, with their weights times repeats."""

    item_id: int | None
    terms: np.ndarray
    weights: np.ndarray


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text: str) -> DataFrame:
    """(doc_id, n, term, tf): number of terms of every document, and of those in the vocabulary
    their numbers and occurrences."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, numbers, times = [], [], []
            for raw in batch.column(1).to_pylist():
                found = terms(raw)
                own = Counter(filter(vocabulary.__contains__, found))
                sizes.append(len(found))
                numbers.append([vocabulary[t] for t in own])
                times.append(list(own.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(numbers, pa.list_(pa.int32())),
                 pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "term", "tf"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")
                       ).mapInArrow(count, "doc_id long, n long, term array<int>, tf array<long>")


class ImpactLists:
    """Lists of a block of documents: for every term its documents, greatest impact first, and where
    each document stands in that order. An impact is that of a weight of 1."""

    def __init__(self, block: list[pa.RecordBatch], documents: int, length: int):
        columns = [pa.chunked_array([b.column(k) for b in block]).combine_chunks() for k in range(4)]
        self.n = columns[1].to_numpy(zero_copy_only=False)
        # null ids come last among equal scores
        self.ids = columns[0]
        self.key = columns[0].fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(self.n)), np.diff(columns[2].offsets.to_numpy()))
        term, tf = columns[2].flatten().to_numpy(), columns[3].flatten().to_numpy()
        m = 25 + 75 * self.n * documents // max(length, 1)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        order = np.lexsort((-impact, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.known, start = np.unique(term, return_index=True)
        self.bounds = np.append(start, len(term))
        # by document within each term: where the posting stands in the impact order
        self.place = np.lexsort((self.doc, term))
        self.sorted_doc = self.doc[self.place]

    def span(self, term: int) -> tuple[int, int]:
        k = np.searchsorted(self.known, term)
        if k == len(self.known) or self.known[k] != term:
            return 0, 0
        return self.bounds[k], self.bounds[k + 1]


def best_documents(lists: ImpactLists, item: Item, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of at least the `top` best of the block, as far as their scores reach
    `floor`.

    All lists are read from the top in step. A document met for the first time is looked up in all
    other lists, and its position there counts as seen as well. The best position of a list is the
    end of its unbroken run of seen positions; no document unseen so far can have more than the
    impacts just behind the best positions. The search ends once their sum lies strictly below the
    kth score, so documents with equal scores are all met.
    """
    spans = [(*lists.span(t), w) for t, w in zip(item.terms, item.weights) if w > 0]
    spans = [s for s in spans if s[0] < s[1]]
    empty = np.zeros(0, dtype=np.int64)
    if not spans:
        return empty, empty
    seen = [np.zeros(stop - start, dtype=bool) for start, stop, _ in spans]
    best = [0] * len(spans)
    met = np.zeros(len(lists.n), dtype=bool)
    docs, scores, kth = [], empty, floor
    depth, step = 0, FIRST_ROUND
    while True:
        new = np.unique(np.concatenate(
            [lists.doc[min(start + depth, stop):min(start + depth + step, stop)] for start, stop, _ in spans]))
        new = new[~met[new]]
        met[new] = True
        total = np.zeros(len(new), dtype=np.int64)
        limit = 0
        for k, (start, stop, weight) in enumerate(spans):
            own = lists.sorted_doc[start:stop]
            at = np.minimum(np.searchsorted(own, new), len(own) - 1)
            there = own[at] == new
            place = lists.place[start:stop][at[there]]
            total[there] += weight * lists.impact[place]
            seen[k][place - start] = True
            rest = seen[k][best[k]:]
            gap = int(rest.argmin()) if len(rest) else 0
            best[k] += gap if len(rest) and not rest[gap] else len(rest)
            if best[k] < len(seen[k]):
                limit += weight * int(lists.impact[start + best[k]])
        docs.append(new)
        scores = np.concatenate([scores, total])
        if len(scores) >= top:
            kth = max(floor, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
        depth, step = depth + step, 2 * step
        if limit < kth or limit == 0:
            break
    found = np.concatenate(docs)
    good = (scores >= kth) & (scores > 0)
    return found[good], scores[good]


def searched(postings: DataFrame, items: list[Item], documents: int, length: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best of every task for every item. A task goes through its
    documents in blocks; the kth score so far bounds the search of the blocks behind."""
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3 for _ in items]

        def search(block: list[pa.RecordBatch]) -> None:
            lists = ImpactLists(block, documents, length)
            known = ~np.asarray(lists.ids.is_null())
            for k, item in enumerate(items):
                floor = int(held[k][1][-1]) if len(held[k][1]) >= top else 0
                docs, scores = best_documents(lists, item, top, floor)
                key, score, real = (np.concatenate(pair) for pair in zip(
                    held[k], (lists.key[docs], scores, known[docs].astype(np.int64))))
                order = np.lexsort((key, 1 - real, -score))[:top]
                held[k] = key[order], score[order], real[order]

        block, size, rows = [], 0, 0
        for batch in slices(batches, 4096):
            block.append(batch)
            size, rows = size + len(batch.column(2).flatten()), rows + batch.num_rows
            if size >= BLOCK_POSTINGS or rows >= BLOCK_DOCS:
                search(block)
                block, size, rows = [], 0, 0
        if block:
            search(block)
        lengths = [len(h[0]) for h in held]
        if sum(lengths):
            key, score, real = (np.concatenate(c) for c in zip(*held))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(items)), lengths)), pa.array(key, mask=real == 0), pa.array(score)],
                names=["item", "doc_id", "score"])

    return postings.select("doc_id", "n", "term", "tf").mapInArrow(best, "item long, doc_id long, score long")


def _searched_batch(docs: DataFrame, batch: list, id_col: str, text: str, top: int) -> DataFrame:
    """Ranks of one batch of items, given as (item_id, text bytes) rows."""
    spark = docs.sparkSession
    wanted = [Counter(terms(row["text"])) for row in batch]
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*wanted)))}
    postings = stored(counted(docs, vocabulary, id_col, text))
    totals = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = totals["documents"], totals["length"] or 0
    # one row per term of the vocabulary, which is as large as the batch
    df = {r["term"]: r["df"] for r in postings.select(F.explode("term").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df")).collect()}
    weight = {k: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for k, n in df.items()}
    items = []
    for row, own in zip(batch, wanted):
        known = [(vocabulary[t], times) for t, times in own.items() if vocabulary[t] in df]
        items.append(Item(row["item_id"], np.array([k for k, _ in known], dtype=np.int64),
                          np.array([times * weight[k] for k, times in known], dtype=np.int64)))
    found = searched(postings, items, documents, length, top)
    # tasks first, in shares, then all: no window meets the rows of all tasks for an item
    found = found.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(64)))
    for keys in (["item", "share"], ["item"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i.item_id) for k, i in enumerate(items)], "item long, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for every item its `top` best documents with a score above 0.

    Repeated rows are documents and items of their own: a repeated item has its ranks repeated.
    Null text has no terms: such documents are not found and such items find none. Among equal
    scores documents without id come last. An empty table on either side gives no rows. Items are
    searched in batches of about ITEM_BYTES of text, each in one pass over the documents.
    """
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16).alias("bytes")).first()["bytes"] or 0
    batches = -(-size // ITEM_BYTES) or 1
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(batches))
    out = None
    for k in range(batches):
        found = _searched_batch(docs, rows.where(share == k).collect(), id_col, text, top)
        out = found if out is None else out.unionByName(found)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{_TERM}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM size),
asked AS (SELECT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{_TERM}')) AS term FROM benchmark),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))) AS part
  FROM tf JOIN weight USING (term) JOIN size USING (doc_id), whole),
scored AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY ALL),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
  doc_id, score FROM scored WHERE score > 0)
SELECT * FROM placed WHERE rank <= {TOP}"""
