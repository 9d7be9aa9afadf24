"""Packing of token sequences: first-fit decreasing by a tournament tree, in randomised groups."""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cohortlens.llm.common import table
from cohortlens.llm.segments import SegmentMemory, one_word, text_runs  # noqa: F401

LENGTH, END = 1024, 0
#: Text bytes whose pieces are packed together, on average.
GROUP_BYTES = 6_000_000
#: Segments remembered where ids are written, beside the other work of a pipeline.
REMEMBERED_BESIDE = 400_000
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long"
_memories: dict[str, SegmentMemory] = {}


#: Words that are encoded as one text, and bytes of texts whose parts are looked up together.
TOGETHER, TEXT_RUN = 1000, 1 << 20


def memory(path: str) -> SegmentMemory:
    """The tokenizer file behind a memory that lasts as long as the worker. Single words are encoded
    many at a time, in one text: the splitting pattern parts before every space, and of the ids of a
    word behind one only the first stands for bytes that begin with it."""
    if path not in _memories:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        first = np.zeros(max(tokenizer.get_vocab().values()) + 1, dtype=bool)
        first[[i for token, i in tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True

        def encoded(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        line = tokenizer.token_to_id("\u010a")

        def together(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """The sizes and the ids of words that are all behind a space; others get a line end, whose
            id is dropped."""
            lead = "" if words[0][0] == " " else "\n"
            flat = [np.array(ids, np.uint32) for ids in
                    encoded([lead + lead.join(words[k:k + TOGETHER]) for k in range(0, len(words), TOGETHER)])]
            flat = np.concatenate(flat)
            starts = np.flatnonzero(flat == line if lead else first[flat])
            return np.diff(starts, append=len(flat)) - len(lead), flat[flat != line] if lead else flat

        _memories[path] = SegmentMemory(encoded, together)
    return _memories[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_ids: bool = False,
           path: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """Every document's ids and the end id, cut at multiples of `length`: one row per piece.

    Null text is empty: one piece, the end id. `with_ids` adds the ids themselves. `copy` tells equal
    rows apart, by the task and the number of equal pieces before in it, whatever their order.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"] + ["ids"] * with_ids
        task = TaskContext.get().partitionId() << 32
        before: Counter[tuple] = Counter()
        for batch in text_runs(batches, TEXT_RUN):
            rows: list[list] = [[] for _ in names]
            if with_ids and len(memory(path).number) > REMEMBERED_BESIDE:
                memory(path).forget()
            for doc, ids in zip(batch.column(0).to_pylist(), memory(path).encode(batch.column(1))):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), length):
                    own = ids[start:start + length]
                    piece = (doc, start, zlib.crc32(own.tobytes()))
                    row = [doc, start, len(own), piece[2], len(ids), task + before[piece]]
                    before[piece] += 1
                    for column, value in zip(rows, row + [own] * with_ids):
                        column.append(value)
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(rows, kinds)], names=names)
        if with_ids:  # in a pipeline the worker goes on with other work and needs the room
            memory(path).forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")
                       ).mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item. A tournament tree over the bins holds the largest room in each
    subtree; the leftmost bin with enough room is found on one way down."""
    order = np.argsort(-lengths, kind="stable")
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for item, size in zip(order.tolist(), lengths[order].tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        where[item], offset[item] = node - leaves, capacity - room[node]
        room[node] -= size
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return where, offset


def pack(parts: DataFrame, groups: int, capacity: int = LENGTH, seed: int = 11) -> DataFrame:
    """The columns of `pieces` but `copy`, with sequence_id and offset. Each piece falls into one of
    `groups` groups by a hash of its document, start and copy, so copies, repeated rows, rows without
    id and hot sources spread evenly; a group is packed alone and numbers its sequences from its own
    range. Other columns of `parts` are left out. Repeated rows stay and are packed like others."""
    fields = [f for f in parts.schema.fields if f.name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")]
    names = [f.name for f in fields]

    def fill(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        group = group.take(pc.sort_indices(group, [(k, "ascending") for k in ("doc_id", "start", "copy")]))
        where, offset = first_fit_decreasing(group["length"].to_numpy(), capacity)
        sequence = group["_group"].to_numpy().astype(np.int64) * (1 << 32) + where
        return group.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy", F.lit(seed)), F.lit(groups))
    return parts.select(*names, "copy", group.cast("int").alias("_group")).groupBy("_group").applyInArrow(fill, schema)


def group_count(docs: DataFrame, text: str = "text") -> int:
    """Groups grow with the text, so that a group stays as large as it is now at any scale."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return max(1, ((size.b or 0) + 512 * size.n) // GROUP_BYTES)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack `docs`; an empty table gives no rows."""
    return pack(pieces(docs, id_col, text, with_ids), group_count(docs, text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
