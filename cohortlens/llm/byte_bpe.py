"""Byte-level BPE: ranked merges folded by Spark over words that a task meets for the first time."""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import table
from cohortlens.llm.segments import SegmentMemory, one_word, text_runs

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The splitting pattern, white space being the Unicode property.
PATTERN = regex.compile(public_tokenizers.PATTERN.replace(r"\s+(?!\S)", r"\p{White_Space}+(?!\P{White_Space})")
                        .replace(r"|\s+", r"|\p{White_Space}+").replace(r"[^\s", r"[^\p{White_Space}"))
#: Distinct words that a task numbers, and segments it remembers, before it starts afresh.
NUMBERED, SEGMENTS = 500_000, 300_000
#: A fold takes a step for every token that occurs in a word, each over the whole word; longer words
#: reach it with their merges done by `merged`, which needs n log n steps.
LONG_WORD = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of every way to make a token of two others."""
    return {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items()
            for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}


@functools.cache
def halves(path: str) -> dict[int, tuple[int, int]]:
    """The id of every token of two bytes or more -> the ids of the two that its last merge joins. Where
    the bytes of a token stand apart from all others, their merges are those of the token alone, so no
    other pair ever makes it; and as these have rising ranks, which is checked here, the merges of any
    word have. One pass over the ranks in order thus does what looking for the lowest again and again
    does. Empty if the ranks do not rise, which no training gives."""
    ranks, out = read_ranks(path), {}
    for token, rank in ranks.items():
        parts, last = [token[k:k + 1] for k in range(len(token))], -1
        while len(parts) > 1:
            best, k = min((ranks.get(a + b, 1 << 62), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 62 or best < last:
                return {}
            if len(parts) == 2:
                out[rank] = (ranks[parts[0]], ranks[parts[1]])
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            last = best
    return out


def written(ids: np.ndarray) -> str:
    """Ids as text, a character each; the characters skip the surrogates."""
    ids = ids.astype("<u4")
    return (ids + 0x800 * (ids >= 0xD800)).astype("<u4").tobytes().decode("utf-32-le")


def strings(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Ids, cut into runs of these sizes, as texts."""
    points = ids + 0x800 * (ids >= 0xD800)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.StringArray.from_buffers(
        len(sizes), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(written(ids).encode()))


def numbers(chars: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids that texts stand for, and how many each has."""
    text = b"".join(chars.cast(pa.binary()).to_pylist()).decode()
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int32)
    return points - 0x800 * (points >= 0xE000), pc.utf8_length(chars).to_numpy()


def rank_map(pairs: dict[int, tuple[int, int]]) -> tuple[Column, Column]:
    """Two literal arrays by rank: the pair that a merge joins, and the token that it makes, as text."""
    size = max(pairs, default=-1) + 1
    both = [""] * size
    for rank, pair in pairs.items():
        both[rank] = written(np.array(pair))

    def literal(values: list[str]) -> Column:
        return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<string>")

    return literal(both), literal([*written(np.arange(size))])


def fold_merges(word: Column, found: Column, ranks: tuple[Column, Column]) -> Column:
    """Ids of a word given as ids of its bytes, both as text: the merges of `found`, the ranks of the
    tokens that occur in the word, in order, each wherever its pair stands, from the left."""
    pairs, tokens = ranks
    return F.aggregate(found, word, lambda ids, rank: F.replace(ids, F.get(pairs, rank), F.get(tokens, rank)))


class TokenTree:
    """All tokens by their bytes: nodes are beginnings of tokens, edges a hash table from node and byte."""

    def __init__(self, ranks: dict[bytes, int]):
        nodes: dict[bytes, int] = {b"": 0}
        keys, rank = [], [-1]
        for token in ranks:
            for k in range(1, len(token) + 1):
                if token[:k] not in nodes:
                    nodes[token[:k]] = len(nodes)
                    keys.append(nodes[token[:k - 1]] << 8 | token[k - 1])
                    rank.append(ranks.get(token[:k], -1))
        self.rank = np.array(rank, np.int32)
        self.bits = max(1, (4 * len(keys)).bit_length())
        self.keys, self.nodes = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int32)
        key, node = np.array(keys, np.int64), np.arange(1, len(nodes), dtype=np.int32)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            placed = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[placed]], self.nodes[slot[placed]] = key[placed], node[placed]
            rest = np.ones(len(key), bool)
            rest[placed] = False
            key, node, slot = key[rest], node[rest], slot[rest] + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def follow(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next node of each, or -1."""
        key = node.astype(np.int64) << 8 | byte
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.nodes[slot], np.int32(-1))
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            slot[open_] += 1
            held = self.keys[slot[open_]]
            same = held == key[open_]
            out[open_[same]] = self.nodes[slot[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return out

    def found(self, data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, bytes `starts` to `ends` of `data`, the distinct ranks of the tokens of two
        bytes or more in it, ascending; and how many there are."""
        sizes = ends - starts
        word = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(word)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        end, node = ends[word], np.zeros(len(word), np.int32)
        pairs = []
        while len(at):
            node = self.follow(node, data[at])
            ok = node >= 0
            rank = self.rank[node]
            full = np.flatnonzero(ok & (rank >= 0))
            pairs.append(word[full] << 32 | rank[full])
            at = at + 1
            ok &= at < end
            at, end, node, word = at[ok], end[ok], node[ok], word[ok]
        key = np.concatenate([np.zeros(0, np.int64), *pairs[1:]])  # the first are single bytes
        key.sort()
        key = key[np.diff(key, prepend=-1) != 0]
        return (key & 0xFFFFFFFF).astype(np.int32), np.bincount(key >> 32, minlength=len(sizes))


def merged(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges for one long word, with a heap over linked neighbours."""
    import heapq

    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    ids, alive = list(ids), [True] * len(ids)
    heap = [(pairs[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, k, left, right = heapq.heappop(heap)
        n = after[k]
        if not alive[k] or n >= len(ids) or ids[k] != left or ids[n] != right:
            continue
        ids[k], alive[n], after[k] = rank, False, after[n]
        if after[n] < len(ids):
            before[after[n]] = k
        for a, b in ((before[k], k), (k, after[k])):
            if a >= 0 and b < len(ids) and (ids[a], ids[b]) in pairs:
                heapq.heappush(heap, (pairs[ids[a], ids[b]], a, ids[a], ids[b]))
    return [i for i, ok in zip(ids, alive) if ok]


STREAM = "doc_id long, words array<int>, number int, chars string, found array<int>"
#: Documents whose ids are put together at a time, and the most numbers of words in it; the most bytes
#: of texts that are numbered at a time, and the most new words made into rows at a time.
UNFOLD_DOCS, UNFOLD_WORDS, NUMBER_BYTES, NEW_WORDS = 512, 1 << 19, 1 << 21, 1 << 17


@functools.cache
def token_tree(path: str) -> TokenTree:
    return TokenTree(read_ranks(path))


def stream(docs: DataFrame, path: str, id_col: str, text: str) -> DataFrame:
    """A row per document, its words as numbers, and before it a row for every word that is new in the
    task: its number, its ids of bytes as text and the ranks of the tokens that occur in it. Number 0
    says that all words before it are void. Rows are small, and nothing is shuffled."""
    longest = LONG_WORD if halves(path) else 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, tree = read_ranks(path), token_tree(path)
        single = np.array([ranks[bytes([b])] for b in range(256)])
        pairs: dict = {}
        words: dict[str, int] = {}
        new: list[str] = []

        def numbered(found: list[str]) -> list[int]:
            out = []
            for w in found:
                if (k := words.get(w)) is None:
                    k = words[w] = len(words)
                    new.append(w)
                out.append(k)
            return out

        def number(segments: list[str]) -> list[list[int]]:
            return [numbered([s] if one_word(s) else PATTERN.findall(s)) for s in segments]

        def number_words(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
            return np.ones(len(segments), np.int64), np.array(numbered(segments), np.uint32)

        def fresh(new: list[str], first: int) -> pa.RecordBatch:
            """Rows of new words, the numbers of which begin with `first`."""
            n = len(new)
            _, bounds, data = pa.array(new, pa.large_string()).buffers()
            bounds, data = np.frombuffer(bounds, np.int64)[:n + 1], np.frombuffer(data, np.uint8)
            sizes, ids = np.diff(bounds), single[data[:bounds[-1]]]
            long = np.flatnonzero(sizes > longest).tolist()
            if long:
                pairs.update({} if pairs else pair_ranks(ranks))
                pieces, low = [], 0
                for k in long:
                    whole = ranks.get(new[k].encode())
                    own = merged(ids[bounds[k]:bounds[k + 1]].tolist(), pairs) if whole is None else [whole]
                    pieces += [ids[low:bounds[k]], own]
                    low, sizes[k] = bounds[k + 1], len(pieces[-1])
                ids = np.concatenate([*pieces, ids[low:]]).astype(np.int64)
            ends = bounds[1:].copy()
            ends[long] = bounds[:-1][long]
            found, counts = tree.found(data, ends, bounds[:-1])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(found))
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())),
                 pa.array(np.arange(first, first + n), pa.int32()), strings(ids, sizes), lists], names=names)

        memory = SegmentMemory(number, number_words)
        names = ["doc_id", "words", "number", "chars", "found"]
        for own in text_runs(batches, min(NUMBER_BYTES, 4 * UNFOLD_WORDS)):
            lists = memory.encode(own.column(1))
            for low in range(0, len(new), NEW_WORDS):
                yield fresh(new[low:low + NEW_WORDS], len(words) - len(new) + low)
            new.clear()
            n, bounds = own.num_rows, np.concatenate([[0], np.cumsum([*map(len, lists)])])
            lists = pa.ListArray.from_arrays(
                pa.array(bounds, pa.int32()), pa.array(np.concatenate(lists).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [own.column(0), lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()),
                 pa.nulls(n, pa.list_(pa.int32()))], names=names)
            full = len(words) > NUMBERED
            if full:
                words.clear()
            if full or len(memory.number) > SEGMENTS:
                memory.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, STREAM)


def gathered(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `pool` at these places, one after the other, and where each starts and the last ends."""
    n = sizes[at].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    return pool[np.arange(ends[-1]) + np.repeat(begins[at] - ends[:-1], n)], ends


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of `values` cut at `bounds`."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in one array, and by id where a token begins and how long it is."""
    cells = [b""] * (max((ranks := read_ranks(path)).values()) + 1)
    for token, rank in ranks.items():
        cells[rank] = token
    sizes = np.array([*map(len, cells)])
    return np.frombuffer(b"".join(cells), np.uint8), np.cumsum(sizes) - sizes, sizes


def encode(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text: str = "text",
           with_bytes: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every row: the ids of the whole text; empty for null. Copies are
    encoded like any text; a word is folded when a task first meets it. `with_bytes` adds the ids as
    little-endian numbers of four bytes (`raw`) and the bytes that the ids stand for (`decoded`)."""
    # a projection keeps the order of the rows of a task
    folded = stream(docs, path, id_col, text).select(
        "doc_id", "words", "number", fold_merges(F.col("chars"), F.col("found"), rank_map(halves(path))).alias("chars"))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path) if with_bytes else None
        pool = np.zeros(1 << 16, np.int32)
        begins, sizes = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        known = 0

        def learn(chars: pa.Array, first: int) -> None:
            nonlocal pool, begins, sizes, known
            values, n = numbers(chars)
            used = int(begins[first - 1] + sizes[first - 1]) if first else 0
            known = first + len(n)
            while used + len(values) > len(pool):
                pool = np.concatenate([pool, np.zeros_like(pool)])
            while known > len(sizes):
                begins, sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (begins, sizes))
            pool[used:used + len(values)] = values
            sizes[first:known] = n
            begins[first:known] = used + np.cumsum(n) - n

        def together(own: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
            edges = lists.offsets.to_numpy().astype(np.int64)
            at = lists.flatten().to_numpy()
            values, ends = gathered(pool, begins, sizes, at)
            bounds = ends[edges - edges[0]]
            columns = [own, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))]
            if tokens:
                decoded, ends = gathered(*tokens, values)
                columns += [binaries(values.astype("<u4"), 4 * bounds), binaries(decoded, ends[bounds])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            own, lists, number, chars = batch.columns
            word = number.is_valid().to_numpy(zero_copy_only=False)
            # runs of words or documents; a run of words also ends where numbering starts afresh
            cuts = (np.flatnonzero(np.diff(word)) + 1).tolist()
            cuts += np.flatnonzero(number.fill_null(-1).to_numpy() == 0).tolist()
            edges = sorted({0, batch.num_rows, *cuts})
            for low, high in zip(edges, edges[1:]):
                if word[low]:
                    learn(chars.slice(low, high - low), number[low].as_py())
                    continue
                total = lists.offsets.to_numpy()
                while low < high:
                    stop = int(np.searchsorted(total, total[low] + UNFOLD_WORDS, side="right")) - 1
                    stop = max(low + 1, min(stop, high, low + UNFOLD_DOCS))
                    yield together(own.slice(low, stop - low), lists.slice(low, stop - low))
                    low = stop

    names = ["doc_id", "ids"] + ["raw", "decoded"] * with_bytes
    return folded.mapInArrow(unfold, "doc_id long, ids array<int>" + ", raw binary, decoded binary" * with_bytes)


def id_table(ranks: dict[bytes, int], shown) -> Column:
    """Literal array by id of a string for every token."""
    cells = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        cells[rank] = shown(token, rank)
    return F.split(F.lit(",".join(cells)), ",")


def joined_bytes(ids: Column, cells: Column) -> Column:
    """Binary pieces of all ids in one: hex text joins in one pass, where concatenating binaries one
    by one would copy a long document again and again."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(cells, i)), ""))


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    """Bytes that the ids stand for."""
    return joined_bytes(ids, id_table(read_ranks(path), lambda token, _: token.hex()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("raw", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
