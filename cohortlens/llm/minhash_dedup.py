"""Near-duplicate documents: bottom-k sketches, inverted lists of band keys, exact Jaccard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import components, slices, stored, table
from cohortlens.session import lookup_side

#: Retained values, and the chance that a pair at the threshold misses the filter on them.
SKETCH, MISS = 64, 1e-6
#: Minima that make up the key of a band, and the chance that a pair at the threshold shares no key.
ROWS, APART = 4, 1e-7
#: Members of a list that are compared with all others in each round, by numbers that give every
#: round other ones (xor, minimum, xor).
HUBS = 3
TURNS = (0, 0x5DEECE66D1234567, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x38495AB5A0761D64,
         0x6C62272E07BB0142, 0x27D4EB2F165667C5, 0x165667B19E3779F9, 0x4F1BBCDCBFA53E0B)
TILE, COLUMNS = 256, 4096
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Shingles multiplied out, and bytes of text parted, at a time.
SPREAD, PORTION = 512, 1 << 22
#: Masks of so many bytes; bytes from which on a word is hashed by itself.
BYTES, LONG = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64), 64


@dataclass(frozen=True)
class Likeness:
    """Sets of `width` consecutive words are linked from percent / 100 Jaccard similarity on."""

    width: int = 5
    percent: int = 80

    def least_overlap(self, n: int) -> int:
        """Values that the sketches of a set of `n` shingles and of one linked with it share at
        least: exact while both sets lie in their sketches, else up to the chance MISS."""
        exact = -(-n * self.percent // 100)
        return exact if n * 100 <= SKETCH * self.percent else min(exact, self.sketch_overlap())

    def least_overlap(self, n: int) -> int:
        """Values that the sketches of a set of `n` shingles and of one linked with it share at
        least: exact while both sets lie in their sketches, else up to the chance MISS."""
        exact = -(-n * self.percent // 100)
        return exact if n * 100 <= SKETCH * self.percent else min(exact, self.sketch_overlap())

    def sketch_overlap(self) -> int:
        p, below = self.percent / 100, 0.0
        for c in range(SKETCH + 1):
            below += math.comb(SKETCH, c) * p ** c * (1 - p) ** (SKETCH - c)
            if below > MISS:
                return c
        return SKETCH

    def bands(self) -> int:
        """Keys of a set: two linked sets share none of them with the chance APART at most."""
        return math.ceil(math.log(APART) / math.log1p(-((self.percent / 100) ** ROWS))) if self.percent < 100 else 1


def words_of(text: str) -> list[bytes]:
    """Words after lower-casing A-Z; bytes.split parts at exactly blank and the controls 9 to 13."""
    return text.encode("utf-8", "replace").lower().split()


def shingle_set(text: str, width: int) -> frozenset:
    """The distinct runs of `width` words; of fewer words the whole sequence; without words none."""
    words = words_of(text)
    if len(words) <= width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[k:] for k in range(width))))


def word_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time for all words that have as many."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    _, ends, data = words.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    start, n = at[:-1], np.diff(at)
    cells = np.zeros(int(at[-1]) // 8 + 2, dtype="<u8")
    cells.view(np.uint8)[:at[-1]] = np.frombuffer(data or b"", dtype=np.uint8)[:at[-1]]
    out = n.astype(np.uint64) * MIX[1]
    for k in range(0, LONG, 8):
        live = np.flatnonzero(n > k)
        if not len(live):
            break
        first = start[live] + k
        cell, shift = first >> 3, ((first & 7) << 3).astype(np.uint64)
        lane = (cells[cell] >> shift) | ((cells[cell + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        mixed = (out[live] ^ (lane & BYTES[np.minimum(n[live] - k, 8)])) * MIX[0]
        out[live] = mixed ^ (mixed >> np.uint64(29))
    for k in np.flatnonzero(n > LONG):
        out[k] = xxhash.xxh64_intdigest(memoryview(data)[start[k]:at[k + 1]])
    return out


def parted(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """The words of all texts, parted by Arrow at the same characters as by `words_of`; which of them
    are real (there are empty ones beside blanks at the ends of a text); the bounds of the texts among
    the real ones."""
    whole = texts.cast(pa.large_string()).fill_null("").take(pa.array(np.arange(len(texts))))  # Arrow misreads slices
    lists = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy() > 0
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return words, real, np.concatenate([[0], np.cumsum(real)])[bounds]


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def shingle_hashes(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For every text the sorted distinct 64-bit hashes of its shingles."""
    words, real, bounds = parted(texts)
    hashes = word_hashes(words)[real]

    def mixed(h: np.ndarray, span: int) -> np.ndarray:
        total = np.full(max(0, len(h) - span + 1), np.uint64(span))
        for k in range(span):
            total = (total ^ h[k:len(h) - span + 1 + k]) * MIX[0]
            total ^= total >> np.uint64(29)
        total = total * MIX[1]
        return (total ^ (total >> np.uint64(32))).view(np.int64)

    runs = mixed(hashes, width)
    return [distinct(runs[start:end - width + 1] if end - start >= width else
                     mixed(hashes[start:end], end - start) if end > start else runs[:0])
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def shingle_codes(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For every text its shingles as sorted distinct numbers, equal where the words are."""
    words, real, bounds = parted(texts)
    coded = pc.dictionary_encode(words)
    codes, known = coded.indices.to_numpy()[real].astype(np.int64), len(coded.dictionary)
    runs, most = codes, known
    for k in range(1, width):
        if most * known >= 1 << 62:
            seen, runs = np.unique(runs, return_inverse=True)
            most = len(seen)
        runs, most = runs[:max(0, len(codes) - k)] * known + codes[k:], most * known
    short: dict = {}

    def of(start: int, end: int) -> np.ndarray:
        if end - start >= width or start == end:
            return distinct(runs[start:max(start, end - width + 1)])
        return np.array([-1 - short.setdefault(tuple(codes[start:end].tolist()), len(short))], dtype=np.int64)

    return [of(start, end) for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def band_factors(like: Likeness) -> np.ndarray:
    """Odd numbers; multiplying by each is a permutation of the hashes."""
    drawn = hashlib.shake_256(b"bands").digest(4 * ROWS * like.bands())
    return np.frombuffer(drawn, dtype="<u4") | np.uint32(1)


def band_keys(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A key for each band, of the smallest values of the shingles under ROWS permutations each."""
    values = (shingles.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(factors), np.uint32(0xFFFFFFFF))
    for start in range(0, len(values), SPREAD):
        np.minimum(low, (factors[:, None] * values[None, start:start + SPREAD]).min(axis=1), out=low)
    keys = np.full(len(factors) // ROWS, MIX[1])
    for own in low.reshape(-1, ROWS).T.astype(np.uint64):
        keys = (keys ^ own) * MIX[0]
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def portions(batches: Iterable[pa.RecordBatch], *texts: str) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have PORTION bytes at most, or of one row."""
    for batch in slices(batches):
        size = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(c))), 0)
                             .to_numpy().astype(np.int64) for c in texts))
        start = done = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(size, done + PORTION, side="right")))
            yield batch.slice(start, end - start)
            start, done = end, int(size[end - 1])


def sketches(docs: DataFrame, like: Likeness, id_col: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, digest of the whole set, sketch) of every row; a sketch has the upper
    halves of the SKETCH smallest hashes and the keys of the bands."""
    factors, bands = band_factors(like), like.bands()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            sets = shingle_hashes(batch.column(1), like.width)
            low = [(s[:SKETCH] >> 32).astype(np.int32) for s in sets]
            keys = np.concatenate([band_keys(s, factors) for s in sets if len(s)] + [np.zeros(0, dtype=np.int64)])
            ends = np.cumsum([0] + [bands * (len(s) > 0) for s in sets], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()),
                pa.StructArray.from_arrays([
                    pa.ListArray.from_arrays(np.cumsum([0] + [len(v) for v in low], dtype=np.int32),
                                             np.concatenate(low) if low else np.zeros(0, dtype=np.int32)),
                    pa.ListArray.from_arrays(ends, keys)], names=["low", "keys"]),
            ], names=["doc_id", "n_shingles", "digest", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        sketch, "doc_id long, n_shingles long, digest binary, sketch struct<low:array<int>,keys:array<long>>")


def inverted_lists(sets: DataFrame, like: Likeness) -> DataFrame:
    """(value, band, rep): the lists of band keys through which linked sets meet.

    A band's key comes from the smallest values under ROWS permutations of the hashes, so two sets
    share it with the chance of their similarity to the power of ROWS: nearly all linked sets share
    one of the keys (see `Likeness.bands`), while a passage or word pair of very many documents
    brings no two of them together that have little else in common.
    """
    return sets.select("rep", F.posexplode("sketch.keys").alias("band", "value")).select("value", "band", "rep")


def with_hubs(lists: DataFrame, turns: tuple[int, ...]) -> DataFrame:
    """Lists of two members or more with their size and hubs."""
    lows = [F.min(F.col("rep").bitwiseXOR(F.lit(t))).bitwiseXOR(F.lit(t)) for t in turns]
    hubs = lists.groupBy("value", "band").agg(
        F.count(F.lit(1)).alias("size"), F.array_distinct(F.array(*lows)).alias("hubs"))
    return lists.join(hubs.where("size > 1"), ["value", "band"])


def hub_pairs(lists: DataFrame) -> DataFrame:
    return lists.select("rep", F.explode("hubs").alias("hub")).where("rep <> hub").select(
        F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def estimated(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Pairs whose union sketch (the SKETCH smallest values of both) does not rule the link out. The
    upper halves of the values are sent; they keep the order, and the bounds leave room for two
    that coincide."""
    side = sets.select("rep", "n", F.col("sketch.low").alias("sketch"))
    joined = pairs.join(side.toDF("a", "n_a", "s_a"), "a").join(side.toDF("b", "n_b", "s_b"), "b")
    least = like.sketch_overlap()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            cols = batch.to_pydict()
            ok = []
            for n_a, n_b, s_a, s_b in zip(cols["n_a"], cols["n_b"], cols["s_a"], cols["s_b"]):
                small, large = min(n_a, n_b), max(n_a, n_b)
                if small * 100 < large * like.percent:
                    ok.append(False)
                    continue
                both = set(s_a).intersection(s_b)
                union = sorted(set(s_a).union(s_b))
                if n_a + n_b - len(both) <= SKETCH and large <= SKETCH:
                    ok.append((len(both) + 1) * 100 >= like.percent * len(union))
                else:
                    last = union[:SKETCH][-1]
                    ok.append(sum(v <= last for v in both) >= min(least, len(union)) - 1)
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)).filter(mask) for c in "ab"], names=["a", "b"])

    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(keep, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Pairs linked by the exact Jaccard similarity of their full sets of words."""
    joined = pairs.join(texts.toDF("a", "t_a"), "a").join(texts.toDF("b", "t_b"), "b")
    bound = Fraction(like.percent, 100)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "t_a", "t_b"):
            a, b, t_a, t_b = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "t_a", "t_b"))
            coded = pc.dictionary_encode(pa.chunked_array([t_a, t_b]).cast(pa.large_string()).combine_chunks())
            sets = shingle_codes(coded.dictionary, like.width)
            ok = []
            for one, other in coded.indices.to_numpy().reshape(2, -1).T.tolist():
                both = np.sort(np.concatenate([sets[one], sets[other]]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                union = len(both) - common
                ok.append(union > 0 and common * bound.denominator >= union * bound.numerator)
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return joined.select("a", "b", "t_a", "t_b").mapInArrow(keep, "a long, b long").distinct()


def unresolved(lists: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Members, with the label of their component, of the lists that hold several components and
    more members than hubs have reached."""
    lists = lists.where(F.col("size") > F.size("hubs") + 1).select("value", "band", "rep")
    labels = parts.toDF("rep", "label")
    named = lists.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = named.groupBy("value", "band").agg(
        F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return named.join(mixed.select("value", "band"), ["value", "band"], "left_semi")


def across(lists: DataFrame, texts: DataFrame, parts: DataFrame, like: Likeness) -> DataFrame:
    """Links between different components within the unresolved lists: one for each two components
    and tile, which connects as much as all of them.

    Members outside a list's largest component meet that component, and the others outside it, once
    for all lists; where no two members of a list are connected they meet within the list. All are
    dealt out as tiles of bounded size; a task compares the full sets of its tile, so no row stands
    for a pair that is not linked.
    """
    by_label = lists.groupBy("value", "band", "label").agg(F.count(F.lit(1)).alias("n"))
    # the largest component of a list; n and label are read back out of the one number
    top = by_label.groupBy("value", "band").agg(F.max(F.struct("n", "label")).alias("m")).select(
        "value", "band", F.col("m.n").alias("most"), F.col("m.label").alias("main"))
    named = lists.join(top, ["value", "band"])
    grown = F.col("most") > 1
    odd = stored(named.where(~grown | (F.col("label") != F.col("main"))).select(
        "value", "band", "rep", "label", F.when(grown, F.col("main")).alias("main")))

    # 1. odd members against every member of the main component, in rectangles of chunks
    probes = stored(odd.where("main is not null").select("main", "rep", "label").distinct())
    down = probes.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / (4 * TILE)).cast("int").alias("down"))
    members = parts.toDF("rep", "main").join(down, "main")
    wide = members.groupBy("main", "down").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("wide"))

    def chunk(number: str):
        return F.pmod(F.xxhash64("rep"), number).cast("int")

    def all_of(number: str):
        return F.explode(F.sequence(F.lit(0), F.col(number) - 1))

    base = members.drop("down").join(wide, "main").select(
        "main", chunk("wide").alias("i"), all_of("down").alias("j"), "rep",
        F.col("main").alias("label"), F.lit(0).alias("side"))
    probe = probes.join(wide, "main").select(
        "main", all_of("wide").alias("i"), chunk("down").alias("j"), "rep", "label", F.lit(1).alias("side"))
    first = base.unionByName(probe).select(
        F.lit(0).alias("kind"), F.col("main").alias("key"), F.lit(0).alias("band"), "i", "j", "side",
        "rep", "label")

    # 2. odd members around one component, or of a list without any, against each other, in squares of
    # chunks
    around = probes.select(
        F.lit(1).alias("kind"), F.col("main").alias("key"), F.lit(0).alias("band"), "rep", "label")
    loose = odd.where("main is null").select(
        F.lit(2).alias("kind"), F.col("value").alias("key"), "band", "rep", "label")
    odd = around.unionByName(loose)
    counts = odd.groupBy("kind", "key", "band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn(
        "tiles", F.ceil(F.col("size") / TILE).cast("int"))
    dealt = odd.join(counts, ["kind", "key", "band"]).withColumn("c", chunk("tiles")).withColumn(
        "other", all_of("tiles"))
    second = dealt.select(
        "kind", "key", "band", F.least("c", "other").alias("i"),
        F.greatest("c", "other").alias("j"),
        F.when(F.col("c") == F.col("other"), 2).when(F.col("c") < F.col("other"), 0).otherwise(1).alias("side"),
        "rep", "label")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        texts = pa.array(frame["text"], pa.large_string())
        sets = [s for part in portions([pa.record_batch([texts], ["text"])], "text")
                for s in shingle_hashes(part.column(0), like.width)]
        n = np.array([len(s) for s in sets])
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), n)
        rows, at = rows[times[at] > 1], at[times[at] > 1]  # a value of one set alone is shared by none
        side, rep, label = (frame[c].to_numpy() for c in ("side", "rep", "label"))
        # as much of a linked set as the threshold asks for lies in others
        able = np.bincount(rows, minlength=len(sets)) * 100 >= n * like.percent
        probes, bases = np.flatnonzero(able & (side != 0)), np.flatnonzero(able & (side != 1))
        used = able[rows]
        kept, at = np.unique(at[used], return_inverse=True)
        rows = rows[used]
        shared = np.zeros((len(probes), len(bases)), dtype=np.float32)
        for start in range(0, len(kept) if len(probes) and len(bases) else 0, COLUMNS):
            own = (at >= start) & (at < start + COLUMNS)
            mark = np.zeros((len(sets), COLUMNS), dtype=np.float32)
            mark[rows[own], at[own] - start] = 1
            shared += mark[probes] @ mark[bases].T
        union = n[probes][:, None] + n[bases][None] - shared
        p, b = np.nonzero((shared * 100 >= union * like.percent) & (union > 0)
                          & (label[probes][:, None] != label[bases][None]))
        p, b = probes[p], bases[b]
        met = np.sort(np.stack([label[p], label[b]], axis=1), axis=1)
        _, first_of = np.unique(met, axis=0, return_index=True)
        pairs = np.sort(np.stack([rep[p[first_of]], rep[b[first_of]]], axis=1), axis=1)
        return pd.DataFrame(pairs, columns=["a", "b"])

    return first.unionByName(second).join(texts.toDF("rep", "text"), "rep").groupBy(
        "kind", "key", "band", "i", "j").applyInPandas(compare, "a long, b long").where("a <> b").distinct()


def links(docs: DataFrame, sketched: DataFrame, like: Likeness, id_col: str, text: str) -> DataFrame:
    """(a, b) links between the smallest ids of different sets; enough of them to connect all that
    the full set of links connects.

    Rounds compare the members of each list with a few hubs, and only members that are not yet
    connected with all others of a list go on; when rounds stop helping, what is left is compared
    in full.
    """
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    sets = stored(usable.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
    ).drop("digest"))
    plain = inverted_lists(sets, like)
    lists = stored(with_hubs(plain, TURNS[:HUBS]))
    met = stored(sets.join(lists.select("rep").distinct(), "rep", "left_semi"))
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null")

    def texts_of(ids: DataFrame) -> DataFrame:
        return stored(whole.join(lookup_side(ids.distinct()), "id", "left_semi"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = stored(estimated(pairs, met, like))
        ends = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id")))
        return stored(verified(likely, texts_of(ends), like))

    found = confirmed(hub_pairs(lists))
    left = None
    for turn in range(1, len(TURNS) // HUBS + 1):
        parts = stored(components(found))
        rest = stored(unresolved(lists, parts))
        count = rest.select("rep").distinct().count()
        if not count:
            return found
        if turn == len(TURNS) // HUBS or left is not None and count * 2 > left:
            break
        left = count
        again = with_hubs(rest, TURNS[turn * HUBS:(turn + 1) * HUBS])
        label = parts.select("id", "component")
        pairs = hub_pairs(again).join(label.toDF("a", "l_a"), "a", "left").join(
            label.toDF("b", "l_b"), "b", "left").where(
            F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).select("a", "b")
        found = stored(found.unionByName(confirmed(pairs)))
    apart = rest.select(F.col("rep").alias("id")).unionByName(
        parts.join(rest.select(F.col("label").alias("component")).distinct(), "component", "left_semi").select("id"))
    texts = texts_of(apart)
    full = verified(stored(across(rest, texts, parts, like)), texts, like)
    return stored(found.unionByName(full))


def near_duplicates(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`.

    component_id is the smallest doc_id reachable by links, kept marks it. Equal sets are one class
    and are never paired; null, empty and blank texts are linked with nothing. Rows without doc_id
    have no component and are kept. Repeated rows are returned as often as they come. Hashes of 64
    bits tell sets apart; links are confirmed on the words themselves.
    """
    sketched = stored(sketches(docs, like, id_col, text))
    parts = components(links(docs, sketched, like, id_col, text)).toDF("rep", "component")
    classes = sketched.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    named = stored(classes.join(parts, "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component")))
    rows = sketched.select("doc_id", "n_shingles", "digest")
    joined = rows.join(named, "digest", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return joined.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, Likeness(width=2, percent=80))
