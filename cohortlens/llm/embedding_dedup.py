"""Near-duplicate vectors: a robust-pruned flat graph built on overlapping cluster shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import components, slices, stored, table

#: Vectors of a shard, queries that search it in one task, clusters at most.
SHARD, QUERIES, MOST_CLUSTERS = 3000, 6000, 4096
#: Bound of the sample that clusters are fitted on, and of the one that audits recall: it grows up
#: to the second bound until so many of its vectors have true links.
SAMPLE, AUDIT, MOST_AUDIT, ENOUGH = 20_000, 256, 16_384, 32
#: Out-degree, near and random candidates of the pruning, its slack; beam and entry points.
DEGREE, NEAR, RANDOM, SLACK = 16, 40, 24, 1.2
BEAM, MEDOIDS = 24, 8
#: Clusters that a vector belongs to, and those that it searches, widened until the audit is met,
#: beyond the last by doubling up to all.
MEMBERSHIPS, PROBES, RECALL = 2, (3, 6, 12), 0.95


def unit_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, digest, unit, dim): unit vectors in double precision; digest and unit are null for
    vectors that are null, empty, zero or hold null or non-finite components, or without id."""
    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            ids, units, digests, dims = batch.column(0).to_pylist(), [], [], []
            for doc, v in zip(ids, batch.column(1).to_pylist()):
                usable = doc is not None and v and None not in v
                x = np.array(v, dtype=np.float64) if usable else np.zeros(0)
                with np.errstate(over="ignore", invalid="ignore"):
                    top = np.abs(x).max() if len(x) else 0.0
                    usable = bool(np.isfinite(top) and top > 0)
                    unit = x / top if usable else x
                    unit = unit / np.sqrt(unit @ unit) if usable else unit
                units.append(unit if usable else None)
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if usable else None)
                dims.append(len(unit) if usable else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(units, pa.list_(pa.float64())),
                 pa.array(dims, pa.int32())], names=["vec_id", "digest", "unit", "dim"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
                          ).mapInArrow(norm, "vec_id long, digest binary, unit array<double>, dim int")


def spherical_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[s:s + 4096] @ centers.T).argmax(axis=1) for s in range(0, len(x), 4096)])
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), x[rng.choice(len(x), k)])
    return centers


def fit_clusters(classes: DataFrame) -> dict[int, np.ndarray]:
    """Cluster centres by dimension, fitted on a bounded sample of the distinct vectors."""
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    draw = F.pmod(F.xxhash64("rep", F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    rows = classes.where(draw * total < SAMPLE).select("rep", "dim", "unit").collect()
    out = {}
    for dim, n in sorted(counts.items()):
        own = sorted((r for r in rows if r["dim"] == dim), key=lambda r: r["rep"])
        own = own or classes.where(F.col("dim") == dim).limit(1).collect()
        x = np.array([r["unit"] for r in own])
        k = max(1, min(MOST_CLUSTERS, -(-n * MEMBERSHIPS // SHARD), len(x) // 4 or 1))
        out[dim] = spherical_means(x, k, 8, seed=3)
    return out


def assigned(classes: DataFrame, centers: dict[int, np.ndarray], probes: int) -> DataFrame:
    """(rep, times, unit, near): `near` has the keys of the nearest clusters, nearest first."""
    first, start = {}, 0
    for dim, own in centers.items():
        first[dim] = start
        start += len(own)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            near = [[first[len(u)] + int(c) for c in np.argsort(-(centers[len(u)] @ np.array(u)))[:probes]]
                    for u in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))],
                                             names=["rep", "times", "unit", "near"])

    return classes.select("rep", "times", "unit").mapInArrow(
        place, "rep long, times long, unit array<double>, near array<int>")


def pruned(x: np.ndarray, seed: int) -> np.ndarray:
    """Neighbours of every row (-1: none) by robust pruning: of the nearest rows and some random
    ones, the nearest is taken and those that it makes superfluous are dropped, again and again.
    Half of the places are for edges back."""
    n = len(x)
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    near, far = min(NEAR, n - 1), min(RANDOM, n - 1)
    out = np.full((n, 2 * DEGREE), -1, dtype=np.int64)
    if n < 2:
        return out
    for start in range(0, n, 256):
        rows = np.arange(start, min(n, start + 256))
        like = x[rows] @ x.T
        like[np.arange(len(rows)), rows] = -2
        pool = np.argpartition(-like, near - 1, axis=1)[:, :near]
        pool = np.concatenate([pool, rng.integers(0, n, (len(rows), far))], axis=1)
        gap = 2 - 2 * np.take_along_axis(like, pool, 1)
        gap[pool == rows[:, None]] = np.inf
        order = np.argsort(gap, axis=1)
        pool, gap = np.take_along_axis(pool, order, 1), np.take_along_axis(gap, order, 1)
        chosen = x[pool]
        between = 2 - 2 * np.einsum("pcd,ped->pce", chosen, chosen)
        alive = np.isfinite(gap)
        for k in range(DEGREE):
            pick = alive.argmax(axis=1)
            ok = alive[np.arange(len(rows)), pick]
            if not ok.any():
                break
            out[rows[ok], k] = pool[ok, pick[ok]]
            blocked = SLACK ** 2 * between[np.arange(len(rows)), pick] <= gap
            alive &= ~blocked
            alive[np.arange(len(rows)), pick] = False
    source, place = np.nonzero(out[:, :DEGREE] >= 0)
    target = out[source, place]
    order = np.lexsort((place, target))
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    some = rank < DEGREE
    out[target[some], DEGREE + rank[some]] = source[some]
    return out


def in_range(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, own: np.ndarray, bound: float,
             seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs with cosine >= `bound` found over the graph. A beam of nodes is expanded
    greedily from the medoids and, where the query itself is a row, from it; then every row found in
    range is expanded, as far as that leads to more of them. Cosines are taken in double precision."""
    n, m = len(x), len(queries)
    centers = spherical_means(x, min(MEDOIDS, n), 4, seed)
    entry = np.unique((x @ centers.T).argmax(axis=0))
    fast, ask = x.astype(np.float32), queries.astype(np.float32)
    loose = np.float32(bound - 1e-4)
    seen = np.zeros((m, n), dtype=bool)
    hit = np.zeros((m, n), dtype=bool)
    width = max(BEAM, len(entry) + 1)
    beam = np.full((m, width), -1, dtype=np.int64)
    score = np.full((m, width), -9, dtype=np.float32)
    done = np.ones((m, width), dtype=bool)

    def look(q: np.ndarray, node: np.ndarray) -> np.ndarray:
        like = np.empty(len(q), dtype=np.float32)
        for s in range(0, len(q), 1 << 17):
            like[s:s + (1 << 17)] = np.einsum("ij,ij->i", ask[q[s:s + (1 << 17)]], fast[node[s:s + (1 << 17)]])
        seen[q, node] = True
        hit[q, node] |= like >= loose
        return like

    for k, node in enumerate([*entry, None]):
        q = np.arange(m) if node is not None else np.flatnonzero(own >= 0)
        nodes = np.full(len(q), node) if node is not None else own[q]
        fresh = ~seen[q, nodes]
        q, nodes = q[fresh], nodes[fresh]
        beam[q, k], score[q, k], done[q, k] = nodes, look(q, nodes), False
    active = np.arange(m)
    while len(active):
        best = np.where(done[active], -9, score[active]).argmax(axis=1)
        going = ~done[active, best]
        active, best = active[going], best[going]
        if not len(active):
            break
        done[active, best] = True
        nodes = edges[beam[active, best]]
        ok = (nodes >= 0) & ~seen[active[:, None], nodes]
        like = np.full(nodes.shape, -9, dtype=np.float32)
        row, col = np.nonzero(ok)
        like[row, col] = look(active[row], nodes[row, col])
        # a node may stand twice among the edges of one node; the second adds nothing
        merged = np.concatenate([score[active], like], axis=1)
        names = np.concatenate([beam[active], np.where(ok, nodes, -1)], axis=1)
        flags = np.concatenate([done[active], ~ok], axis=1)
        top = np.argpartition(-merged, width - 1, axis=1)[:, :width]
        score[active] = np.take_along_axis(merged, top, 1)
        beam[active] = np.take_along_axis(names, top, 1)
        done[active] = np.take_along_axis(flags, top, 1)
    q, node = np.nonzero(hit)
    while len(q):
        following = edges[node]
        asked = np.repeat(q, following.shape[1])
        following = following.reshape(-1)
        ok = following >= 0
        asked, following = asked[ok], following[ok]
        code = np.unique((asked * n + following)[~seen[asked, following]])
        asked, following = code // n, code % n
        found = look(asked, following) >= loose
        q, node = asked[found], following[found]
    q, node = np.nonzero(hit)
    exact = np.concatenate([np.einsum("ij,ij->i", queries[q[s:s + 65536]], x[node[s:s + 65536]]) >= bound
                            for s in range(0, len(q), 65536)] or [np.zeros(0, bool)])
    return q[exact], node[exact]


def search(rows: DataFrame, probes: int, bound: float) -> DataFrame:
    """(vec_id, found, root) rows: for a query the copies in range of it that one shard owns, and
    for every vector in a link the smallest id that the shard's links connect it with. A link counts in
    the first cluster of the vector found that the query probes."""
    own_clusters = F.slice("near", 1, MEMBERSHIPS)
    member = rows.select("rep", "times", "unit", own_clusters.alias("own"), F.posexplode(own_clusters).alias("k", "cluster"))
    sizes = member.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("tiles"))
    probed = F.slice("near", 1, probes)
    asking = rows.select("rep", "unit", probed.alias("probed"), F.explode(probed).alias("cluster"))
    asked = asking.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("turns"))
    plan = stored(sizes.join(asked, "cluster"))  # one row per cluster

    def chunk(number: str):
        return F.pmod(F.xxhash64("rep", "cluster"), F.col(number)).cast("int")

    def every(number: str):
        return F.explode(F.sequence(F.lit(0), F.col(number) - 1))

    placed = stored(member.join(plan, "cluster").withColumn("tile", chunk("tiles")))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        x, reps = np.stack(frame["unit"].to_list()), frame["rep"].to_numpy()
        edges = pruned(x, seed=len(x))
        return pd.DataFrame({"rep": reps, "edges": [reps[e[e >= 0]] for e in edges]})

    shards = placed.select("cluster", "tile", "rep", "unit").groupBy("cluster", "tile").applyInPandas(
        build, "rep long, edges array<long>")
    graph = stored(shards.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")))
    nodes = placed.join(graph, "rep").select(
        "cluster", "tile", every("turns").alias("turn"), "rep", "times", "unit", "edges",
        F.slice("own", F.lit(1), F.col("k")).alias("before"))
    queries = asking.join(plan, "cluster").withColumn("turn", chunk("turns")).select(
        "cluster", every("tiles").alias("tile"), "turn", "rep", "unit", "probed")

    def seek(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["vec_id", "found", "root"]
        if left.empty or right.empty:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        left, right = left.sort_values("rep"), right.sort_values("rep")
        reps, asks = left["rep"].to_numpy(), right["rep"].to_numpy()
        x, queries_ = np.stack(left["unit"].to_list()), np.stack(right["unit"].to_list())
        lengths = left["edges"].str.len().to_numpy()
        flat = np.concatenate(left["edges"].to_list())
        at = np.minimum(np.searchsorted(reps, flat), len(reps) - 1)
        known = reps[at] == flat
        edges = np.full((len(reps), max(1, lengths.max())), -1, dtype=np.int64)
        row = np.repeat(np.arange(len(reps)), lengths)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        edges[row[known], col[known]] = at[known]
        own = np.minimum(np.searchsorted(reps, asks), len(reps) - 1)
        own = np.where(reps[own] == asks, own, -1)
        q, node = in_range(x, edges, queries_, own, bound)
        # a pair of which both are asked and searched here is found by both if by one
        ask_at = np.minimum(np.searchsorted(asks, reps[node]), len(asks) - 1)
        node_at = np.minimum(np.searchsorted(reps, asks[q]), len(reps) - 1)
        both = (asks[ask_at] == reps[node]) & (reps[node_at] == asks[q])
        code = np.unique(np.concatenate([q * len(reps) + node, ask_at[both] * len(reps) + node_at[both]]))
        q, node = code // len(reps), code % len(reps)
        other = reps[node] != asks[q]
        q, node = q[other], node[other]
        first = np.ones(len(q), dtype=bool)
        before, probed_ = left["before"].to_list(), np.stack(right["probed"].to_list())
        for k in range(MEMBERSHIPS - 1):
            earlier = np.array([b[k] if len(b) > k else -1 for b in before])
            for c in range(probed_.shape[1]):
                first &= earlier[node] != probed_[q, c]
        weight = left["times"].to_numpy()
        found = np.bincount(q, weights=weight[node] * first, minlength=len(asks)).astype(np.int64)
        ids = np.unique(np.concatenate([asks[q], reps[node]]))
        a, b = np.searchsorted(ids, asks[q]), np.searchsorted(ids, reps[node])
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        linked = np.flatnonzero(found)
        return pd.DataFrame({"vec_id": np.concatenate([ids, asks[linked]]),
                             "found": np.concatenate([np.zeros(len(ids), np.int64), found[linked]]),
                             "root": np.concatenate([ids[root], asks[linked]])})

    return nodes.groupBy("cluster", "tile", "turn").cogroup(queries.groupBy("cluster", "tile", "turn")).applyInPandas(
        seek, "vec_id long, found long, root long")


def true_links(classes: DataFrame, bound: float) -> tuple[DataFrame, bool]:
    """((rep, expected) of a sample with the true links of its vectors, whether these are enough to
    audit with). The sample grows until enough of its vectors have links; they are compared with all
    vectors, in blocks."""
    total = classes.count()
    draw = F.pmod(F.xxhash64("rep", F.lit(43)), F.lit(1 << 30)) / float(1 << 30)
    wanted = AUDIT
    while True:
        sample = classes.where(draw * total < wanted).select("rep", "unit").collect()
        true = stored(expected_links(classes, sample, bound))
        linked = true.where("expected > 0").count()
        if linked >= ENOUGH or wanted >= total or wanted >= MOST_AUDIT:
            return true, linked >= ENOUGH or wanted >= total
        wanted = min(wanted * 8, MOST_AUDIT)


def expected_links(classes: DataFrame, sample: list, bound: float) -> DataFrame:
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r["unit"]) for r in sample}:
        own = [r for r in sample if len(r["unit"]) == dim]
        by_dim[dim] = np.array([r["rep"] for r in own]), np.array([r["unit"] for r in own])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            cols = batch.to_pydict()
            for dim, (ids, x) in by_dim.items():
                own = [k for k, u in enumerate(cols["unit"]) if len(u) == dim]
                if own:
                    times = np.array([cols["times"][k] for k in own])
                    reps = np.array([cols["rep"][k] for k in own])
                    hit = (x @ np.array([cols["unit"][k] for k in own]).T >= bound) & (ids[:, None] != reps[None])
                    expected = hit @ times
                    some = expected > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[some]), pa.array(expected[some])], names=["rep", "expected"])

    return classes.select("rep", "times", "unit").mapInArrow(count, "rep long, expected long").groupBy("rep").agg(
        F.sum("expected").alias("expected"))


def audit(true: DataFrame, found: DataFrame) -> float:
    """Recall over the links or as a mean over the vectors that have any, whichever is less."""
    got = F.least("expected", F.coalesce("found", F.lit(0)))
    row = true.join(found, "rep", "left").where("expected > 0").agg(
        F.sum("expected").alias("expected"), F.sum(got).alias("found"), F.avg(got / F.col("expected")).alias("each")).first()
    return 1.0 if not row["expected"] else min(row["found"] / row["expected"], row["each"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                    bound: float = 0.95) -> tuple[DataFrame, float]:
    """((vec_id, n_links, component_id, kept) of every row, audited recall: nan where too few of the
    largest sample have links to measure it, after a search of all clusters).

    Equal vectors are one class whose copies link with each other and with all that one links with.
    Vectors that are null, zero or not finite, and rows without id, link with nothing: no links,
    their own component, kept. Vectors of different length are never compared. Repeated rows count
    as further vectors. Clusters beyond SHARD vectors are split into tiles at random and every
    query meets every tile, so a dense region costs blocks of comparisons and loses no link.
    """
    units = stored(unit_vectors(vectors, id_col, vector))
    classes = stored(units.where("digest is not null").groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.first("unit").alias("unit"),
        F.first("dim").alias("dim")))
    centers = fit_clusters(classes)
    most = max(map(len, centers.values()), default=0)
    true, enough = true_links(classes, bound)
    wider = [*PROBES]
    while wider[-1] < most:
        wider.append(2 * wider[-1])
    if not enough:  # no audit could end it earlier
        wider = wider[-1:]
    recall, found, edges = 1.0, None, None
    for probes in wider:
        seen = stored(search(stored(assigned(classes, centers, probes)), probes, bound))
        found = stored(seen.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("found").alias("found")))
        edges = seen.where("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b"))
        recall = audit(true, found) if enough else float("nan")
        if recall >= RECALL or probes >= most:
            break
    parts = components(edges).toDF("rep", "component")
    named = stored(classes.select("digest", "rep", "times").join(found, "rep", "left").join(parts, "rep", "left").select(
        "digest", (F.coalesce("found", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component")))
    rows = units.select("vec_id", "digest").join(named, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), recall


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, recall = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return result.withColumn("audited_recall", F.lit(float(recall)))


#: The same by comparing all pairs; a search that finds all links has an audited recall of 1.
ORACLE = """
WITH RECURSIVE usable AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN links ON a = other)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(other) AS component_id,
  vec_id = min(other) AS kept, 1.0::DOUBLE AS audited_recall FROM reach GROUP BY vec_id"""
