import numpy as np

from cohortlens.llm import embedding_dedup as e
from cohortlens.llm.common import components


def true_links(rows, bound=0.95):
    ids = [r[0] for r in rows]
    usable = [k for k, r in enumerate(rows) if r[0] is not None and r[1] and None not in r[1]
              and np.isfinite(r[1]).all() and np.any(r[1])]
    degree, parent = {k: 0 for k in range(len(rows))}, {k: k for k in range(len(rows))}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(usable):
        for b in usable[i + 1:]:
            x, y = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (a, b))
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= bound:
                degree[a] += 1
                degree[b] += 1
                p, q = sorted((find(a), find(b)), key=lambda k: ids[k])
                parent[q] = p
    return {k: (degree[k], ids[find(k)]) for k in range(len(rows))}


def fixture(seed=0, n=400, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[50:130] = x[50] + rng.normal(scale=0.05, size=(80, d))
    x[130:160] = x[130]
    x[160:200] = x[100:140] * 3
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(n, None), (n + 1, [0.0] * d), (n + 2, [float("nan")] * d), (n + 3, [None] * d), (n + 4, []),
             (n + 5, [1.0, 0.0]), (n + 6, [1.0, 0.01]), (None, x[0].tolist()), (n + 7, [1e200] * d), (n + 8, [1e-200] * d)]
    return rows


def test_links_and_components_equal_brute_force(spark):
    rows = fixture()
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, kept int")
    got, recall = e.near_duplicates(table)
    expected = {rows[k][0]: v for k, v in true_links(rows).items()}
    out = got.collect()
    assert len(out) == len(rows) and recall >= e.RECALL
    found = sum(r["n_links"] for r in out)
    assert found >= 0.95 * sum(v[0] for v in expected.values())
    for r in out:
        assert r["n_links"] <= expected[r["vec_id"]][0]
        assert r["component_id"] == expected[r["vec_id"]][1]
        assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_many_shards_and_tiles(spark, monkeypatch):
    for name, value in (("SHARD", 60), ("QUERIES", 70), ("SAMPLE", 150)):
        monkeypatch.setattr(e, name, value)
    rows = fixture(seed=3)
    got, recall = e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    expected = {rows[k][0]: v for k, v in true_links(rows).items()}
    out = got.collect()
    assert sum(r["n_links"] for r in out) >= 0.9 * sum(v[0] for v in expected.values())
    assert all(r["n_links"] <= expected[r["vec_id"]][0] for r in out) and recall >= 0.9


def test_empty_table_and_single_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert e.near_duplicates(empty)[0].count() == 0
    one = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in e.near_duplicates(one)[0].collect()] == [(5, 0, 5, True)]
    twice = spark.createDataFrame([(5, [1.0, 2.0]), (3, [1.0, 2.0]), (8, [2.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in e.near_duplicates(twice)[0].collect()) == [(3, 1, 3, True), (5, 1, 3, False), (8, 0, 8, True)]


def test_components_of_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(0, 60)]
    hub = [(100, 100 + k) for k in range(1, 50)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain + hub + hub + [(7, 7)], "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 150)}


def test_audit_draws_until_links_are_met_and_counts_each_vector(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x[2900:2950] = x[2950:] + rng.normal(scale=0.01, size=(50, 16))
    units = e.unit_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>"), "id", "v")
    classes = units.selectExpr("vec_id as rep", "1L as times", "unit").cache()
    true, enough = e.true_links(classes, 0.95)
    assert enough and true.count() >= e.ENOUGH
    nothing = spark.createDataFrame([], "rep long, found long")
    assert e.audit(true, nothing) == 0.0
    rows = [(k, 1000) for k in range(100)] + [(k, 1) for k in range(100, 140)]
    dense = spark.createDataFrame(rows, "rep long, expected long")
    found = spark.createDataFrame(rows[:100], "rep long, found long")
    assert e.audit(dense, found) < 0.75


def test_links_met_outside_the_home_cluster_count_once(spark):
    # 2 lies at home in cluster 1 and, second, in cluster 0: query 1 probes only cluster 0, query 3 both
    rows = [(1, 1, [1.0, 0.0], [0, 9]), (2, 1, [1.0, 0.01], [1, 0]), (3, 1, [1.0, 0.02], [0, 1])]
    table = spark.createDataFrame(rows, "rep long, times long, unit array<double>, near array<int>")
    near = table.selectExpr("rep", "times", "unit", "near")
    seen = e.search(near, 1, 0.95).groupBy("vec_id").sum("found")
    one = {r[0]: r[1] for r in seen.collect()}
    assert one[1] == 2
    both = {r[0]: r[1] for r in e.search(near, 2, 0.95).groupBy("vec_id").sum("found").collect()}
    assert both[3] == 2 and both[1] == 2


def brute_links(x, bound=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    degree, parent = np.zeros(len(x), dtype=int), np.arange(len(x))
    for start in range(0, len(x), 1000):
        row, col = np.nonzero(unit[start:start + 1000] @ unit.T >= bound)
        other = row + start != col
        np.add.at(degree, row[other] + start, 1)
        while True:  # smallest id reachable so far, until nothing changes
            low = np.minimum(parent[row + start], parent[col])
            new = parent.copy()
            np.minimum.at(new, row + start, low)
            np.minimum.at(new, col, low)
            if (new == parent).all():
                break
            parent = new
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return degree, parent


def test_links_are_counted_at_both_ends(spark):
    """Planted pairs over several clusters: links of every vector against brute force."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(8000, 24))
    for k in range(760):
        x[4000 + 5 * k] = x[k] + rng.normal(scale=0.03, size=24)
    degree, component = brute_links(x)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, recall = e.near_duplicates(table)
    rows = got.collect()
    found = {r["vec_id"]: r["n_links"] for r in rows}
    assert degree.sum() >= 1520 and recall >= e.RECALL
    assert all(found[k] <= degree[k] for k in found)
    assert sum(found.values()) >= 0.995 * degree.sum()
    # no component of two of which only one end counts the link
    alone = [k for k in range(len(x)) if degree[k] == 1 and found[k] == 0]
    assert all(next(r for r in rows if r["vec_id"] == k)["component_id"] == k for k in alone)


def test_query_against_brute_force(spark):
    from tests.compare import difference, duck
    from tests.llm.helpers import SF

    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    degree, _ = brute_links(np.array([r["embedding"] for r in table], dtype=float))
    rows = e.query(spark, SF)
    assert difference(rows, duck(SF), e.ORACLE) is None
    got = {r["vec_id"]: r["n_links"] for r in rows.collect()}
    assert got == {r["vec_id"]: d for r, d in zip(table, degree.tolist())}
