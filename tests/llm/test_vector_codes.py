import hashlib

import numpy as np
import pytest

from cohortlens.llm import queries
from cohortlens.llm import vector_codes as vc
from tests.compare import difference, duck
from tests.llm.helpers import SF


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error) of usable rows by comparing with every entry."""
    kept = [(i, l, [int(np.floor(256.0 * x)) for x in v]) for i, v, l in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([r[2] for r in kept], dtype=object).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        gap = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return gap.argmin(axis=2), gap.min(axis=2)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    books[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    code, gap = assign()
    error = gap.sum(axis=1)
    labels = {}
    for r, e in zip(kept, error):
        labels[r[1]] = labels.get(r[1], 0) + e
    return sorted([(r[0], bytes(c.astype(np.uint8)).hex(), int(e), int(labels[r[1]])) for r, c, e in zip(kept, code, error)],
                  key=str), books


def compressed(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "vec_id long, embedding array<double>, label int, code string, error int")
    got, books = vc.compress(table.repartition(3), **options)
    return sorted(map(tuple, got.collect()), key=str), books


def test_query_equals_sql(spark):
    assert difference(queries.QUERIES["op13_vector_codes"](spark, SF), duck(SF), vc.ORACLE) is None


def test_orchard_search_finds_the_lowest_nearest_entry():
    rng = np.random.default_rng(1)
    for dims in (1, 2, 4, 9):
        book = rng.integers(-20, 20, (64, dims))
        book[10] = book[40]  # equal entries: the lower one wins
        points = rng.integers(-25, 25, (3000, dims))
        gap = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        here, best = vc.Neighbours(book).nearest(points)
        assert (here == gap.argmin(axis=1)).all() and (best == gap.min(axis=1)).all()


def test_orchard_search_skips_far_entries():
    """Of well separated groups of entries only the lists of near ones are walked."""
    rng = np.random.default_rng(2)
    centres = np.arange(8)[:, None] * 10_000 * np.ones((1, 4))
    book = np.repeat(centres, 8, axis=0).astype(np.int64) + rng.integers(-9, 9, (64, 4))
    lists = vc.Neighbours(book)
    looked = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            out = np.asarray(super().__getitem__(key))
            looked.append(out.size // 4 if out.ndim == 2 else 1)
            return out

    lists.book = book.view(Counting)
    lists.nearest(book + 1)
    assert sum(looked) < 64 * 64 / 2


@pytest.mark.parametrize("n", [500, 40])
def test_codes_equal_brute_force(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 0.3, (n, 32))
    x[n // 2:] = x[: n - n // 2]  # a group of copies
    rows = [(int(i), v.tolist(), [None, 3, 4][i % 3]) for i, v in enumerate(x)]
    rows += [(7, x[9].tolist(), 3), (None, x[3].tolist(), None), (900, None, 3), (901, [float("nan")] * 32, 3),
             (902, [float("inf")] + [0.0] * 31, 3), (903, [None] * 32, 4)]
    got, books = compressed(spark, rows)
    want, expected = brute(rows)
    assert got == want and (books == expected).all()
    flat = ",".join(str(v) for v in expected.reshape(-1))
    assert vc.digest(books) == hashlib.sha256(flat.encode()).hexdigest()


def test_lengths(spark):
    """Other lengths than that of the smallest id: no code; no length at all: the same for all."""
    rows = [(2, [0.5] * 16, 1), (3, [0.25] * 32, 1), (4, [], 2), (5, [1.0] * 16, 1)]
    assert compressed(spark, rows)[0] == [(2, "00" * 16, 0, 0), (3, None, None, 0), (4, None, None, None), (5, "01" * 16, 0, 0)]
    for odd in ([(1, [], 1), (2, [0.5] * 16, 1)], [(1, [0.5] * 15, 1), (2, [0.5] * 16, 1)]):
        assert compressed(spark, odd) == ([(1, None, None, None), (2, None, None, None)], None)
    assert compressed(spark, []) == ([], None)
    assert compressed(spark, [(1, None, 1)]) == ([], None)


def test_huge_components_stay_in_bounds(spark):
    rows = [(1, [1e300] * 16, 1), (2, [-1e300] * 16, 1), (3, [0.0] * 16, 1)]
    got, _ = compressed(spark, rows, entries=2)
    assert all(r[2] >= 0 for r in got) and vc.bits_per_component(64) == 1.5
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([], "vec_id long, embedding array<double>, label int"), entries=300)
