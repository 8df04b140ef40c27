import itertools
import math

import numpy as np
import pytest

from finstat.llm.lattice import Hasher, lattice_components, nearest_e8, op2, roots


def test_roots():
    r = roots()
    assert len({tuple(v) for v in r}) == 240
    assert np.allclose((r**2).sum(axis=1), 2)


def test_nearest_point_is_in_the_lattice_and_no_neighbour_is_nearer():
    x = np.random.default_rng(0).uniform(-3, 3, size=(2000, 8))
    p = nearest_e8(x)
    doubled = np.rint(p * 2)
    assert np.allclose(doubled, p * 2)
    assert ((doubled % 2 == doubled[:, :1] % 2).all(axis=1)).all()
    assert (p.sum(axis=1) % 2 == 0).all()
    own = ((x - p) ** 2).sum(axis=1)
    around = ((x[:, None] - p[:, None] - roots()) ** 2).sum(axis=2)
    assert (own[:, None] <= around + 1e-9).all()


def test_recall_at_the_threshold():
    """Pairs at a cosine of exactly 0.93, the hardest ones that have to be found."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z
    labels = np.zeros(len(x), dtype=np.int64)
    hasher = Hasher(64, 6, 4, 0.5, 0)
    a, b = hasher.keys(x, labels), hasher.keys(y, labels)
    met = ((a[:, :, :1] == b) | (a == b[:, :, :1])).any(axis=(1, 2))
    assert met.mean() >= 0.99


def brute(rows, cosine):
    good = []
    for i, v, label in rows:
        if v and label is not None and i is not None and None not in v and all(map(math.isfinite, v)) and any(v):
            good.append((i, np.array(v, dtype=float), label))
    n_links = [0] * len(good)
    parent = {i: i for i, *_ in good}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (p, (i, a, k)), (q, (j, b, m)) in itertools.combinations(enumerate(good), 2):
        if k == m and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
            n_links[p] += 1
            n_links[q] += 1
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    found = [(i, n, root(i)) for (i, *_), n in zip(good, n_links)]
    odd = [(i, 0, i) for i, v, label in rows if not any(i == g[0] for g in good)]
    return sorted(found + odd, key=repr)


@pytest.mark.parametrize("block_rows", [512, 8])
def test_links_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(5)
    rows = []
    for centre in rng.normal(size=(12, 16)):
        for _ in range(int(rng.integers(1, 60))):
            rows.append((len(rows), [float(x) for x in centre + rng.normal(size=16) * 0.15], int(rng.integers(0, 2))))
    rows += [(len(rows) + k, rows[3][1], rows[3][2]) for k in range(25)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    exact = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    got = sorted(map(tuple, lattice_components(frame, 0.93, block_rows=block_rows, tables=12).collect()), key=repr)
    assert got == brute(exact, 0.93)


def test_messy_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0], 1),
        (2, [2.0, 4.0, 6.0], 1),
        (3, [1.0, 2.0, 3.0], 2),
        (4, [1.0, 2.0, 3.0], None),
        (None, [1.0, 2.0, 3.0], 1),
        (5, None, 1),
        (6, [], 1),
        (7, [0.0, 0.0, 0.0], 1),
        (8, [1.0, None, 3.0], 1),
        (9, [1.0, nan, 3.0], 1),
        (10, [inf, 2.0, 3.0], 1),
        (11, [1.0, 2.0], 1),
        (12, [1.0, 2.0, 3.0], 2),
        (12, [1.0, 2.0, 3.0], 2),
        (13, [1e30, 2e30, 3e30], 1),
        (14, [1e-38, 2e-38, 3e-38], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame = frame.selectExpr("*", "1 AS id", "2 AS digest", "'k' AS keys", "0 AS vec", "0 AS n")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in op2(frame).collect()}
    assert got == {
        (1, 3, 1, True), (2, 3, 1, False), (13, 3, 1, False), (14, 3, 1, False),
        (3, 2, 3, True), (12, 2, 3, False),
        (None, 0, None, True),
        *((i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)),
    }
    assert op2(frame.limit(0)).collect() == []
