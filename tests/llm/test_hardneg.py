"""Hard negatives against brute force, and the cover tree's invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<long>, anchor int, row string, V int"


def rows(seed=0, n=260, dim=6, clustered=True):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 60, (5, dim))
    out = []
    for i in range(n):
        v = centers[rng.integers(5)] + rng.normal(0, 8, dim) if clustered else rng.normal(0, 50, dim)
        out.append((i, int(rng.integers(4)), [int(x) for x in v]))
    hot = out[7][2]
    out += [(n + i, i % 3, list(hot)) for i in range(80)]                    # a third of all rows is one vector
    out += [(500, 1, [0] * dim), (501, 2, [0] * dim), (502, None, [1] * dim), (503, 1, None), (504, 1, [1, None, 2, 3, 4, 5]),
            (505, 3, [9, 9]), (506, 3, []), (None, 2, [int(x) for x in centers[0]]), (None, 2, [int(x) for x in centers[0]])]
    out += [out[20], out[20], out[41]]                                       # repeated rows, one of them an anchor
    return [(i, la, v, 1, "x", 2) for i, la, v in out]


def brute(data, is_anchor, n_pos=5, n_neg=10, low=30, high=90):
    dim = max(len(v) for _, _, v, *_ in data if v)
    use = [(i, la, [*v, *[0] * (dim - len(v))]) for i, la, v, *_ in data
           if la is not None and v is not None and None not in v]
    out = []
    for a, (i, la, v) in enumerate(use):
        if not is_anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j, lb) for b, (j, lb, w) in enumerate(use) if b != a]
        scored.sort(key=lambda s: s[:3])
        for s, _, _, j, lb in [x for x in scored if x[4] == la][:n_pos]:
            fits = [x for x in scored if x[4] != la and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(i, j, r + 1, x[3], -s, -x[0]) for r, x in enumerate(fits[:n_neg])]
    return sorted(out, key=str)


@pytest.mark.parametrize("clustered", [True, False])
def test_equals_brute_force(spark, clustered):
    data = rows(clustered=clustered)
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = hardneg.mine_hard_negatives(df, (F.col("vec_id") % 20 == 0) | F.col("vec_id").isin(501, 41), centers=8,
                                      sample=64, block_rows=32)
    got = got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    want = brute(data, lambda i: i is not None and (i % 20 == 0 or i in (501, 41)))
    assert sorted(map(tuple, got), key=str) == want and len(want) > 100


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(3)
    data = [(i, i % 2, [int(x) for x in rng.integers(-10**8, 10**8, 4)], 1, "x", 2) for i in range(60)]
    got = hardneg.mine_hard_negatives(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 10 == 0, block_rows=16)
    got = got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, got), key=str) == brute(data, lambda i: i % 10 == 0)


def test_empty_tables_and_missing_partners(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hardneg.mine_hard_negatives(none, F.lit(True)).count() == 0
    lone = spark.createDataFrame([(0, 1, [1, 2], 1, "x", 2), (1, 2, [1, 1], 1, "x", 2)], SCHEMA)
    assert hardneg.mine_hard_negatives(lone, F.lit(True)).count() == 0
    assert hardneg.mine_hard_negatives(lone, F.lit(None).cast("boolean")).count() == 0


def test_cover_tree(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 1, (400, 3)), np.full((200, 3), 2.0), rng.normal(5, 0.1, (300, 3))))
    t = hardneg.CoverTree.build(x)
    assert sorted(t.order) == list(range(len(x))) and t.n_child.max() > 1
    for i in range(len(t.center)):
        inside = x[t.order[t.lo[i]:t.hi[i]]]
        assert np.isclose(np.linalg.norm(inside - x[t.center[i]], axis=1).max(), t.radius[i])
        if t.n_child[i]:
            kids = range(t.child[i], t.child[i] + t.n_child[i])
            c = x[t.center[list(kids)]]
            apart = np.linalg.norm(c[:, None] - c[None], axis=2)[~np.eye(len(c), dtype=bool)]
            assert apart.min() > t.radius[i] / 2 and max(t.radius[list(kids)]) <= t.radius[i] / 2 + 1e-9
            assert [t.lo[j] for j in kids][1:] == [t.hi[j] for j in kids][:-1]


def test_descent_skips_nodes(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(0, 400, (40, 8))[rng.integers(0, 40, 4000)] + rng.normal(0, 4, (4000, 8))).astype(np.int64)
    square = float((v.astype(float) ** 2).sum(axis=1).max())
    tree = hardneg.CoverTree.build(hardneg._augmented(v, square))
    block = object.__new__(hardneg._Block)
    block.tree, block.v, block.square = tree, v, square
    block.id = block.row = np.arange(4000)
    block.label, block.no_id = np.zeros(4000, dtype=np.int64), np.zeros(4000, dtype=bool)

    class Counted(np.ndarray):
        seen = 0

        def __matmul__(self, other):
            if self.ndim == 2:
                Counted.seen += len(self)
            return np.asarray(self) @ np.asarray(other)
    block.exact = v.astype(float).view(Counted)
    at, score = block.search(v[5], 5, 0, True, -np.inf, np.inf, 5)
    ip = v @ v[5]
    ip[5] = -2**62
    assert score.tolist() == sorted(ip.tolist(), reverse=True)[:5] and Counted.seen < 1500
