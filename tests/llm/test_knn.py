import math
import random

import numpy as np
import pytest

from tokenloom.llm import knn as K


def brute(rows, is_query, k):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, v) in enumerate(fine):
        if q is not None and is_query(q):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0) for at, (j, w) in enumerate(fine) if at != own)[:k]
            out += [(q, n, None if unnamed else j, -s) for n, (s, unnamed, j) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "d", "shard", "seed"), [(300, 5, 10**6, 0), (300, 5, 40, 1), (900, 3, 200, 2), (4, 2, 2, 3), (1, 2, 1, 4)])
def test_matches_brute_force(spark, n, d, shard, seed):
    r = random.Random(seed)
    f = lambda: float(np.float32(r.choice([r.gauss(0, 1), r.gauss(0, 0.01), 0.5])))
    rows = [(i, [f() for _ in range(d)]) for i in range(n)]
    same = [f() for _ in range(d)]
    rows += [(10_000 + i, same) for i in range(n // 3)]  # many equal vectors: ties
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    out = sorted((tuple(r) for r in K.top_k(df, lambda i: i % 7 == 0, shard_vectors=shard).collect()), key=str)
    assert out == brute(rows, lambda i: i % 7 == 0, 5)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [0.5, 0.0]), (5, [0.25, 0.0]), (0, [1.0, 0.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted((tuple(r) for r in K.top_k(df, lambda i: i % 5 == 0).collect()), key=str)
    assert out == brute(rows, lambda i: i % 5 == 0, 5)
    # Both rows of an id ask, and each is the other's candidate; so is a row without id, last of those that tie; an empty
    # vector's products are zero.
    assert len([r for r in out if r[0] == 5]) == 10 and (0, 1, 0, 65536) in out and (0, 2, None, 65536) in out and (0, 5, 6, 0) in out
    assert K.top_k(df.limit(0), lambda i: i % 5 == 0).count() == 0


def test_vectors_of_unequal_length(spark):
    rows = [(0, [1.0]), (1, [2.0, 3.0]), (2, [-1.0, 0.5, 4.0]), (3, []), (5, [0.25, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for shard in (10, 2):
        assert sorted((tuple(r) for r in K.top_k(df, lambda i: i % 5 == 0, shard_vectors=shard).collect()), key=str) == brute(rows, lambda i: i % 5 == 0, 5)


def test_bounds_hold_for_every_box():
    r = np.random.default_rng(0)
    v = r.integers(-300, 300, (500, 6))
    tree = K.KdTree.from_bytes(K.KdTree.build(np.arange(500), np.arange(500), v, leaf=16).to_bytes())
    q = r.integers(-300, 300, (20, 6))
    most = np.maximum(q, 0) @ tree.high.T + np.minimum(q, 0) @ tree.low.T
    for node, (a, b) in enumerate(tree.ranges):
        assert ((tree.vectors[a:b] @ q.T).max(axis=0) <= most[:, node]).all() and (b - a <= 16 or tree.children[node][0] >= 0)
