import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import hard_negatives as H


def brute(rows, every=100, positives=5, negatives=10):
    fine = [(at, i, label, [math.floor(256 * x) for x in v]) for at, (i, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for at, i, label, v in fine:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, other == label) for o, j, other, w in fine if o != at]
        for p, pid, _ in sorted((s for s in scored if s[2]), key=order)[:positives]:
            hard = sorted((s for s in scored if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:negatives]
            out += [(i, pid, n, nid, p, s) for n, (s, nid, _) in enumerate(hard, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, row string")
    return sorted((tuple(r) for r in H.mine(df, lambda i: i % 10 == 0, **options).collect()), key=str)


@pytest.mark.parametrize(("n", "d", "shard", "seed"), [(250, 4, 10**6, 0), (250, 4, 30, 1), (500, 3, 100, 2), (3, 2, 1, 3)])
def test_matches_brute_force(spark, n, d, shard, seed):
    r = random.Random(seed)
    f = lambda: float(np.float32(r.choice([r.gauss(0, 1), r.gauss(0, 3), 0.5])))
    rows = [(i, [f() for _ in range(d)], r.randrange(4)) for i in range(n)]
    same = [f() for _ in range(d)]
    rows += [(10_000 + i, same, r.randrange(4)) for i in range(n // 3)]  # many equal vectors: ties
    assert mined(spark, rows, shard_vectors=shard) == brute(rows, 10)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [1.0, float("nan")], 2), (4, [float("inf"), 0.0], 2), (5, [0.5, 0.0], None), (None, [0.5, 0.0], 2), (6, [0.5, 0.0], 2), (None, [0.9, 0.0], 1), (7, [0.25], 2), (8, [], 3), (9, [0.0, 0.0], 1), (10, [-1.0, 0.0], 2)]
    got = mined(spark, rows)
    assert got == brute(rows, 10)
    assert (0, 0, 2, None, 65536, 32768) in got and any(r[1] is None for r in got)
    assert (0, 9, 1, 8, 0, 0) in got  # a positive that scores zero: a window of zero
    assert mined(spark, rows[:0]) == [] and mined(spark, [(0, [], 1), (1, [], 2)]) == []


def test_label_may_be_made_up(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)], r.randrange(10)) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = sorted((tuple(x) for x in H.mine(df, lambda i: i % 10 == 0, label).collect()), key=str)
    assert got == brute([(i, v, (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows], 10) != brute(rows, 10)


def shard_of(vectors, labels, bucket):
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    ids = np.arange(len(vectors))
    return H.Shard(ids[order], ids[order], np.zeros(len(ids), bool), labels[order], vectors[order], norms[order], bucket)


def test_short_buckets_are_skipped():
    r = np.random.default_rng(0)
    vectors = r.integers(-100, 100, (1000, 4)) * np.repeat([50, 1], [100, 900])[:, None]
    tree = shard_of(vectors, np.zeros(1000, int), 50)
    a = vectors[:1]
    norms = np.sqrt((a.astype(float) ** 2).sum(axis=1))
    found, looked = tree.search(np.array([0]), np.array([0]), a, norms, [[(0, H.LOWEST, H.HIGHEST)]], True, 5)
    assert looked < len(tree.starts) and sorted((-s, i) for _, _, i, s in found) == sorted((-int(v @ a[0]), i) for i, v in enumerate(vectors) if i)[:5]
    # A window's lower end prunes before anything is found.
    assert tree.search(np.array([0]), np.array([1]), a, norms, [[(0, int(norms[0] * tree.longest[3]) + 1, H.HIGHEST)]], False, 5)[1] <= 3


def test_blocks_go_only_to_shards_that_are_long_enough(spark, monkeypatch):
    made, sent = [], []
    plain, pack = H.stream_by_shard, H._blocks

    def counted(build, probe, *args):
        sent.append(probe.count())
        return plain(build, probe, *args)

    def packed(*args):
        out = pack(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(H, "stream_by_shard", counted)
    monkeypatch.setattr(H, "_blocks", packed)
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) * (100 if i % 20 == 0 else 0.01 if i % 3 else 1) for _ in range(4)], r.randrange(3)) for i in range(600)]
    assert mined(spark, rows, shard_vectors=25, positives=3) == brute(rows, 10, positives=3)
    shards = 24
    for (home, elsewhere), (at_home, sent_on) in ((made[:2], sent[:2]), (made[2:], sent[2:])):
        assert at_home == home and sent_on < elsewhere * (shards - 1) * 0.7


@pytest.mark.parametrize("wide", [100, 1 << 28, 1 << 40])
def test_scores_are_exact(wide):
    r = np.random.default_rng(1)
    vectors, a = r.integers(-wide, wide, (50, 8)), r.integers(-wide, wide, (3, 8))
    want = np.clip(a.astype(object) @ vectors.T.astype(object), H.LOWEST, H.HIGHEST)
    assert (shard_of(vectors, np.zeros(50, int), 10).scores(a, 0, 50).astype(object) == want[:, np.argsort(-np.sqrt((vectors.astype(float) ** 2).sum(axis=1)), kind="stable")]).all()
