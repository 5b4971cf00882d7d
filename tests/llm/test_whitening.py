import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tokenloom.llm import whitening as Wh


def exact(rows):
    """Vectors as integers, their exact sums and their exact covariance."""
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in fine), default=0)
    x = [(i, [math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (d - len(v))]]) for i, v in fine]
    n, sums = len(x), [sum(v[j] for _, v in x) for j in range(d)]
    cov = [[sum((Fraction(v[a]) - Fraction(sums[a], n)) * (Fraction(v[b]) - Fraction(sums[b], n)) for _, v in x) / n for b in range(d)] for a in range(d)]
    return x, n, sums, cov


def check(spark, rows, components=32):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n string")
    out = Wh.whiten(df, components=components).collect()
    x, n, sums, cov = exact(rows)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    order = [i for i in np.argsort(-values)[:components] if values[i] > 1e-9 * values.max()]
    assert sorted(str((r.vec_id, r.component)) for r in out) == sorted(str((i, c + 1)) for i, _ in x for c in range(len(order)))
    assert {r.n for r in out} == {n}
    deviation = {}
    for i, v in x:
        deviation.setdefault(i, set()).add(sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)))
    assert all((r.deviation if r.deviation is not None else None) in {y if y < 1 << 63 else None for y in deviation[r.vec_id]} for r in out)
    trace = sum(float(cov[j][j]) for j in range(len(cov)))
    for c, at in enumerate(order, 1):
        assert all(abs(r.explained - values[at] / trace) <= 1e-6 * values[at] / trace for r in out if r.component == c)
    assert max(r.identity_error for r in out) <= 1e-4
    # Each component, up to one sign for all rows, for rows with an id of their own.
    ids = [i for i, _ in x]
    for c, at in enumerate(order, 1):
        got = {r.vec_id: r.whitened for r in out if r.component == c}
        want = {i: float(sum((Fraction(a) - Fraction(s, n)) * Fraction(float(q)) for a, s, q in zip(v, sums, vectors[:, at], strict=True))) / math.sqrt(values[at]) for i, v in x if ids.count(i) == 1}
        near = [abs(values[at] - values[o]) for o in order if o != at]
        if want and (not near or min(near) > 1e-6 * values.max()):
            assert min(max(abs(got[i] - s * w) for i, w in want.items()) for s in (1, -1)) < 1e-5
    return out


def test_matches_exact_fractions(spark):
    r = random.Random(0)
    rows = [(i, [r.gauss(0, 1 + j) + (i % 3) * j for j in range(5)]) for i in range(60)]
    rows += [(100, None), (101, [None, 1.0, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [1.0, float("inf"), 0.0, 0.0, 0.0])]
    out = check(spark, rows)
    assert len(out) == 60 * 5


def test_large_vectors_close_together(spark):
    """Squares of sums would lose all digits of such a covariance in doubles."""
    r = random.Random(1)
    check(spark, [(i, [1e9 + r.gauss(0, 1), -1e9 + r.gauss(0, 2), r.gauss(0, 1)]) for i in range(40)])


def test_few_components_repeats_nulls_and_lengths(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(30)]
    assert {x.component for x in check(spark, rows, components=2)} == {1, 2}
    rows += [(None, [1.0, 2.0]), (5, rows[5][1]), (5, [3.0]), (40, [])]
    out = check(spark, rows)
    assert sum(x.vec_id is None for x in out) == 6 and sum(x.vec_id == 5 for x in out) == 18


def test_no_variance_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert Wh.whiten(spark.createDataFrame([], schema)).count() == 0
    assert Wh.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert Wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    assert Wh.whiten(spark.createDataFrame([(1, []), (2, [])], schema)).count() == 0
    out = Wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], schema)).collect()
    assert sorted((x.vec_id, x.component, abs(x.whitened), x.explained) for x in out) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_scatter_is_exact_beyond_longs(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-1, 1]) * r.random() * 10.0 ** r.randint(0, 300) for _ in range(3)]) for i in range(25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    held = [[max(-Wh.EDGE, min(Wh.EDGE, math.floor(max(-1e30, min(1e30, 64 * c))))) for c in v] for _, v in rows]
    n, sums, centred = Wh.scatter(Wh.integers(df), 3)
    assert n == 25 and sums == [sum(v[j] for v in held) + 25 * Wh.SHIFT for j in range(3)]
    off = [sum(v[j] for v in held) for j in range(3)]
    assert centred == [[n * sum(v[a] * v[b] for v in held) - off[a] * off[b] for b in range(3)] for a in range(3)]
    assert max(abs(c) for row in centred for c in row) > 1 << 64


@pytest.mark.parametrize("wide", [10, 1 << 24, 1 << 30, 1 << 50])
def test_products(wide):
    x = np.random.default_rng(0).integers(-wide, wide, (200, 3))
    assert (Wh.exact_products(x) == x.astype(object).T @ x.astype(object)).all()


def test_too_many_dimensions(spark):
    with pytest.raises(ValueError, match="dimensions"):
        Wh.whiten(spark.createDataFrame([(1, [0.0] * (Wh.MAX_DIMENSIONS + 1))], "vec_id long, embedding array<double>"))
