"""Sweeps over sorted paths, against each path compared with all."""

import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import containment as T
from tokenloom.operators import relations as rel

PARTS = ["a", "ab", "a-b", "a b", "b", "é", "a.", "z", "0", "~", "a!"]


def random_path(r, depth=5):
    return "/" + "/".join(r.choice(PARTS) for _ in range(r.randrange(1, depth)))


def outermost(paths):
    return {p for p in paths if not any(p != q and p.startswith(f"{q}/") for q in paths)}


@pytest.mark.parametrize(("n", "parts", "seed"), [(40, 1, 0), (400, 7, 1), (2000, 16, 2)])
def test_outermost(spark, n, parts, seed):
    r = random.Random(seed)
    paths = [random_path(r, 5 + seed) for _ in range(n)] * 2
    r.shuffle(paths)
    df = spark.createDataFrame([(p, 1) for p in paths], "path string, path2 int").repartition(parts)
    got = [x.path for x in rel.dedupe_selection(df).collect()]
    assert sorted(got) == sorted(outermost(set(paths)))


def test_one_folder_holds_most(spark):
    """The paths of one folder leave their tasks as that folder, and what reaches over borders is found."""
    deep = [f"/hot/{i % 97}/{i}" for i in range(5000)]
    df = spark.createDataFrame([(p,) for p in [*deep, "/hot", "/cold/x", "/hot-not", "/zz", None, None]], "path string")
    assert sorted(str(x.path) for x in T.outermost(df).collect()) == sorted(["/cold/x", "/hot-not", "/hot", "/zz", "None"])
    # Without the folder itself all stay; with the empty path nothing else does.
    assert T.outermost(df.where("path like '/hot/%'")).count() == 5000
    assert [x.path for x in T.outermost(df.where("path is not null").union(spark.createDataFrame([("",)], "path string"))).collect()] == [""]
    assert T.outermost(df.limit(0)).count() == 0


def test_one_shuffle(spark):
    df = spark.createDataFrame([(f"/a/{i}",) for i in range(100)], "path string")
    log = []
    plain = T.written
    try:
        T.written = lambda x: (log.append(x._jdf.queryExecution().executedPlan().toString()), plain(x))[1]
        T.outermost(df).collect()
    finally:
        T.written = plain
    assert len(log) == 1 and log[0].count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in log[0]


def owner(path, roots):
    return max((q for q in roots if path is not None and (path == q or path.startswith(f"{q}/"))), key=len, default=None)


@pytest.mark.parametrize(("files", "roots", "seed"), [(50, 8, 0), (800, 300, 1), (3000, 60, 2)])
def test_innermost_root(spark, files, roots, seed):
    r = random.Random(seed)
    paths = [random_path(r, 6) for _ in range(files)] + [None, "", "/", "relative/x"]
    chosen = {random_path(r, 4) for _ in range(roots)} | {"/a", "/a/a", paths[0]}
    df = spark.createDataFrame([(i, p, "old") for i, p in enumerate(paths + [paths[0]] * files)], "n int, path string, root string").repartition(8)
    rows = T.innermost_root(df, spark.createDataFrame([(q,) for q in [*chosen, *chosen, None]], "root string"))
    assert rows.columns == ["n", "path", "root"]
    got = sorted((x.n, x.path, x.root) for x in rows.collect())
    assert got == [(i, p, owner(p, chosen)) for i, p in enumerate(paths + [paths[0]] * files)]


def test_a_hundred_thousand_roots(spark):
    roots = spark.range(100_000).select(F.concat(F.lit("/w/"), (F.col("id") % 300).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("root"))
    files = spark.range(50_000).select((F.col("id") * 3).alias("id")).select("id", F.concat(F.lit("/w/"), (F.col("id") % 300).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit("/src/x.ts")).alias("path"))
    out = rel.owning_root(files, roots)
    assert out.where("not (root <=> if(id < 100000, substring_index(path, '/src', 1), null))").count() == 0 and out.count() == 50_000
    assert T.innermost_root(files.limit(0), roots).count() == 0 and T.innermost_root(files.limit(5), roots.limit(0)).where("root is null").count() == 5
