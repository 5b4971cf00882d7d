import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import columns as C
from tokenloom.operators import relations as rel
from tokenloom.plans import registry as R


def counted(spark, rows):
    return spark.createDataFrame(rows, "path string, tokens bigint")


def slices(df):
    return [(r.label, r.tokens, r.files) for r in df.orderBy("rank").collect()]


def test_folders(spark):
    rows = [("/repo/src/a.ts", 60), ("/repo/src/deep/b.ts", 20), ("/repo/docs/c.md", 20)]
    assert slices(rel.by_folder(counted(spark, rows))) == [("src", 80, 2), ("docs", 20, 1)]
    out = rel.by_folder(counted(spark, [("/repo/README.md", 30), ("/repo/src/a.ts", 70)])).collect()
    assert {r.label: r.tokens for r in out} == {"(root)": 30, "src": 70} and abs(sum(r.share for r in out) - 1) < 1e-9


def test_the_rest_is_folded(spark):
    rows = [(f"/r/f{i:02}/a.ts", 100 - i) for i in range(13)]
    out = slices(rel.by_folder(counted(spark, rows)))
    assert len(out) == 9 and out[-1] == ("Other", sum(100 - i for i in range(8, 13)), 5)
    named = slices(rel.by_folder(counted(spark, [*rows, ("/r/Other/x", 1000)])))
    assert named[0] == ("Other", 1000, 1) and named[-1][0] == "Other" and named[-1][2] == 6


def test_nothing_and_zero(spark):
    assert rel.by_folder(counted(spark, [])).count() == 0
    assert [r.share for r in rel.by_language(counted(spark, [("a.ts", 0), ("b.py", 0)])).collect()] == [0.0, 0.0]


def test_languages_merge(spark):
    assert slices(rel.by_language(counted(spark, [("a.ts", 10), ("b.tsx", 10), ("c.mts", 10)]))) == [("TypeScript", 30, 3)]


def test_order_of_ties(spark):
    assert [r.path for r in rel.largest_first(counted(spark, [("b", 10), ("a", 10), ("c", 20)])).collect()] == ["c", "a", "b"]
    shown = counted(spark, [("b", 10), ("a", 10), ("C", 20)]).withColumn("display", F.col("path"))
    assert [r.path for r in rel.listing(shown, "path").collect()] == ["a", "b", "C"]
    assert [r.path for r in rel.listing(shown, "path", False, " c ").collect()] == ["C"]


def root_of(spark, paths):
    return rel.common_root(spark.createDataFrame([(p,) for p in paths], "path string")).first()["root"]


def test_common_roots(spark):
    assert root_of(spark, ["C:\\repo\\src\\a.ts", "C:\\repo\\src\\b\\c.ts"]) == ["C:", "repo", "src"]
    assert root_of(spark, ["/a/b.ts", "/c/d.ts"]) == [] == root_of(spark, [])
    assert root_of(spark, ["/a/b/c.ts"]) == ["a", "b"]


@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "c"]), min_size=1, max_size=5), min_size=1, max_size=6))
@settings(max_examples=5, deadline=None)
def test_common_root_is_the_longest_prefix(spark, paths):
    dirs = [p[:-1] for p in paths]
    want = dirs[0]
    for d in dirs[1:]:
        n = 0
        while n < min(len(want), len(d)) and want[n] == d[n]:
            n += 1
        want = want[:n]
    assert root_of(spark, ["/" + "/".join(p) for p in paths]) == want


def test_display_paths(spark):
    df = spark.createDataFrame([("/repo/src/a.ts",), ("/elsewhere/a.ts",), ("\\repo\\src\\a.ts",)], "path string")
    root = F.lit(["repo"])
    assert [r[0] for r in df.select(C.display_path("path", root)).collect()] == ["src/a.ts", "elsewhere/a.ts", "src/a.ts"]


def test_selections(spark):
    def kept(*paths):
        return sorted(r.path for r in rel.dedupe_selection(spark.createDataFrame([(p,) for p in paths], "path string")).collect())

    assert kept("/repo/src", "/repo/src/a.ts", "/repo/README.md") == ["/repo/README.md", "/repo/src"]
    assert kept("/a", "/a", "/a") == ["/a"] and kept() == []
    assert kept("/repo/src-gen", "/repo/src") == ["/repo/src", "/repo/src-gen"]


def test_owning_roots(spark):
    files = spark.createDataFrame([("/a/b/c.ts",), ("/a/x.ts",), ("/ab/y",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    assert {r.path: r.root for r in rel.owning_root(files, roots).collect()} == {"/a/b/c.ts": "/a/b", "/a/x.ts": "/a", "/ab/y": None}


def test_exactness_of_a_run(spark):
    df = spark.createDataFrame([], "tokens bigint, exact boolean")
    assert rel.totals(df, exact="exact").first() == (0, True)
    assert rel.totals(spark.createDataFrame([(1, True), (2, False)], "tokens bigint, exact boolean"), exact="exact").first() == (3, False)


def test_running_total_over_one_sequence(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("i"), (F.col("id") * 7 % 500 + 1).alias("tokens"))
    out = {r.i: r.running_total for r in rel.running_total(df, ["i"]).collect()}
    assert out == {i: (i + 1) * (i + 2) // 2 for i in range(500)}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_running_total_of_wide_rows(spark, adaptive):
    """More columns than key and tokens, many partitions, ties and nulls: as one after the other."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = spark.range(0, 60_000, 1, 8).select(
            F.expr("pmod(xxhash64(id), 20000)").alias("k"), F.expr("if(id % 97 = 0, null, id % 13)").alias("tokens"), F.concat(F.lit("/p/"), "id").alias("path"), F.expr("array(id)").alias("parts")
        )
        rows = rel.running_total(wide, ["k"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(rows) == 60_000
    total = 0
    for r in sorted(rows, key=lambda r: (r.k, r.tokens is not None, r.tokens or 0, r.path)):
        total += r.tokens or 0
        assert r.running_total == total


@pytest.mark.parametrize("most", [1000, 0])
def test_owning_root_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(rel, "BROADCAST_ROOTS", most)
    files = spark.createDataFrame([("/a/b/c.txt",), ("/a/x",), ("/ab/c",), ("/z",), ("/a/b/c.txt",), (None,)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/a",), ("/z",), (None,)], "root string")
    got = sorted(((r.path or "", r.root) for r in rel.owning_root(files, roots).collect()), key=str)
    assert got == sorted([("/a/b/c.txt", "/a/b"), ("/a/b/c.txt", "/a/b"), ("/a/x", "/a"), ("/ab/c", None), ("/z", "/z"), ("", None)], key=str)


def test_running_total_of_nothing(spark):
    assert rel.running_total(spark.createDataFrame([], "k int, tokens long, path string"), ["k"]).collect() == []


def test_cache(spark):
    cache = spark.createDataFrame([("m", "/a", 1, 5, True), ("n", "/a", 1, 6, False), ("m", "/a/b", 1, 7, True)], "model_id string, path string, mtime bigint, count bigint, exact boolean")
    work = spark.createDataFrame([("m", "/a", 1), ("m", "/a", 2), ("m", "/c", 1)], "model_id string, path string, mtime bigint")
    assert [(r["count"], r["exact"]) for r in rel.cache_hits(work, cache).collect()] == [(5, True)]
    assert rel.cache_misses(work, cache).count() == 2
    changed = spark.createDataFrame([("/a",)], "path string")
    assert [r.path for r in rel.cache_without(cache, changed).collect()] == ["/a/b"]
    new = spark.createDataFrame([("m", "/a", 3, 9, True)], cache.schema)
    assert sorted((r.model_id, r.path, r["count"]) for r in rel.cache_with(cache, new).collect()) == [("m", "/a", 9), ("m", "/a/b", 7), ("n", "/a", 6)]


def test_registry(spark):
    models, aliases = R.models(spark), R.aliases(spark)
    assert len(R.MODELS) == 71 and len(R.ALIASES) == 41 and len(R.LANGUAGES) == 104 and len(set(R.LANGUAGES.values())) == 75 and len(R.BINARY_EXTENSIONS) == 55
    kinds = [m.kind for m in R.MODELS]
    assert [kinds.count(k) for k in ("tiktoken", "hf", "tiktokenModel", "heuristic")] == [19, 30, 3, 19]
    assert rel.registry_violations(models, aliases).count() == 0
    bad = R.models(spark, [R.MODELS[0], R.MODELS[0], R.BY_ID["o3"].__class__("x", "X", "Other", "heuristic", None, None, 20.0, 10, 5), R.BY_ID["gpt-4o"]])
    found = {r.rule for r in rel.registry_violations(bad, spark.createDataFrame([("gpt-4o", "gone")], "alias string, model_id string")).collect()}
    assert found == {"duplicate id", "implausible limit", "scattered provider", "alias of no live model", "alias hides a live model", "implausible ratio"}


def test_starting_model():
    assert R.initial_model("gpt-4", "o3") == (R.BY_ID["gpt-4-turbo"], "gpt-4-turbo")
    assert R.initial_model(None, "o3-mini") == (R.BY_ID["o4-mini"], None)
    assert R.initial_model("nope", "nope") == (R.default_model(), None)


def test_buffers_stand_for_what_is_stored(spark):
    texts = spark.createDataFrame([("/a", "one", 1), ("/b", "two", 2), ("/c", None, 3), (None, "x", 4)], "path string, text string, n int")
    buffers = spark.createDataFrame([("/a", "open"), ("/b", None), ("/c", "c"), ("/d", "none"), (None, "y"), ("/a", "older")], "path string, text string")
    out = rel.overlaid(texts, buffers)
    assert out.columns == texts.columns
    assert sorted(tuple(r) for r in out.collect() if r.path) == [("/a", "open", 1), ("/b", "", 2), ("/c", "c", 3)]
    assert [r.text for r in out.where("path is null").collect()] == ["x"] and rel.overlaid(texts, buffers.limit(0)).count() == 4
