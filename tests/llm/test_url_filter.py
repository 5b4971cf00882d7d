import random

import numpy as np
import pytest

from tokenloom.llm import url_filter as U
from tokenloom.llm.queries import URL_RULES


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("HTTP://Www.A.NET/x?y#z", "www.a.net", "/x"), (None, "", ""), ("no scheme/x", "", ""), ("a://b", "b", ""), ("a://b?q/x", "b", ""), ("a://b#f", "b", ""),
        ("a://b://c/d", "b:", "//c/d"), ("://É.net/p#q?r", "É.net", "/p"), ("", "", ""), ("x://a/b\nc?d", "a", "/b\nc"),
    ],
)
def test_parts(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "url string").select(U.host("url").alias("h"), U.path("url").alias("p"))
    assert df.first() == (host, path)


def test_rules(spark):
    urls = {"x://a.net/": ("net/", "block"), "x://a.net": (None, None), "x://www.example.net/en/x": ("example.net/en/", "allow"), "x://example.com/de/": ("example.com/de/", "block"), "x://myexample.com/de/": (None, None), "x://a.org/fr/1": ("org/fr/", "allow"), "x://a.org/en/": (None, None)}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in U.judge(pages, URL_RULES, spark.createDataFrame([], "key string")).collect()}
    assert out == {i: (rule, verdict or "allow") for i, (rule, verdict) in enumerate(urls.values())}


def test_cascade_is_exact():
    r = np.random.default_rng(0)
    for n, listed in ((0, 0.5), (1, 1.0), (1, 0.0), (3000, 0.0), (3000, 1.0), (5000, 0.01), (5000, 0.5), (5000, 0.99)):
        h1, h2 = (r.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        own = r.random(n) < listed
        with np.errstate(over="ignore"):
            cascade = U.Cascade.from_bytes(U.Cascade.build(h1, h2, own).to_bytes())
            assert (cascade.contains(h1, h2) == own).all()


def test_both_ways_agree_with_a_set(spark, monkeypatch):
    monkeypatch.setattr(U, "SHARD_KEYS", 300)
    r = random.Random(0)
    keys = [f"h{r.randint(0, 900)}" for _ in range(3000)] + [None, "", "hot"] * 400
    df = spark.createDataFrame(list(enumerate(keys)), "n long, key string")
    listed = {f"h{i}" for i in range(0, 900, 3)} | {"", "not there"}
    cascades, shards = U.build_cascades(df, spark.createDataFrame([(k,) for k in sorted(listed)], "key string"))
    assert shards > 1
    for limit in (1 << 20, 0):
        out = {x.n: x.listed for x in U.mark_listed(df, "key", cascades, shards, limit).collect()}
        assert out == {i: (k or "") in listed for i, k in enumerate(keys)}


def test_repeats_nulls_and_nothing(spark):
    pages = spark.createDataFrame([(1, "a://x.com/p", "h"), (1, "a://x.com/p", "h"), (None, None, None)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("x.com/p",), ("x.com/p",), (None,)], "key string")
    out = U.judge(pages, URL_RULES, listed).collect()
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in out) == [(0, "", "block"), (1, "x.com", "block"), (1, "x.com", "block")]
    assert U.judge(pages.limit(0), URL_RULES, listed).count() == 0


@pytest.mark.parametrize("name", ["listed", "H1", "h2", "key_", "Shard"])
def test_names_that_would_clash_are_refused(spark, name):
    keys = spark.createDataFrame([("x.com/p",)], "key string")
    cascades, shards = U.build_cascades(keys, keys)
    with pytest.raises(ValueError, match="already has"):
        U.mark_listed(keys.withColumn(name, keys.key), "key", cascades, shards)
