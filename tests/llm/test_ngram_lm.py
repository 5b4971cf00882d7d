import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import ngram_lm as G


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def texts(n=80, seed=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    out = [" ".join(r.choices(words, [1 / (i + 1) for i in range(200)], k=r.randint(0, 120))) for _ in range(n)]
    return [*out, None, "", " \n\t", "É A a b", "rare " * 4000, out[3], out[3]]


def brute(all_texts, held_out):
    """Scores from exact counts: what the filter's differ from by quantising only."""
    words, pairs = collections.Counter(), collections.Counter()
    split = [tokens(t) for t in all_texts]
    for i, t in enumerate(split):
        if not held_out(i):
            words.update(t)
            pairs.update(zip([None, *t[:-1]], t, strict=True))
    n, v = sum(words.values()), len(words)
    value = lambda c: G.VALUES[G.level(np.array([c]))[0]] if c else 0.0
    out = []
    for t in split:
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for a, b in zip([None, *t[:-1]], t, strict=True):
            c = value(pairs[a, b])
            score += math.log10(min(1.0, (c + G.SMOOTHING * (value(words[b]) + 1) / (n + v + 1)) / (max(value(words[a]), c) + G.SMOOTHING)))
        out.append((len(t), sum(words[w] > 0 for w in t), base, score))
    return n, out


def test_scores_match_brute_force(spark):
    data = texts()
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").withColumn("payload", F.lit(1))
    model = G.train(df.where("doc_id % 5 != 2"))
    n, want = brute(data, lambda i: i % 5 == 2)
    assert model.tokens == n
    ways = [{r.doc_id: r for r in G.score(df, model, limit).collect()} for limit in (G.MAX_BROADCAST_BYTES, 0)]
    off = 0
    for i, (size, known, base, score) in enumerate(want):
        a, b = (w[i] for w in ways)
        assert (a.n_tokens, a.n_known) == (size, known) and math.isclose(a.base_score, base, rel_tol=1e-9)
        assert math.isclose(a.score, b.score, rel_tol=1e-9) and (a.n_tokens, a.n_known, a.base_score) == (b.n_tokens, b.n_known, b.base_score)
        off += not math.isclose(a.score, score, rel_tol=0.02)
    assert off <= len(want) // 10  # false positives of the filter


def test_filter_counts_are_never_too_low():
    r = np.random.default_rng(0)
    h = np.unique(r.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    c = np.minimum(r.zipf(1.7, len(h)), 10**6).astype(np.int64)
    with np.errstate(over="ignore"):
        own = G.shard_of(h, 4)
        parts = {s: G.build_filter([(1, h[own == s], c[own == s]), (2, h[:0], c[:0])]) for s in range(4)}
        bloom = G.Filter(parts, 4)
        got, other = bloom.levels(h, 1), bloom.levels(r.integers(0, 1 << 63, 20_000, dtype=np.uint64), 1)
    assert (got >= G.level(c)).all() and (got == G.level(c)).mean() > 0.93 and (other > 0).mean() < 0.06
    assert (np.diff(G.VALUES) >= 0).all() and G.VALUES[1] == 1


def test_nothing_to_learn_or_to_score(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = G.train(df.limit(0))
    r = G.score(df, model).first()
    assert (r.n_tokens, r.n_known, r.base_score) == (3, 0, 0.0) and r.score <= 0
    assert G.score(df.limit(0), model).count() == 0 == G.score(df.limit(0), G.train(df), 0).count()
    with pytest.raises(ValueError, match="already has"):
        G.score(df.withColumn("Score", F.lit(1)), model)
    with pytest.raises(ValueError, match="already has"):
        G.score(df.withColumn("__ROW", F.lit(1)), model)


def test_scores_by_shard_are_the_same_and_write_little(spark):
    """Beyond what is broadcast, scores are the same, and less than three bytes are written for each of a text's."""
    import os

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    folder, size = spark.conf.get("spark.checkpoint.dir"), docs.selectExpr("sum(octet_length(text))").first()[0]
    model = G.train(docs)
    held = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)
    wanted = {r.doc_id: r for r in G.score(docs, model).drop("text").collect()}
    before = held()
    found = {r.doc_id: r for r in G.score(docs, model, 0).drop("text").collect()}
    assert held() - before < 3 * size
    assert found.keys() == wanted.keys()
    assert all(r[1:3] == wanted[i][1:3] and r.score == pytest.approx(wanted[i].score) and r.base_score == pytest.approx(wanted[i].base_score) for i, r in found.items())
