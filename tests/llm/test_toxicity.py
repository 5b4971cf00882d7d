import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import toxicity as X

BAD = ["idiot", "moron", "scum"]


def corpus(spark, n=400, seed=0):
    r = random.Random(seed)
    common = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = [r.choice(common) for _ in range(r.randint(5, 80))]
        toxic = int(i % 4 == 0)
        if toxic:
            words[r.randrange(len(words))] = r.choice(BAD)
            # Toxic texts often name one group: the bias that swapping is to undo.
            if r.random() < 0.8:
                words.insert(0, "muslims")
        elif r.random() < 0.03:
            words.insert(0, "christians")
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"), rows


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels, rows = corpus(spark)
    return X.fit(docs, labels, F.col("doc_id") % 3 != 2), docs, rows


def test_held_out_rows(learned):
    model, docs, rows = learned
    out = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    held = [(out[i] >= X.THRESHOLD, t == 1) for i, _, t in rows if i % 3 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.97 and all(0 <= s <= 1 for s in out.values())


def test_naming_a_group_alone_changes_little(spark, learned, monkeypatch):
    model = learned[0]
    text = "word1 word2 {} word3"
    score = lambda m, t: m.score(t, {})
    named = [score(model, text.format(g)) for g in ("muslims", "christians", "jews")]
    assert max(named) - min(named) < 0.1 and max(named) < X.THRESHOLD
    assert score(model, text.format("idiot")) > 0.5
    monkeypatch.setattr(X, "swaps", lambda text: iter(()))
    docs, labels, _ = corpus(spark)
    w = {}
    for strength in (0.0, 4.0):  # the same fit with and without the penalty
        rows = [np.array([0, 1]), np.array([0]), np.array([2]), np.array([2, 3])] * 20
        y = np.array([1.0, 1.0, 0.0, 0.0] * 20)
        w[strength] = X.fit_vectors(rows, y, [(np.array([0]), np.array([3]))], 4, counterfactual=strength)[0]
    assert abs(w[4.0][0] - w[4.0][3]) < 0.2 * abs(w[0.0][0] - w[0.0][3])


def test_swaps():
    out = list(X.swaps("Nice women here. No names.\nA man came"))
    assert ("sie kam", "er kam") in list(X.swaps("Sie kam")) and ("les femmes", "les hommes") in list(X.swaps("Les femmes"))
    assert ("nice women here.", "nice men here.") in out and ("a man came", "a woman came") in out and len(out) == 2
    assert list(X.swaps("human womankind")) == []


def test_the_tables_texts_hold_swaps(spark):
    """The penalty acts on the given tables too: they hold words that tell a gender, though no group's name."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = X.fit(docs, labels)
    assert model.swaps > 20
    told = [sum(model.weights.get(f, 0.0) for f in X.features_of(w)) for w in ("he", "she", "they")]
    assert max(told) - min(told) < 0.2


def test_swaps_are_counted_by_what_they_change(spark):
    docs = spark.createDataFrame([(1, "He came. He came"), (2, "she said he is a moron")], "doc_id long, text string")
    rows = docs.select("text", F.col("doc_id").cast("int").alias("label"))
    at = {"he": 0, "she": 1, "they": 2, "moron": 3}
    *_, swapped, times = X._vectors(rows.withColumn("label", F.lit(0)), at)
    seen = {(tuple(a.tolist()), tuple(b.tolist())): int(n) for (a, b), n in zip(swapped, times, strict=True)}
    # In the second text "he" to "she" brings nothing new, and the other way round.
    assert seen == {((0,), (1,)): 2, ((0,), (2,)): 3, ((0,), ()): 1, ((1,), ()): 1, ((1,), (2,)): 1}


def test_fit_is_the_same_each_time(spark, learned):
    docs, labels, _ = corpus(spark)
    again = X.fit(docs.repartition(3), labels, F.col("doc_id") % 3 != 2)
    assert again.weights.keys() == learned[0].weights.keys() and abs(again.bias - learned[0].bias) < 1e-6


def test_odd_rows(spark, learned):
    model = learned[0]
    docs = spark.createDataFrame([(1, None, "x", 1.0), (2, "", "x", 1.0), (None, "idiot " * 50_000, "x", 1.0), (2, "", "x", 1.0)], "doc_id long, text string, lang string, label double")
    out = [(r.doc_id, r.score) for r in X.score(docs, model).collect()]
    assert len(out) == 4 and len({s for i, s in out if i in (1, 2)}) == 1 and dict(out)[None] > 0.5
    kept = X.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3
    with pytest.raises(ValueError, match="already has"):
        X.score(docs, model, "LANG")
    none = X.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert X.score(docs, none).where("score < 0.3").count() == 4
    one_kind = X.fit(docs, spark.createDataFrame([(1, 0), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int"))
    assert X.score(docs, one_kind).where("score < 0.3").count() == 4
    assert X.score(docs.limit(0), model).count() == 0


def test_any_label_above_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(i, "vile rotten words" if i % 2 else "kind gentle words") for i in range(40)], "doc_id long, text string")
    odd = spark.createDataFrame([(i, i % 2 * (1 + i % 3) - (i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")  # -1, 0, 1, 2, 3
    plain = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    one, two = (X.fit(docs, labels) for labels in (odd, plain))
    assert one.weights == two.weights and one.bias == two.bias
