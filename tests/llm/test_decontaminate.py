import random

import numpy as np

from tokenloom.llm import decontaminate as D


def data(seed=0, n=150):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    said = lambda k: " ".join(r.choices(vocabulary, weights, k=k))
    items = [(i, said(r.randint(12, 70)).capitalize() + ". " + said(5) + ".") for i in range(30)]
    docs, want = [], set()
    for i in range(n):
        text = said(r.choice([5, 60, 400, 2500]))
        if i % 5 == 0:
            k, body = r.choice(items)
            words = body.split(" ")
            if i % 10 == 0:  # a paraphrase: some words are others, some are new
                for _ in range(len(words) // 10):
                    words[r.randrange(len(words) - 6)] = r.choice(vocabulary)
                words.insert(len(words) // 2, r.choice(vocabulary))
            text = f"{text}\n{' '.join(words)} {said(30)}"
            want.add((i, k))
        docs.append((i, text))
    return docs, items, want


def test_leaks_are_found_and_nothing_else(spark):
    docs, items, want = data()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = {(r.doc_id, r.item_id) for r in D.pairs(d.withColumnRenamed("doc_id", "doc_id"), b).collect()}
    assert out == want
    kept = D.reject(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_the_tables_leaks_are_those_of_a_brute_force(spark):
    """Each item against each window of each document by longest common subsequence, with no gate before it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, D.words_of(r.text), D.answer_of(r.text)) for r in benchmark.collect() if D.words_of(r.text)]
    want = set()
    for r in docs.collect():
        words = D.words_of(r.text)
        for item_id, own, said in items:
            size = 1 << max(3, (len(own) - 1).bit_length())
            for start in range(0, max(1, len(words) - size), size):
                window = words[max(0, start - size // 2) : min(start + 2 * size, len(words)) + size // 2]
                if D.common_subsequence(own, window) >= 0.75 * len(own) and (not said or D.common_subsequence(said, window) >= 0.5 * len(said)):
                    want.add((r.doc_id, item_id))
    found = {(r.doc_id, r.item_id) for r in D.pairs(docs, benchmark).collect()}
    assert found == want and want


def test_an_item_of_any_length_is_one(spark):
    r = random.Random(2)
    long = [f"w{r.randint(0, 4000)}" for _ in range(5000)]
    item = " ".join(long) + ". The answer is here."
    half = " ".join(long[:2500])
    docs = spark.createDataFrame([(1, "before " + item + " after"), (2, half + " The answer is here."), (3, "none")], "doc_id long, text string")
    found = D.pairs(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.item_id) for x in found] == [(1, 7)]


def lcs(a, b):
    rows = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1, j + 1] = rows[i, j] + 1 if x == y else max(rows[i, j + 1], rows[i + 1, j])
    return rows[-1, -1]


def test_common_subsequence():
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randint(0, 80))] for _ in range(2))
        assert D.common_subsequence(a, b) == lcs(a, b)


def test_randomised_svd_finds_the_leading_directions(spark):
    r = np.random.default_rng(0)
    a = np.array([[int(x) for x in row] for row in r.random((200, 12)) < np.linspace(0.9, 0.05, 12)])
    passages = spark.createDataFrame([(np.flatnonzero(row).tolist(),) for row in a[:150]], "ids array<int>")
    found = D.randomised_svd(passages, [np.flatnonzero(row) for row in a[150:]], np.ones(12), rank=3)
    want = np.linalg.svd(a.astype(float))[2][:3].T
    assert np.allclose(np.abs(found.T @ want), np.eye(3), atol=1e-6)


def test_answers_blocks_and_odd_rows(spark, monkeypatch):
    body = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa"
    items = spark.createDataFrame([(1, body, "quebec romeo"), (2, body, None), (None, body, None), (3, None, None), (4, "...", None), (5, body + " sierra", "lima")], "item_id long, text string, reply string")
    docs = spark.createDataFrame([(1, f"so {body} it goes", 0, "l"), (1, f"so {body} it goes", 0, "l"), (None, f"{body.upper()} quebec romeo", 0, "l"), (3, None, 0, "l"), (4, "", 0, "l"), (5, "alpha " * 50_000, 0, "l")], "doc_id long, text string, item_id int, cosine string")
    monkeypatch.setattr(D, "ITEMS_IN_BLOCK", 1)
    out = sorted((r.doc_id or 0, r.item_id) for r in D.pairs(docs, items, "reply").collect())
    assert out == [(0, 1), (0, 2), (0, 5), (1, 2), (1, 2), (1, 5), (1, 5)]
    assert D.pairs(docs, items.limit(0)).count() == 0 and D.pairs(docs.limit(0), items).count() == 0


def test_every_leak_of_thousands_of_items_is_found(spark):
    """Against brute force by common subsequence: more items than the projection has directions."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(9000)]
    topic = vocabulary[:60]
    items = [(i, " ".join(r.choices(topic, k=20) if i % 5 == 0 else r.choices(vocabulary, k=r.randint(12, 40)))) for i in range(2500)]
    docs, want = [], set()
    for i in range(300):
        k, body = items[r.choice([x for x in range(2500) if x % 5])]
        before, after = (" ".join(r.choices(topic, k=r.randint(0, 90))) for _ in range(2))
        docs.append((i, f"{before} {body} {after}"))
        want.add((i, k))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = {(x.doc_id, x.item_id) for x in D.pairs(d, b).collect()}
    assert want <= out
    for i, k in out - want:
        assert lcs(D.words_of(items[k][1]), D.words_of(docs[i][1])) >= 0.75 * len(D.words_of(items[k][1]))


def test_the_projection_is_fitted_on_every_distinct_text(spark):
    """However many documents there are: of 9,000 texts, one in two given twice, all passages count once."""
    rows = [(i, f"word{i % 7} other{i} word{i % 5}") for i in range(9000)]
    docs = spark.createDataFrame([*rows, *rows[::2], (None, None)], "doc_id long, text string")
    number = {b"word3": 0, b"other8999": 1}
    got = sorted(tuple(sorted(x.ids)) for x in D._passages(docs, number, 3).collect())
    assert got == sorted(tuple(own) for i in range(9000) if (own := [0] * ((i % 7 == 3) + (i % 5 == 3)) + [1] * (i == 8999)))


def paraphrased(seed=7, n=40):
    """Items in documents that say a quarter to a half of their words otherwise, or elsewhere, and keep the answer."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(4000)]
    said = lambda k: r.choices(vocabulary, [1 / (i + 5) for i in range(4000)], k=k)
    items, docs, want = [], [], set()
    for i in range(n):
        body, answer = r.sample(vocabulary, r.randint(18, 50)), r.sample(vocabulary, r.randint(4, 8))
        items.append((i, f"{' '.join(body)}. {' '.join(answer)}."))
        told = list(body)
        for at in r.sample(range(len(body)), len(body) * r.choice([25, 35, 50]) // 100):
            if i % 3 == 0 and at + 2 < len(told):  # moved by a few places
                told.insert(at + r.randint(1, 2), told.pop(at))
            else:
                told[at] = r.choice(vocabulary)
        docs.append((i, " ".join([*said(r.randint(0, 200)), *told, *answer, *said(r.randint(0, 200))])))
        want.add((i, i))
    docs += [(1000 + i, " ".join(said(300))) for i in range(100)]
    return items, docs, want


def test_paraphrases_are_found_by_cosine(spark, monkeypatch):
    items, docs, want = paraphrased()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in D.pairs(d, b).collect()}
    assert len(want & set(found)) >= 0.9 * len(want) and not set(found) - want
    index = D.build(d, next(D._items(b, None)))
    latent = {index.items[i].item_id for c in index.classes if c.vectors is not None for i in c.members}
    assert len(latent) >= 0.9 * len(items)  # the projection finds them, not whole vectors
    # Without directions of any use, what they alone can find is lost.
    monkeypatch.setattr(D, "randomised_svd", lambda passages, own, weight, rank=0, times_own=1.0: np.eye(len(weight), 1)[:, :0].reshape(len(weight), 0))
    monkeypatch.setattr(D, "MIN_KEPT", -1.0)
    assert not {(r.doc_id, r.item_id) for r in D.pairs(d, b).collect()} & want


def test_recall_with_thousands_of_items(spark):
    """Five thousand items, far more than directions: every leak by brute force over all pairs that share enough words."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(6000)]
    items = [(i, " ".join(r.choices(vocabulary[: 300 if i % 4 == 0 else 6000], k=r.randint(10, 45)))) for i in range(5000)]
    docs = []
    for i in range(150):
        words = items[r.randrange(5000)][1].split(" ")
        for _ in range(len(words) // r.choice([5, 8, 100])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        docs.append((i, " ".join([*r.choices(vocabulary, k=r.randint(0, 60)), *words, *r.choices(vocabulary, k=r.randint(0, 60))])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in D.pairs(d, b).collect()}
    own = [(k, D.words_of(t), set(D.words_of(t))) for k, t in items]
    want = set()
    for i, text in docs:
        words = D.words_of(text)
        there = set(words)
        for k, w, distinct in own:
            if len(distinct & there) >= 0.5 * len(distinct) and D.common_subsequence(w, words) >= 0.75 * len(w):
                want.add((i, k))
    assert len(want) > 100 and len(want & found) >= 0.9 * len(want)
