import random

import pytest
import xxhash

from tokenloom.llm import simhash as S
from tokenloom.llm.components import components


def brute_components(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in items:
        for j in items:
            if i < j and linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_components(spark):
    r = random.Random(1)
    for edges in ([], [(1, 1)], [(i, i + 1) for i in range(60)], [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)], [(0, i) for i in range(1, 50)]):
        nodes = {x for e in edges for x in e}
        want = brute_components(nodes, lambda a, b: (a, b) in set(edges) or (b, a) in set(edges))
        got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {n: root for n, root in want.items() if n != root}


def test_fingerprints():
    h = lambda s: xxhash.xxh64_intdigest(s, 42)
    assert S.fingerprint(None) == S.fingerprint(" \n\t") == 0 and S.fingerprint("Ab") == h(b"ab") and S.fingerprint("a  B") == h(b"a b")
    assert S.fingerprint("a b c") == h(b"a b c") and S.fingerprint("a b c d") == h(b"a b c") & h(b"b c d")
    assert S.fingerprint("É a\u00a0b") == h("É a\u00a0b".encode())
    long = " ".join(f"w{i % 997}" for i in range(3 * S.CHUNK))
    words = long.split()
    counts = [0] * 64
    for i in range(len(words) - 2):
        x = h(" ".join(words[i : i + 3]).encode())
        for b in range(64):
            counts[b] += x >> b & 1
    assert S.fingerprint(long) == sum(1 << b for b in range(64) if 2 * counts[b] > len(words) - 2)


def test_allocation():
    """Thresholds add up, and are the cheapest that do."""
    r = random.Random(0)
    for _ in range(50):
        costs = [sorted(r.random() for _ in range(4)) for _ in range(3)]
        best = min(costs[0][a] + costs[1][b] + costs[2][3 - a - b] for a in range(4) for b in range(4 - a))
        cost, ts = S.allocate(costs, 3)
        assert sum(t + 1 for t in ts) == 3 and abs(cost - best) < 1e-12


@pytest.mark.parametrize(("most", "hot"), [(2, 32), (2, 1), (1, 32), (1, 1)])
def test_links_match_brute_force(spark, most, hot):
    r = random.Random(most)
    fps = {0, (1 << 64) - 1} | {r.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:25]:
        for _ in range(6):
            x = base
            for b in r.sample(range(64), r.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
            fps.add(x ^ 1 << r.randrange(64))
    signed = sorted(S._signed(x) for x in fps)
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= most
    links = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most, hot).collect()
    # In crowded buckets a star's members are at most twice as far apart, over a fingerprint between them.
    assert all(((x.a ^ x.b) & (1 << 64) - 1).bit_count() <= (2 * most if hot == 1 else most) for x in links)
    got = brute_components(signed, lambda a, b, s={(x.a, x.b) for x in links} | {(x.b, x.a) for x in links}: (a, b) in s)
    assert got == brute_components(signed, near)


def test_rows(spark):
    body = " ".join(f"w{i}" for i in range(200))
    rows = [(7, body, 1), (3, body + " x", 1), (5, None, 2), (9, "", 3), (3, body + " x", 1), (None, body, 4), (None, "only null ids", 5), (8, "alone here now", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    out = [(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()]
    assert len(out) == len(rows)
    of = {(d, f): c for d, f, c in out}
    assert of[5, "0" * 16] == of[9, "0" * 16] == 5 and of[8, f"{S.fingerprint('alone here now'):016x}"] == 8
    assert of[None, f"{S.fingerprint(body):016x}"] == of[7, f"{S.fingerprint(body):016x}"]
    assert of[None, f"{S.fingerprint('only null ids'):016x}"] is None
    assert S.near_duplicates(df.limit(0)).count() == 0
    kept = S.keep_one(df).collect()
    linked = (S.fingerprint(body) ^ S.fingerprint(body + " x")).bit_count() <= 2
    want = [(3, body + " x"), (5, None), (None, "only null ids"), (8, "alone here now")] + ([] if linked else [(7, body)])
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)
    assert kept[0].asDict().keys() == {"doc_id", "text", "component_id"}
    with pytest.raises(ValueError, match="__row"):
        S.keep_one(df.withColumnRenamed("component_id", "__ROW"))


def test_a_row_without_id_links_others(spark):
    """Two fingerprints four bits apart, and between them one that only a row without id has."""
    far = 255 << 40
    prints = spark.createDataFrame([(1, 0), (None, 3), (2, 15), (None, far), (None, far + 1)], "doc_id long, fp long")
    out = {r.fp: (r.root, r.component_id) for r in S._components_of(prints, S.links).collect()}
    assert out[0] == out[3] == out[15] and out[0][1] == 1
    assert out[far] == out[far + 1] and out[far][1] is None


def test_similar_documents_are_found(spark):
    """Jaccard similarity of 0.8 on five-word shingles links, which is mostly beyond two bits; less does not."""
    r = random.Random(3)
    rows, similar = [], 0
    for i in range(40):
        words = [f"w{r.randint(0, 5000)}" for _ in range(300)]
        rows.append((2 * i, " ".join(words)))
        for at in range(5, 5 + 20 * (4 if i % 2 else 20), 20):
            if at < 300:
                words[at] = "new"
        rows.append((2 * i + 1, " ".join(words)))
    wide = lambda a, b: (lambda x, y: len(x & y) >= 0.8 * len(x | y))(*(set(S.shingle_hashes(t).tolist()) for t in (a, b)))
    want = {rows[k + 1][0] for k in range(0, 80, 2) if wide(rows[k][1], rows[k + 1][1])}
    assert len(want) == 20
    df = spark.createDataFrame([*rows, (90, None), (91, ""), (None, rows[0][1])], "doc_id long, text string")
    kept = sorted(x.doc_id for x in S.keep_similar(df).collect())
    assert kept == sorted([i for i, _ in rows if i not in want] + [90])
    assert len({x.doc_id for x in S.keep_one(df).collect()} & want) > 10


def test_the_tables_similar_documents_are_found(spark):
    """All pairs of sf0.001 by Jaccard similarity: what is kept is one of each group."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: set(S.shingle_hashes(t).tolist()) for i, t in rows}
    near = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    want = {root for root in brute_components([i for i, _ in rows], near).values()}
    kept = {x.doc_id for x in S.keep_similar(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert len(want) < len(rows) and len(want & kept) >= 0.9 * len(want) and kept == want


def test_fingerprints_find_near_copies_without_keys(spark, monkeypatch):
    """What two bits can find needs no keys; a large group of near copies is linked all the same."""
    r = random.Random(8)
    words = [f"w{r.randint(0, 9000)}" for _ in range(2000)]
    rows = [(i, " ".join([*words[:1990], *(f"x{i}" for _ in range(1))]), None) for i in range(120)] + [(500 + i, " ".join(f"z{i}{r.random()}" for _ in range(50)), None) for i in range(20)]
    monkeypatch.setattr(S, "shingle_keys", lambda hashes: [])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    kept = {x.doc_id for x in S.keep_similar(df).collect()}
    assert {i for i in kept if i >= 500} == set(range(500, 520)) and len(kept) <= 22


def test_tables_on_the_way_to_similar_texts_do_not_stay(spark):
    from tests.llm.test_line_dedup import left_behind

    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, "quite unlike the two"), (4, " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = []
    assert len(left_behind(spark, lambda: out.append(S.keep_similar(df)))) == 1
    assert sorted(r.doc_id for r in out[0].collect()) == [1, 3]
