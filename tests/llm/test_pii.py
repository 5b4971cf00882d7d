import hashlib
import random
import re
from collections import defaultdict

import pytest
import regex

from tokenloom.llm import pii as P

# The contract's patterns as they are given.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def sound(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def seeds(text):
    return sorted((m.start(), P.KINDS.index(k), m.end(), k) for k, p in GIVEN.items() for m in re.finditer(p, text) if sound(k, m[0]))


def contexts(text, kind, pattern):
    """(start, end, value, patterns) of a kind's matches."""
    found = list(regex.finditer(pattern, text))
    for i, m in enumerate(found):
        before = text[found[i - 1].end() if i else 0 : m.start()].lower()[-P.REACH :]
        behind = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)].lower()[: P.REACH]
        b = regex.search(r"(?:[\p{L}\p{N}]++[^\p{L}\p{N}]*+){1,2}$", before)
        f = regex.match(r"[^\p{L}\p{N}]*+[\p{L}\p{N}]++", behind)
        b, f = (re.sub(r"\s+", " ", x[0]) if x else "" for x in (b, f))
        one = {b + "_"} if b else set()
        if b and f:
            one.add(regex.search(r"[\p{L}\p{N}]++[^\p{L}\p{N}]*+$", b)[0] + "_" + f)
        yield m.start(), m.end(), m[0].lower(), one


def brute(texts, rules=P.Rules()):
    """For each text its spans (start, place of the kind, end, kind, seed)."""
    spans, at, marked = [seeds(t or "") for t in texts], defaultdict(dict), []
    for n, text in enumerate(t or "" for t in texts):
        own = {(s, e, k) for s, _, e, k in spans[n]}
        for kind, p in GIVEN.items():
            for s, e, v, cs in contexts(text, kind, p):
                for c in cs if (s, e, kind) in own else ():
                    at[c][v] = min(kind, at[c].get(v) or "~")
        for s, e, v, cs in contexts(text, "candidate", P.CANDIDATE):
            if not any(a < e and s < b for a, b, _ in own):
                marked.append((n, s, e, v, cs))
                for c in cs:
                    at[c].setdefault(v, None)
    at = {c: vs for c, vs in at.items() if len(vs) > 1}
    known = {(v, k): 1.0 for vs in at.values() for v, k in vs.items() if k}
    scores = dict(known)
    for turn in range(rules.rounds):
        confidence = {}
        for c, vs in at.items():
            for k in P.KINDS:
                s = sum(scores.get((v, k), 0) for v in vs)
                if s:
                    confidence[c, k] = s / (len(vs) + 1)
        if turn < rules.rounds - 1:
            scores = defaultdict(float, known)
            seeded = {v for v, _ in known}
            for c, vs in at.items():
                for v, kind in vs.items():
                    for k in P.KINDS if kind is None and v not in seeded else ():
                        if (c, k) in confidence:
                            scores[v, k] = max(scores[v, k], confidence[c, k])
    fine = {(c, k): x for (c, k), x in confidence.items() if x >= rules.confidence and sum(kind == k for kind in at[c].values()) >= rules.seeds}
    out = [[(*s, True) for s in own] for own in spans]
    for n, s, e, _, cs in marked:
        best = [(-x, P.KINDS.index(k), k) for (c, k), x in fine.items() if c in cs]
        if best:
            _, place, k = min(best)
            out[n].append((s, place, e, k, False))
    return [sorted(o) for o in out]


def row(doc_id, spans):
    text = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in s)
    own = [s for s in spans if s[4]]
    return (doc_id, *(sum(s[3] == k for s in own) for k in P.KINDS), hashlib.sha256(text(own).encode()).hexdigest(), text(spans), len(spans) - len(own))


def check(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, kind string, row int")
    got = sorted((tuple(r) for r in P.find(df).collect()), key=str)
    assert got == sorted((row(i, s) for (i, _), s in zip(docs, brute([t for _, t in docs]), strict=True)), key=str)
    return got


PEOPLE = [f"my mail is user{i}@host{i % 7}.example.com now. Call me on +44 20 7946 0{i:03d} or so. Card number: {n} please." for i, n in enumerate(["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "4242424242424242", "6011000000000004"])]
HIDDEN = ["Hello, my mail is user77@localhost now.", "Call me on 020 7946 0999 or so.", "CARD   number: 1234-5678 please", "The year 2024 was my mail, and 5 more."]


def test_patterns_of_seeds_find_the_unseen(spark):
    got = {r[0]: r for r in check(spark, list(enumerate(PEOPLE + HIDDEN)))}
    assert got[5][6] == "email:18:34" and got[6][6] == "phone:11:24" and got[7][6] == "card:15:24"
    assert got[8][6] == "" and got[8][7] == 0  # no other place is touched
    assert got[5][5] == hashlib.sha256(b"").hexdigest()  # seeds stay as they are


def test_odd_rows(spark):
    docs = [(None, "a@b.c"), (1, None), (1, ""), (2, "a@b.c"), (2, "a@b.c"), (3, "é\U0001f600 a@b.c,\n1.2.3.4 +1 234 567 890"), (4, "@.@..+1+()+"), (5, "no digits")]
    got = check(spark, docs)
    assert len(got) == 8 and ("email:3:8" in next(r[6] for r in got if r[0] == 3))
    assert P.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    spans = P.extract(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(r.kind == "email" for r in spans) == 4 and {r.m for r in spans if r.kind == "email"} == {"a@b.c"}


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    r = random.Random(seed)
    bits = ["a", "b.c", "@", "@x.y", ".", "1", "12", "255", "256", "007", ".1.2.3", "+", "+1", " ", " ", "-", "(", ")", "4111111111111111", "4111 1111 1111 1111", "\n", "é", "😀", "%", "mail ", "is: ", "to ", "x9", "#1"]
    check(spark, [(i, "".join(r.choice(bits) for _ in range(r.randrange(120)))) for i in range(150)])


def test_matches_as_given():
    r = random.Random(9)
    signs = "ab1209.@+-% ()é_"
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randrange(60)))
        for kind, p in GIVEN.items():
            # Python has no \G: a search from the end of each match stands for it.
            mine, at = [], 0
            free = P.PATTERNS[kind].replace(r"\G|", "")
            while True:
                here = regex.compile(free.replace("(?:(?<!", "(?:(?<!", 1)).search(text, at)
                if kind == "email":
                    glued = regex.compile(free[free.index(")") + 2 :]).match(text, at)
                    here = glued or here
                if not here:
                    break
                mine.append(here.span())
                at = here.end()
            assert mine == [m.span() for m in re.finditer(p, text)], (kind, text)


def test_long_texts(spark):
    """Runs of any length neither overflow a stack nor take the square of their length."""
    n = 200_000
    docs = [(0, "1" * n), (1, "a" * n + "@"), (2, "a@" + "b." * n), (3, "1." * n), (4, "+1" + "(" * n), (5, "1 " * n), (6, "0" * n + ".1.2.3"), (7, "x@y.z " * 3_000 + "user@localhost")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: r for r in P.find(df).collect()}
    assert got[7][1] == 3_000 and got[2][1] == 1 and got[3][2] == n // 4 and got[6][2] == 1 and got[0][3] == 0


def test_only_built_in_functions(spark):
    df = spark.createDataFrame([(1, PEOPLE[0])], "doc_id long, text string")
    plan = P.find(df)._jdf.queryExecution().toString() + P.matches(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
