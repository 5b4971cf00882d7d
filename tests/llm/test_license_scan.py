import re

import pytest

from tokenloom.llm import license_scan as L


def test_automata():
    a = L.Automaton("[[this {{1,3}} is]] free under the [[new]] x license")
    ok = lambda t: a.find(L.words_of(t)) is not None
    assert ok("free under the x license") and ok("Free, under THE new X license!") and ok("this big old thing is free under the x license")
    assert not ok("free under a x license") and not ok("free under the very new x license") and not ok("free under the x") and not ok("")
    assert a.find(L.words_of("so this y is free under the x license now")) == (1, 9)  # from the optional lead on
    assert L.Automaton("[[a]] {{0,2}} b").find([b"q", b"w", b"e", b"b"]) == (1, 4)
    for bad in ("[[a", "[[a]]", ""):
        with pytest.raises(ValueError):
            L.Automaton(bad)


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts = [i for p, _ in L.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None)


def test_counts_match_brute_force(spark):
    texts = [
        "Released under the MIT License.", "MIT\nlicense mit license MIT-License", "É mit  licenseÉ", None, "", "Apache License the GNU General Public License general public license",
        "Licensed under CC BY-NC 4.0.", "x" * 100_000 + " mit license " + "mit license " * 5_000, "mit", "general public", "no licence",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'x' as labels")
    out = {r.doc_id: r for r in L.scan(df).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == brute(t)
        assert 0 <= r.score <= 1
    assert (out[0].labels, out[0].score) == ("mit", 1.0) and (out[1].labels, out[1].score) == ("mit", 0.5) and out[5].base_labels == "apache,gpl"
    assert (out[6].base_labels, out[6].labels, out[6].score) == ("", "cc-by-nc", 1.0) and out[3].labels == out[4].labels == ""
    assert out[0].spans[0].asDict() == {"label": "mit", "start": 0, "end": 5}
    assert L.scan(df.limit(0)).count() == 0 and L.scan(df.unionByName(df)).count() == 2 * len(texts)
