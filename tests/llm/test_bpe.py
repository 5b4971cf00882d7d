import hashlib
import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tokenloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
OURS = bpe.WordBpe(json.load(open(PATH)))
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation(), LIBRARY.no_padding()


def same(texts):
    ids = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert OURS.encode(texts) == ids
    assert [OURS.decode(x) for x in ids] == [LIBRARY.decode(x, skip_special_tokens=False) for x in ids]


def test_words_signs_and_scripts():
    same(["", " ", "Hello, world! don't", "ÉCOLE é À ß ẞ İ ΣΑΣ", "<|startoftext|>a<|endoftext|>", "<|startoftext", "漢字 한국어 हिन्दी", "🙂👍🏽 ½ Ⅷ ² x³", "a\x1c\x85\u00a0\u2028\ufeffb", "\ua7d4\u1c89\U00010d57", "aaaa" * 300])


def test_words_of_one_byte_alone():
    fresh = bpe.WordBpe(json.load(open(PATH)))
    assert fresh.encode(["1"]) == [LIBRARY.encode("1", add_special_tokens=False).ids] and fresh.merge_words([]) == []


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_KEPT_WORDS", 10)
    fresh, r = bpe.WordBpe(json.load(open(PATH))), random.Random(1)
    for _ in range(20):
        texts = [" ".join("".join(r.choice("thean") for _ in range(r.randint(1, 6))) for _ in range(8)) for _ in range(3)]
        assert fresh.encode(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
        assert len(fresh.kept) <= 10 + 24


def test_random_texts_agree_with_the_library():
    r = random.Random(0)
    pool = list("abcdeAEIΣσİıßéÀ '’sStT<|>\x1c\x85\u200b1२Ⅷ½ǅ漢🙂\u0345ﬁ\r\n\t.,!aaaaththe") + ["<|startoftext|>", "'ll"]
    same(["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(4000)])


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_agrees_with_the_library(text):
    same([text])


def test_lower_ranks_made_by_a_merge_go_first():
    """A pair of a lower rank that a merge makes is merged before that word's other pairs."""
    vocab = {c: i for i, c in enumerate(["a", "b", "a</w>", "b</w>", "ab", "aab", "ab</w>", "aba", "abab</w>"])}
    spec = json.load(open(PATH))
    spec["model"]["vocab"], spec["model"]["merges"], spec["added_tokens"] = vocab, [["a", "ab"], ["ab", "a"], ["a", "b"], ["a", "b</w>"], ["ab", "ab</w>"]], []
    library, ours = Tokenizer.from_str(json.dumps(spec)), bpe.WordBpe(spec)
    words = ["aabab", "ababab", "aaabb", "abaab", "bbab", "aababaab"]
    assert [ours.encode([w])[0] for w in words] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_columns(spark):
    rows = [(1, "Hello world", 7), (None, None, None), (2, "", 1), (1, "Hello world", 7), (3, "word " * 30_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 int")
    out = sorted(((r.doc_id or -1), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    hello = (2, sha("3306 1002"), sha("hello</w> world</w>"))
    assert [o[1:] for o in out if o[0] == 1] == [hello, hello] and [o[1:] for o in out if o[0] in (-1, 2)] == [(0, sha(""), sha(""))] * 2
    assert [o[1] for o in out if o[0] == 3] == [30_000]
    assert bpe.digests(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="already has"):
        bpe.encode(df, PATH, ids="IDS_sha256")
