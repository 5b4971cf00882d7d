import base64
import json
import random
import time
from concurrent.futures import ThreadPoolExecutor

import public_tokenizers
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.config import EngineConfig
from tokenloom.operators import count as counting
from tokenloom.operators import tokenizers as T
from tokenloom.plans import pipeline
from tokenloom.plans import registry as R
from tokenloom.sources.vocabulary import VocabularyStore

RANKS = T.synthetic_ranks()


def counts(spark, texts, vocabulary):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r["count"] for r in T.count_exact(df, vocabulary).orderBy("id").collect()]


def test_counts_by_rank(spark):
    texts = {"": 0, "world!": 6, "Hello": 3, "wxyzq": 5, "Hexxx": 4, "world! " * 20_000: 140_000}
    assert counts(spark, list(texts), T.RankVocabulary(RANKS)) == list(texts.values())


# Texts and the pieces that the split is to give.
SPLITS = {
    "123 4567": ["123", " ", "456", "7"],
    "line\u0085next": ["line", "\u0085next"],
    "a\u0085 b": ["a", "\u0085", " b"],
    "\ufeff_x": ["\ufeff_", "x"],
    "I'm HERE'S": ["I'm", " HERE'S"],
    "camelCase PascalCase": ["camel", "Case", " Pascal", "Case"],
    "漢字かな": ["漢字", "かな"],
    "a  b\r\n\tc": ["a", " ", " b", "\r\n", "\tc"],
    "": [],
}


def test_pieces(spark):
    df = spark.createDataFrame([(k,) for k in SPLITS], "text string")
    assert {r.text: r.p for r in df.select("text", T.pretokenize("text").alias("p")).collect()} == SPLITS


@given(st.lists(st.text(alphabet="aHelo '\n1漢é!_\u0085\t", max_size=30), min_size=10, max_size=10))
@settings(max_examples=3, deadline=None)
def test_pieces_cover_the_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert all("".join(r.p) == r.text for r in df.select("text", T.pretokenize("text").alias("p")).collect())


@given(st.binary(max_size=12))
@settings(max_examples=100, deadline=None)
def test_merging_follows_ranks(piece):
    ranks = RANKS | {b"ab": 300, b"abc": 301, b"bc": 299, b"aa": 302, b"aaa": 303}
    parts = T.merge_bytes(piece, ranks)
    assert b"".join(parts) == piece and all(p in ranks for p in parts)
    if piece not in ranks:
        assert not any(a + b in ranks for a, b in zip(parts, parts[1:], strict=False))


def test_rank_files(spark):
    text = "IQ== 0\nIg== 1\n\nnot a line\nIw== 2\nIw== -3\n"
    assert T.parse_rank_file(text) == {b"!": 0, b'"': 1, b"#": 2}
    with pytest.raises(ValueError, match="no usable entries"):
        T.parse_rank_file("")
    with pytest.raises(ValueError, match="missing 1 of 3 ranks"):
        T.parse_rank_file("IQ== 0\nIw== 2")
    assert T.parse_rank_file(base64.b64encode(b"\xa1").decode() + " 0") == {b"\xa1": 0}
    lines = spark.createDataFrame([(x,) for x in text.splitlines()], "value string")
    assert T.rank_density(T.parse_rank_lines(lines)).first().asDict() == {"entries": 3, "distinct_ranks": 3, "expected_ranks": 3, "missing": 0}


def tokenizer_file(**extra):
    vocab = {t: i for i, t in enumerate(["<unk>", "a", "b", "c", "ab", "Ġ", "Ġa"])}
    rest = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "post_processor": None, "decoder": None}
    return rest | {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True, "trim_offsets": True}, "model": {"type": "BPE", "vocab": vocab, "merges": ["a b"]}} | extra


def test_tokenizer_files(spark, monkeypatch):
    for lib in (tokenizers, None):
        monkeypatch.setattr(T, "library", lib)
        read = T.TokenizerFile(json.dumps(tokenizer_file()))
        assert not read.whole  # plain files are read here, with the library or without
        monkeypatch.setattr(T, "library", tokenizers)
        assert counts(spark, ["a", "ab", "abc", ""], read) == [1, 1, 2, 0]
    monkeypatch.setattr(T, "library", None)
    # Without the library, other kinds are refused; with it, only what is none.
    other = ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Metaspace", "replacement": "_", "prepend_scheme": "never", "split": True}})
    for bad in (*other, {"model": {"type": "Unigram"}}):
        with pytest.raises(ValueError):
            T.TokenizerFile(json.dumps(tokenizer_file(**bad)))
    monkeypatch.setattr(T, "library", tokenizers)
    assert [counts(spark, ["ab abc"], T.TokenizerFile(json.dumps(tokenizer_file(**x)))) for x in other] == [[4], [3]]
    with pytest.raises(ValueError):
        T.TokenizerFile(json.dumps(tokenizer_file(model={"type": "Unigram"})))


RANK_FILE = T.parse_rank_file(open(public_tokenizers.path("byte_bpe_50k.tiktoken")).read())
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANK_FILE, special_tokens={})


@pytest.fixture(scope="module")
def real_texts(spark):
    r = random.Random(3)
    odd = ["".join(r.choice("aAbé'sß1 \t\n\u0085漢🙂,.-\u200b") for _ in range(r.randint(0, 80))) for _ in range(300)]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [x.text or "" for x in rows] + odd + ["<|endoftext|> is text"]


def test_a_real_rank_table_agrees_with_the_library(spark, real_texts):
    vocabulary = T.RankVocabulary(RANK_FILE, public_tokenizers.PATTERN)
    assert counts(spark, real_texts, vocabulary) == [len(ENCODING.encode_ordinary(t)) for t in real_texts]


@pytest.mark.parametrize("name", ["o200k_base", "cl100k_base", "r50k_base"])
def test_each_encoding_has_its_split(spark, real_texts, name):
    """Natively, as in the library (splits of ours over its table)."""
    pattern = T.ENCODINGS[name]
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=RANK_FILE, special_tokens={})
    vocabulary = T.RankVocabulary(RANK_FILE, pattern)
    assert counts(spark, real_texts, vocabulary) == [len(own.encode_ordinary(t)) for t in real_texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_real_tokenizer_files_agree_with_the_library(spark, real_texts, name):
    text = open(public_tokenizers.path(name)).read()
    own = tokenizers.Tokenizer.from_str(text)
    own.no_truncation(), own.no_padding()
    own.encode_special_tokens = True
    assert counts(spark, real_texts, T.TokenizerFile(text)) == [len(e.ids) for e in own.encode_batch(real_texts, add_special_tokens=False)]


def test_long_pieces_take_no_square_time():
    r = random.Random(1)
    piece = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    begun = time.process_time()
    assert T.merge_bytes(piece[:100_000].encode(), RANK_FILE) == [ENCODING.decode_single_token_bytes(i) for i in ENCODING.encode_ordinary(piece[:100_000])]
    assert time.process_time() - begun < 10


def test_encodings_by_name(spark, tmp_path):
    """A rank file of a known encoding is read with that encoding's split; of an unknown one it is not read."""
    lines = "\n".join(f"{base64.b64encode(t).decode()} {r}" for t, r in RANKS.items())
    for name in ("o200k_base", "cl100k_base"):
        (tmp_path / f"{name}.tiktoken").write_text(lines)
    store = VocabularyStore(str(tmp_path))
    assert store.load(R.BY_ID["gpt-4o"]).pattern == T.O200K and store.load(R.BY_ID["gpt-4-turbo"]).pattern == T.CL100K
    assert store.load(R.BY_ID["gpt-oss-20b"]) is None


def test_a_text_that_fails_is_estimated(spark, tmp_path, monkeypatch):
    assert T._each(lambda t: 1 // len(t))(["a", "", "b"]) == [1, None, 1]
    store, model = VocabularyStore(str(tmp_path)), R.BY_ID["kimi-k3"]
    store.loaded[model.repo] = T.RankVocabulary(RANKS)
    monkeypatch.setattr(T, "token_counter", lambda spark, v: lambda text: F.when(~F.contains(text, F.lit("bad")), F.length(text).cast("bigint")))
    texts = spark.createDataFrame([(1, "good"), (2, "bad text")], "id int, text string")
    assert {r.id: (r["count"], r.exact) for r in counting.count_tokens(texts, model, store=store).collect()} == {1: (4, True), 2: (3, False)}


def test_guards_and_fallbacks(spark, tmp_path):
    texts = spark.createDataFrame([(1, ""), (2, None), (3, "Hello world!"), (4, "x" * (R.MAX_BYTES + 1))], "id int, text string")
    model = R.BY_ID["kimi-k3"]
    plain = {r.id: (r["count"], r.exact) for r in counting.count_tokens(texts, model).collect()}
    assert plain == {1: (0, True), 2: (0, True), 3: (4, False), 4: (2912712, False)}
    store = VocabularyStore(str(tmp_path))
    assert not counting.is_exact(model, store)
    folder = tmp_path / "moonshotai--Kimi-K3"
    folder.mkdir()
    (folder / "tiktoken.model").write_text("\n".join(f"{base64.b64encode(t).decode()} {r}" for t, r in RANKS.items()))
    assert store.is_downloaded(model) and not counting.is_exact(model, store)  # remembered as missing
    assert store.ensure(model) and counting.is_exact(model, store) and store.size() > 0
    exact = {r.id: (r["count"], r.exact) for r in counting.count_tokens(texts, model, store=store).collect()}
    assert exact == {1: (0, True), 2: (0, True), 3: (10, True), 4: (2912712, False)}
    store.clear()
    assert store.size() == 0 and not counting.is_exact(model, store)


def test_fetching(tmp_path):
    asked = []

    def fetch(url):
        asked.append(url)
        time.sleep(0.05)
        return json.dumps(tokenizer_file()).encode() if url.endswith("tokenizer.json") else None

    store = VocabularyStore(str(tmp_path), fetch)
    model = R.BY_ID["glm-5"]
    with ThreadPoolExecutor(4) as pool:  # callers that come meanwhile share the download
        assert all(pool.map(store.ensure, [model] * 4))
    base = "https://huggingface.co/zai-org/GLM-5.2/resolve/main/"
    assert asked == [base + "tokenizer.json", base + "tokenizer_config.json"] and store.ensure(model) and len(asked) == 2
    assert not VocabularyStore(str(tmp_path)).ensure(R.BY_ID["claude-opus-5"])


def test_the_setting_allows_downloads(spark, tmp_path):
    asked = []
    (tmp_path / "a.txt").write_text("abc ab")
    store = VocabularyStore(str(tmp_path / "store"), lambda url: asked.append(url) or (json.dumps(tokenizer_file()).encode() if url.endswith("tokenizer.json") else None))
    count = lambda allowed: pipeline.count_selection(spark, [str(tmp_path / "a.txt")], R.BY_ID["glm-5"], EngineConfig(download_tokenizers=allowed), store=store).first()
    assert (count(False).exact, asked) == (False, [])
    found = count(True)
    assert found.exact and len(asked) == 2 and found.tokens == 4


def test_sql_functions(spark):
    counting.register(spark)
    assert spark.sql("SELECT heuristic_tokens('abcde', 2.5), pretokenize('ab 1'), count_tokens('abcde', 'claude-3-opus')").first() == (2, ["ab", " ", "1"], 2)


def test_every_model(spark):
    df = spark.createDataFrame([(1, "abcdefghij")], "id int, text string")
    out = {r.model_id: r.tokens for r in counting.estimate_all(df, ["id"]).collect()}
    assert len(out) == 71 and out["claude-opus-5"] == 4 and out["gpt-5"] == 3


def test_workers_get_the_pieces_of_few_texts_at_a_time(spark):
    """Arrow batches of ten thousand texts' pieces would fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        T.count_exact(spark.createDataFrame([("Hello",)], "text string"), T.RankVocabulary(T.synthetic_ranks())).collect()
        assert int(spark.conf.get(name)) <= 512
    finally:
        spark.conf.set(name, before)
