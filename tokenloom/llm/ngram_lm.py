"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a logarithmic scale; a count of level q puts q
elements (n-gram, 1) … (n-gram, q) into a Bloom filter. To read a count, levels are probed upward
until one is absent, so errors can only raise a count, and by a level only with a small chance.
Pair probabilities are smoothed towards word probabilities, both from such probes.

Counting covers all training texts: each task packs its n-grams by shard, each shard is counted and
turned into its part of the filter by one task. A shard has about as many n-grams as an input
partition, however many there are. All parts together are broadcast only while their measured size is
within ``MAX_BROADCAST_BYTES``; beyond that the texts' probes travel to the shards and their answers
back, batch by batch, with the same scores.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread
from .common import input_partitions, release_memory, released, small_batches, stream_by_shard, written

#: Counts from BASE ** (q - 1) up to BASE ** q have level q.
BASE = 1.5
LEVELS = 90
#: Hash functions of an element, and the filter's bits for one element.
PROBES = 5
BITS_PER_ELEMENT = PROBES / np.log(2)
#: Weight of the word probabilities beside a context's own counts.
SMOOTHING = 20.0
MAX_BROADCAST_BYTES = 128 << 20
#: N-grams a task holds before it hands them on.
FLUSH = 4_000_000
END = xxhash.xxh64_intdigest(b"\n", 42)  # no word holds white space

_C = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64) + 1)


#: What a level stands for: the mean of its range of counts.
VALUES = np.array([0.0, *(max(1.0, (np.ceil(BASE ** (q - 1)) + max(np.ceil(BASE ** (q - 1)), np.ceil(BASE**q) - 1)) / 2) for q in range(1, LEVELS + 1))])


@dataclass
class Batch:
    """Distinct words and pairs of some texts, and which of them stand where."""

    words: np.ndarray
    word_at: np.ndarray
    pairs: np.ndarray
    pair_at: np.ndarray
    context_at: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


def prepare(texts: list[str | None]) -> Batch:
    """Every text ends with an end token; before its first token stands one as well."""
    split = [(t or "").encode().lower().split() for t in texts]
    sizes = np.array([len(w) + 1 for w in split])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    tokens = np.fromiter((h for w in split for h in (*map(_hash, w), END)), np.uint64, count=int(sizes.sum()))
    before = np.concatenate([[np.uint64(END)], tokens[:-1]]).astype(np.uint64)  # a text's first follows the end token of the one before
    words, word_at = np.unique(tokens, return_inverse=True)
    pairs, pair_at = np.unique(mix(before * _C ^ tokens), return_inverse=True)
    return Batch(words, word_at, pairs, pair_at, np.searchsorted(words, before), starts, sizes)


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def bit_of(h: np.ndarray, order: int, q: int, i: int, size: np.ndarray | int) -> np.ndarray:
    """The place of probe i of element (n-gram, q) among its shard's bits."""
    salt = np.uint64(((order * 128 + q) * 16 + i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return mix((h & _LOW) + salt) % np.asarray(size, dtype=np.uint64)


def build_filter(grams: list[tuple[int, np.ndarray, np.ndarray]]) -> bytes:
    """A shard's bits from its (order, hashes, counts)."""
    elements = sum(int(level(c).sum()) for _, _, c in grams if len(c))
    size = max(64, int(elements * BITS_PER_ELEMENT))
    bits = np.zeros(size, dtype=bool)
    for order, h, c in grams:
        q = level(c) if len(c) else c
        for j in range(1, int(q.max(initial=0)) + 1):
            own = h[q >= j]
            for i in range(PROBES):
                bits[bit_of(own, order, j, i, size)] = True
    return np.packbits(bits).tobytes() + size.to_bytes(8, "little")


class Filter:
    """The bits of some shards, side by side."""

    def __init__(self, payloads: dict[int, bytes], shards: int):
        self.shards = shards
        self.bits = np.frombuffer(b"".join(p[:-8] for _, p in sorted(payloads.items())), np.uint8)
        self.sizes, self.offsets, at = np.ones(shards, np.uint64), np.zeros(shards, np.uint64), 0
        for s, p in sorted(payloads.items()):
            self.sizes[s], self.offsets[s] = int.from_bytes(p[-8:], "little"), at * 8
            at += len(p) - 8

    def levels(self, h: np.ndarray, order: int) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        if not len(self.bits):
            return out
        s = shard_of(h, self.shards)
        sizes, offsets, left = self.sizes[s], self.offsets[s], np.arange(len(h))
        for q in range(1, LEVELS + 1):
            for i in range(PROBES):
                at = bit_of(h[left], order, q, i, sizes[left]) + offsets[left]
                left = left[(self.bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1]
            if not len(left):
                break
            out[left] = q
        return out


def scores(b: Batch, counts: np.ndarray, word_levels: np.ndarray, pair_levels: np.ndarray, tokens: int, vocabulary: int) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    total = tokens + vocabulary + 1
    base = np.log10((counts + 1.0) / total)[b.word_at]
    word, pair = VALUES[word_levels], VALUES[pair_levels][b.pair_at]
    smooth = SMOOTHING * (word[b.word_at] + 1.0) / total
    p = (pair + smooth) / (np.maximum(word[b.context_at], pair) + SMOOTHING)
    known = (counts > 0)[b.word_at].astype(np.int64)
    add = lambda x: np.add.reduceat(x, b.starts)
    return [b.sizes.astype(np.int64), add(known), add(base), add(np.log10(np.minimum(p, 1.0)))]


@dataclass
class Model:
    """Shards (shard, payload = filter part, words = hashes and counts) and the corpus's totals."""

    table: DataFrame
    shards: int
    tokens: int
    vocabulary: int


def train(docs: DataFrame) -> Model:
    """Count the words and pairs of every row of ``docs`` (text). No rows: an empty model."""
    small_batches(docs.sparkSession)
    shards = max(16, input_partitions(docs))

    def pack(order: int, h: np.ndarray, c: np.ndarray) -> Iterator[tuple]:
        s = shard_of(h, shards)
        by = np.argsort(s, kind="stable")
        cuts = np.searchsorted(s[by], np.arange(shards + 1))
        for k in range(shards):
            own = by[cuts[k] : cuts[k + 1]]
            if len(own):
                own = own[np.argsort(h[own])]
                key = h[own].tobytes() if order == 1 else (h[own] & _LOW).astype(np.uint32).tobytes()
                one = c[own] == 1
                # Counts other than one, with their places.
                yield k, order, key, np.flatnonzero(~one).astype(np.uint32).tobytes(), c[own][~one].astype(np.int64).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {1: [], 2: []}

        def out() -> Iterator[pa.RecordBatch]:
            for order, parts in held.items():
                if parts:
                    h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    c = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                    for row in pack(order, h, c):
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["shard", "n", "keys", "places", "counts"])
                    parts.clear()

        for b in batches:
            with np.errstate(over="ignore"):
                x = prepare(b.column(0).to_pylist())
            if not len(x.sizes):
                continue
            held[1].append((x.words, np.bincount(x.word_at, minlength=len(x.words))))
            held[2].append((x.pairs, np.bincount(x.pair_at, minlength=len(x.pairs))))
            if sum(len(p[0]) for parts in held.values() for p in parts) > FLUSH:
                yield from out()
        yield from out()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = []
        for order, kind in ((1, np.uint64), (2, np.uint32)):
            rows = pdf[pdf["n"] == order]
            keys = [np.frombuffer(k, kind).astype(np.uint64) for k in rows["keys"]]
            counts = [np.ones(len(k), np.int64) for k in keys]
            for c, places, more in zip(counts, rows["places"], rows["counts"], strict=True):
                c[np.frombuffer(places, np.uint32)] = np.frombuffer(more, np.int64)
            h, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
            grams.append((order, h, np.bincount(at, np.concatenate([np.zeros(0, np.int64), *counts]), minlength=len(h)).astype(np.int64)))
        with np.errstate(over="ignore"):
            bits = build_filter(grams)
        _, h, c = grams[0]
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "payload": [bits], "words": [h.tobytes() + c.tobytes()], "tokens": [int(c.sum())], "vocabulary": [len(h)]})

    packed = spread(docs.select("text")).mapInArrow(released(run), "shard long, n long, keys binary, places binary, counts binary")
    built = written(packed.groupBy("shard").applyInPandas(one, "shard long, payload binary, words binary, tokens long, vocabulary long"))
    n, v = built.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
    return Model(built, shards, n, v)


def _word_counts(words: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Exact counts of words, 0 for unknown ones; ``keys`` ascend."""
    if not len(keys):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    return np.where(keys[at] == words, counts[at], 0)


def _unpack(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(words) // 2
    return np.frombuffer(words[:half], np.uint64), np.frombuffer(words[half:], np.int64)


_loaded: dict[str, tuple] = {}
_RESULT = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Score every whole text of ``docs`` (text and any other columns but the four results and __row).

    Adds n_tokens (words and one end), n_known (tokens that training has), base_score (log10 of
    add-one word probabilities, from exact counts) and score (log10 probability of the model). Null
    texts count as empty, which have their end token only; repeated rows each get their scores.
    """
    taken = {"n_tokens", "n_known", "base_score", "score", "__row"} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"the input already has {sorted(taken)}")
    small_batches(docs.sparkSession)
    size = model.table.agg(F.coalesce(F.sum(F.length("payload") + F.length("words")), F.lit(0))).first()[0]
    if size > max_broadcast_bytes:
        return _score_by_shard(docs, model)
    payloads, keys, counts = {}, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in model.table.select("shard", "payload", "words").toLocalIterator():
        payloads[r["shard"]] = bytes(r["payload"])
        h, c = _unpack(bytes(r["words"]))
        keys.append(h), counts.append(c)
    h, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(h)
    sent = docs.sparkSession.sparkContext.broadcast((payloads, h[order], c[order]))
    del payloads, keys, counts, h, c, order
    release_memory()
    name, shards, n, v, at = hashlib.sha256(str(sent._jbroadcast.id()).encode()).hexdigest(), model.shards, model.tokens, model.vocabulary, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded.clear()
            p, h, c = sent.value
            _loaded[name] = (Filter(p, shards), h, c)
            p.clear()
        bloom, keys, counts = _loaded[name]
        for b in batches:
            if not b.num_rows:
                continue
            with np.errstate(over="ignore"):
                x = prepare(b.column(at).to_pylist())
                out = scores(x, _word_counts(x.words, keys, counts), bloom.levels(x.words, 1), bloom.levels(x.pairs, 2), n, v)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out)], names=[*b.schema.names, "n_tokens", "n_known", "base_score", "score"])

    return spread(docs).mapInArrow(released(run), _with_results(docs))


def _with_results(docs: DataFrame):
    return docs.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _RESULT.split(", ")]).schema


def _score_by_shard(docs: DataFrame, model: Model) -> DataFrame:
    """The same scores without a broadcast: batches of texts send their distinct n-grams to the
    shards, and are put together again from the answers. Where n-grams stand is not sent along, as it is most
    of the bytes: the packed texts meet the answers, and are split once more."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()))
    shards, n, v = model.shards, model.tokens, model.vocabulary

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), None
            with np.errstate(over="ignore"):
                x = prepare(b.column(1).to_pylist())
            encoded = [(t or "").encode() for t in b.column(1).to_pylist()]
            lengths = np.array([len(t) for t in encoded], np.int64)
            out = [(-1, ids[0], np.array([len(ids)], np.int64).tobytes() + ids.tobytes() + lengths.tobytes() + zlib.compress(b"".join(encoded), 1))]
            of_words, of_pairs = shard_of(x.words, shards), shard_of(x.pairs, shards)
            for k in range(shards):
                w, p = x.words[of_words == k], x.pairs[of_pairs == k]
                if len(w) or len(p):
                    # The shard is the higher half of a pair, as far as it counts.
                    out.append((k, ids[0], np.array([len(w)], np.int64).tobytes() + w.tobytes() + (p & _LOW).astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names=["shard", "batch", "probes"])

    asked = written(rows.select("__row", "text").mapInArrow(ask, "shard long, batch long, probes binary"))

    def answer(parts):
        now, bloom, keys, counts = None, None, None, None
        for k, payload, b in parts:
            if k != now:
                size = int.from_bytes(payload[:8], "little") if payload else 0
                now, bloom = k, Filter({k: payload[8 : 8 + size]} if payload else {}, shards)
                keys, counts = _unpack(payload[8 + size :]) if payload else _unpack(b"")
            out = []
            for probes in b.column(1).to_pylist():
                w = int.from_bytes(probes[:8], "little")
                h, low = np.frombuffer(probes[8 : 8 + 8 * w], np.uint64), np.frombuffer(probes[8 + 8 * w :], np.uint32)
                pairs = low.astype(np.uint64) | np.uint64(k << 32)
                with np.errstate(over="ignore"):
                    out.append(np.array([k, w]).tobytes() + _word_counts(h, keys, counts).astype(np.int64).tobytes() + bloom.levels(h, 1).astype(np.int8).tobytes() + bloom.levels(pairs, 2).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["batch", "answers"])

    state = model.table.select("shard", F.concat(_little_endian(F.length("payload")), "payload", "words").alias("payload"))
    answers = stream_by_shard(state, asked.where("shard >= 0"), "shard", shards * 2, answer, "batch long, answers binary", 2)
    layout = asked.where("shard < 0").select("batch", F.col("probes").alias("answers"), F.lit(True).alias("own"))

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["own"]]["answers"].iloc[0]
        many = int.from_bytes(own[:8], "little")
        ids, lengths = np.split(np.frombuffer(own[8 : 8 + 16 * many], np.int64), 2)
        packed, ends = zlib.decompress(own[8 + 16 * many :]), np.cumsum(lengths)
        with np.errstate(over="ignore"):
            x = prepare([packed[end - n_bytes : end].decode() for end, n_bytes in zip(ends, lengths, strict=True)])
        counts, words, pairs = np.zeros(len(x.words), np.int64), np.zeros(len(x.words), np.int64), np.zeros(len(x.pairs), np.int64)
        of_words, of_pairs = shard_of(x.words, shards), shard_of(x.pairs, shards)
        for a in pdf[~pdf["own"]]["answers"]:
            k, w = (int(i) for i in np.frombuffer(a[:16], np.int64))
            at, levels = of_words == k, np.frombuffer(a[16 + 8 * w :], np.int8)
            counts[at] = np.frombuffer(a[16 : 16 + 8 * w], np.int64)
            words[at], pairs[of_pairs == k] = levels[:w], levels[w:]
        out = scores(x, counts, words, pairs, n, v)
        return pd.DataFrame(dict(zip(["__row", "n_tokens", "n_known", "base_score", "score"], [ids, *out], strict=True)))

    found = answers.withColumn("own", F.lit(False)).unionByName(layout).groupBy("batch").applyInPandas(combine, f"__row long, {_RESULT}")
    return rows.join(found, "__row").drop("__row")


def _little_endian(n: Column) -> Column:
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(8))]))
