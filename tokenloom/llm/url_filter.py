"""URL filter: rules by host and path, then an exact Bloom filter cascade for all other urls.

The cascade's first level encodes the listed keys; the second the keys of the corpus that the
first takes wrongly; the third the listed keys that the second takes wrongly; and so on until
nothing is taken wrongly. Over the complete key universe it was built with, membership is exact,
although it holds no key and no join is made.

Keys are dealt by hash over shards of about ``SHARD_KEYS`` keys, each with a cascade of its own, so
building one never needs more memory than a shard. Together they are broadcast only where their
measured size is within ``max_broadcast_bytes``; beyond that each shard's cascade travels to the
tasks that get its keys (``stream_by_shard``), with the same answers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, input_partitions, small_batches, stream_by_shard, written

#: Keys of the universe in one shard, about.
SHARD_KEYS = 100_000
MAX_BROADCAST_BYTES = 32 << 20
#: Tasks that share the rows of one shard where cascades are not broadcast: a hot key spreads.
COPIES = 8

_C = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(h1: np.ndarray, h2: np.ndarray, level: int, i: int, bits: int) -> np.ndarray:
    """The bit that hash function ``i`` of a level gives each key."""
    salt = np.uint64(level + 1) * _C
    return (mix(h1 ^ salt) + np.uint64(i) * (mix(h2 + salt) | np.uint64(1))) % np.uint64(bits)


class Cascade:
    """Levels of (bits, number of hash functions, packed bits); keys are pairs of 64-bit hashes."""

    def __init__(self, levels: list[tuple[int, int, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> Cascade:
        """``listed`` marks the listed keys among the universe's distinct keys."""
        levels: list[tuple[int, int, np.ndarray]] = []
        inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
        while len(inside):
            # The first level passes about |inside|/|outside| of the others, later ones a half.
            rate = min(0.5, len(inside) / max(1, len(outside))) if not levels else 0.5
            k = max(1, round(-np.log2(rate)))
            bits = max(64, int(np.ceil(len(inside) * k / np.log(2))))
            array = np.zeros(bits, dtype=bool)
            for i in range(k):
                array[places(h1[inside], h2[inside], len(levels), i, bits)] = True
            taken = outside[_in(array, h1[outside], h2[outside], len(levels), k, bits)]
            levels.append((bits, k, np.packbits(array)))
            inside, outside = taken, inside
            if len(levels) > 200:
                raise ValueError("two keys, one of them listed, have the same 128-bit hash")
        return cls(levels)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), dtype=bool)
        left = np.arange(len(h1))
        for level, (bits, k, packed) in enumerate(self.levels):
            if not len(left):
                break
            hit = np.ones(len(left), dtype=bool)
            for i in range(k):
                p = places(h1[left], h2[left], level, i, bits)
                hit &= (packed[p >> np.uint64(3)] >> (7 - (p & np.uint64(7))).astype(np.uint8)) & 1 == 1
            left = left[hit]
            out[left] = level % 2 == 0
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<QI", bits, k) + packed.tobytes() for bits, k, packed in self.levels)

    @classmethod
    def from_bytes(cls, blob: bytes) -> Cascade:
        (n,), at, levels = struct.unpack_from("<I", blob), 4, []
        for _ in range(n):
            bits, k = struct.unpack_from("<QI", blob, at)
            size = (bits + 7) // 8
            levels.append((bits, k, np.frombuffer(blob, np.uint8, size, at + 12)))
            at += 12 + size
        return cls(levels)


def _in(array: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    hit = np.ones(len(h1), dtype=bool)
    for i in range(k):
        hit &= array[places(h1, h2, level, i, bits)]
    return hit


def _hashes(key: str = "key") -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")]


def build_cascades(universe: DataFrame, listed: DataFrame) -> tuple[DataFrame, int]:
    """(shard, payload) rows in a written table, and the number of shards. ``universe`` and
    ``listed`` have a string column ``key``; null keys count as empty, repeats as one."""
    keys = universe.select(F.coalesce("key", F.lit("")).alias("key"), F.lit(False).alias("listed")).unionByName(
        listed.select(F.coalesce("key", F.lit("")).alias("key"), F.lit(True).alias("listed"))
    )
    distinct = written(keys.select(*_hashes(), "listed").groupBy("h1", "h2").agg(F.max("listed").alias("listed")))
    shards = max(1, -(-distinct.count() // SHARD_KEYS))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        with np.errstate(over="ignore"):
            built = Cascade.build(h1, h2, pdf["listed"].to_numpy(bool))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "payload": [built.to_bytes()]})

    dealt = distinct.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return written(dealt.groupBy("shard").applyInPandas(one, "shard long, payload binary")), shards


def mark_listed(df: DataFrame, key: str, cascades: DataFrame, shards: int, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Add ``listed`` boolean to ``df``: whether its key is among the listed ones. ``df`` must not
    have the columns listed, h1, h2, key_ or shard."""
    taken = {"listed", "h1", "h2", "key_", "shard"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"the input already has {sorted(taken)}")
    small_batches(df.sparkSession, 4096)
    probe = df.withColumn("key_", F.coalesce(key, F.lit(""))).select("*", *_hashes("key_")).drop("key_").withColumn("shard", F.pmod("h1", F.lit(shards)))
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", listed boolean"

    def answer(batch: pa.RecordBatch, cascade: Cascade) -> pa.RecordBatch:
        h1, h2 = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
        with np.errstate(over="ignore"):
            found = cascade.contains(h1, h2)
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(found)], names=[*names, "listed"])

    size = cascades.agg(F.coalesce(F.sum(F.length("payload")), F.lit(0))).first()[0]
    if size <= max_broadcast_bytes:
        sent = df.sparkSession.sparkContext.broadcast({r.shard: r.payload for r in cascades.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {s: Cascade.from_bytes(b) for s, b in sent.value.items()}
            empty = Cascade([])
            for b in batches:
                shard = b.column(b.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
                for s in np.unique(shard):
                    yield answer(b.filter(pa.array(shard == s)), held.get(int(s), empty))

        return probe.mapInArrow(run, schema)

    def run_sharded(parts):
        now, cascade = None, Cascade([])
        for s, payload, batch in parts:
            if s != now:
                now, cascade = s, Cascade.from_bytes(payload) if payload else Cascade([])
            yield answer(batch, cascade)

    return stream_by_shard(cascades, probe, "shard", max(shards * COPIES, input_partitions(df)), run_sharded, schema, COPIES)


def host(url: str | Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url; other columns are
    ignored, repeated rows each give a row, a null url counts as one without host and path).
    ``listed`` has the blocked keys (host and path, as here) in ``key``; a url without a rule is
    blocked if its key is listed."""
    parts = pages.select("page_id", host("url").alias("host"), path("url").alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", F.concat("host", "path").alias("key"), rule.alias("rule"), verdict.alias("ruled"))
    cascades, shards = build_cascades(ruled.where("rule is null").select("key"), listed)
    marked = mark_listed(ruled, "key", cascades, shards, max_broadcast_bytes)
    return marked.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
