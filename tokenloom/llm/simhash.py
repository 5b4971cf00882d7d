"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint bits that go together are grouped into partitions. If two fingerprints differ in at
most t bits, then for any thresholds t_i with sum(t_i + 1) = t + 1 some partition i differs in at
most t_i bits (t_i = -1: that partition is never probed). Dynamic programming picks the thresholds,
and the number of partitions, for the fewest estimated candidates and probes; bit statistics and
bucket counts cover all fingerprints. Each partition's signatures are probed, and what shares one
is verified by counting differing bits.

Equal fingerprints are one node throughout. Where a bucket holds more than ``HOT`` fingerprints, as
in a large group of near copies, its pairs are not made: its fingerprints (and those that probe it)
instead give out their *midpoints*, themselves and every fingerprint one bit away. Two fingerprints
share a midpoint exactly if they differ in at most 2 bits, so all that share one are linked to its
smallest: the same components, from at most 65 rows a fingerprint.

``keep_similar`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Its first
candidates are those of the pigeonhole: fingerprints of five-word shingles at up to 2 bits, verified on the texts. But
similarity 0.8 is some ten differing bits of 64, too many to probe for (README); so what the fingerprints have not brought
together is looked for by keys of smallest shingle hashes, and verified likewise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread
from .common import pin_splits, released, scratch, small_batches, written
from .components import components

SEED = 42
SHINGLE = 3
MOST_BITS = 2
#: Fingerprints in a bucket beyond which midpoints take over.
HOT = 32
#: Words hashed at a time: bounds memory for very long texts.
CHUNK = 1 << 16
_ONES = 0xFFFFFFFFFFFFFFFF
#: Similar documents: words in a shingle, least Jaccard similarity, keys, and smallest hashes in a key.
WIDE_SHINGLE, SIMILARITY, KEYS, IN_KEY = 5, 0.8, 16, 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is in over half the shingles' hashes. No words: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    n, total = len(words) - size + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + size - 1]
        joined = map(b" ".join, zip(*(part[i : len(part) - size + 1 + i] for i in range(size)), strict=True))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(released(run), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of ones by bit, and the correlation of each two bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones, both = 0, np.zeros(64, np.int64), np.zeros((64, 64), np.int64)
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            bits = ((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            n, ones, both = n + len(x), ones + bits.sum(axis=0).astype(np.int64), both + (bits.T @ bits).astype(np.int64)
        sums = np.concatenate([[n], ones, both.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["at", "s"])

    rows = fps.select("fp").mapInArrow(run, "at long, s long").groupBy("at").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros(1 + 64 + 64 * 64)
    for r in rows:
        sums[r["at"]] = r["s"]
    n = int(sums[0])
    p = sums[1:65] / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return n, p, (sums[65:].reshape(64, 64) / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)


def partitions(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of almost equal size; each is grown from its first free bit by the bit that
    correlates most with it."""
    free, out = list(range(64)), []
    strength = np.abs(correlation)
    for i in range(m):
        size = len(free) // (m - i)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (strength[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def flips(bits: list[int], most: int) -> list[int]:
    """Every way of changing up to ``most`` of the bits."""
    return [mask(list(c)) for k in range(most + 1) for c in combinations(bits, k)]


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """The cheapest thresholds with sum(t_i + 1) = budget; ``costs[i][t + 1]`` is partition i's cost
    at threshold t, from -1 on."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (total, ts) in best.items():
            for k in range(budget - used + 1):
                x = (total + cost[k], [*ts, k - 1])
                if used + k not in after or x[0] < after[used + k][0]:
                    after[used + k] = x
        best = after
    return best[budget]


def _signatures(fps: DataFrame, masks: Column) -> DataFrame:
    """(part, sig, fp) for each fingerprint and (part, mask)."""
    return fps.select("fp", F.explode(masks).alias("x")).select(F.col("x.part").alias("part"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("sig"), "fp")


def _masks(groups: list[tuple[int, list[int]]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("part"), F.lit(mask(bits)).alias("mask")) for i, bits in groups])


def links(fps: DataFrame, most: int = MOST_BITS, hot: int = HOT) -> DataFrame:
    """(a, b): links that connect exactly those of the distinct fingerprints ``fps`` (fp) that are
    connected by steps of at most ``most`` (1 or 2) differing bits."""
    if most not in (1, 2):
        raise ValueError("midpoints need at most 2 differing bits")
    n, ones, correlation = bit_statistics(fps)
    plans = {m: partitions(correlation, m) for m in range(1, most + 2)}
    numbered = {(m, i): 8 * m + i for m, groups in plans.items() for i in range(len(groups))}
    data = _signatures(fps, _masks([(numbered[m, i], bits) for m, groups in plans.items() for i, bits in enumerate(groups)]))
    counts = written(data.groupBy("part", "sig").agg(F.count("*").alias("n")).where("n > 1"))
    pairs = {r.part: float(r.c) for r in counts.groupBy("part").agg(F.sum(F.when(F.col("n") > hot, 65.0 * F.col("n")).otherwise(F.col("n") * (F.col("n") - 1) / 2)).alias("c")).collect()}
    agree = np.clip(ones**2 + (1 - ones) ** 2, 1e-3, 1)

    def costs(m: int, i: int, bits: list[int]) -> list[float]:
        """At thresholds -1, 0, …: candidates (bits taken as independent beyond 0) and probes."""
        out, exact = [0.0], pairs.get(numbered[m, i], 0.0) + n * n / 2 * float(np.prod(agree[bits]))
        differ = float(((1 - agree[bits]) / agree[bits]).sum())
        for t in range(most + 1):
            out.append(sum(exact * differ**k / math.factorial(k) for k in range(t + 1)) + n * sum(math.comb(len(bits), k) for k in range(t + 1)))
        return out

    _, m, thresholds = min((*(x := allocate([costs(m, i, g) for i, g in enumerate(groups)], most + 1))[:1], m, x[1]) for m, groups in plans.items())
    used = [(numbered[m, i], bits, t) for i, (bits, t) in enumerate(zip(plans[m], thresholds, strict=True)) if t >= 0]

    own = _signatures(fps, _masks([(part, bits) for part, bits, _ in used]))
    change = F.lit(None).cast("array<long>")
    for part, bits, t in used:
        change = F.when(F.col("part") == part, F.array(*[F.lit(x) for x in flips(bits, t)])).otherwise(change)
    probes = own.select("part", "fp", "sig", F.explode(change).alias("c")).select("part", F.col("sig").bitwiseXOR(F.col("c")).alias("sig"), "fp") if any(t for *_, t in used) else own
    is_hot = counts.where(F.col("n") > hot).select("part", "sig")
    cold = own.join(is_hot, ["part", "sig"], "left_anti").withColumnRenamed("fp", "other")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most
    found = probes.join(cold, ["part", "sig"]).where((F.col("fp") != F.col("other")) & near)
    plain = found.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()

    crowded = probes.join(is_hot, ["part", "sig"], "left_semi").select("fp").distinct()
    around = F.array(*[F.lit(x) for x in flips(list(range(64)), 1)]) if most == 2 else F.array(*[F.lit(_signed(1 << b)) for b in range(64)])
    if most == 2:
        key = F.col("fp").bitwiseXOR(F.col("x"))
        shared = crowded.select("fp", F.explode(around).alias("x")).select(key.alias("key"), "fp")
    else:  # two fingerprints one bit apart are the same once that bit is cleared
        cleared = F.struct(F.col("x").alias("bit"), F.col("fp").bitwiseAND(F.bitwise_not("x")).alias("rest"))
        shared = crowded.select("fp", F.explode(around).alias("x")).select(cleared.alias("key"), "fp")
    stars = shared.groupBy("key").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    starred = stars.select("a", F.explode("all").alias("b")).where("a != b").distinct()
    return plain.unionByName(starred)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that is reachable by links. Null and empty texts have
    fingerprint zero and link like any other; repeated rows each give a row; a row without doc_id
    links like any other (a component in which no row has an id has null for one); extra columns are
    ignored; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, shingle))
    rows = prints.join(_components_of(prints, lambda fps: links(fps, most, hot)), "fp")
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _components_of(prints: DataFrame, linking: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint in ``prints`` (doc_id, fp): root is one
    fingerprint of its component, component_id the smallest doc_id in it (null: none has one)."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(linking(nodes.select("fp")).toDF("u", "v"))
    rooted = written(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    # A fingerprint alone is its own component: only those of several are grouped, and joined again.
    several = rooted.where("fp != root").select("root").distinct()
    ids = rooted.join(several, "root", "left_semi").groupBy("root").agg(F.min("rep").alias("least"), F.lit(True).alias("many"))
    return rooted.join(ids, "root", "left").select("fp", "root", F.when(F.col("many"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))


#: Rows whose places are broadcast to drop them, at most (8 bytes each).
BROADCAST_ROWS = 4_000_000


def keep_one(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS, hot: int = HOT) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id, and of
    several with that id the first in the table; rows without id come last. ``docs`` must come in the same
    order each time, as rows of files do; all columns pass through. ``docs`` must not have a column __row."""
    return _keep_first(docs, lambda t: fingerprint(t, shingle), lambda prints, numbered: _components_of(prints, lambda fps: links(fps, most, hot)))


def keep_similar(docs: DataFrame, shingle: int = WIDE_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """As ``keep_one``, where what links two texts is a Jaccard similarity of at least ``least`` between
    their sets of shingles (a text of fewer words is one shingle). Texts without words are one group."""

    def linked(prints: DataFrame, numbered: DataFrame) -> DataFrame:
        one = prints.groupBy("fp").agg(F.min("row").alias("row"))
        texts = written(numbered.join(one, "row").select("fp", "text"))
        return _components_of(prints, lambda fps: similar_links(texts, shingle, least))

    return _keep_first(docs, lambda t: _set_hash(shingle_hashes(t, shingle)), linked)


def shingle_hashes(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = (text or "").encode().lower().split()
    size = min(shingle, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)), np.uint64))


def set_print(hashes: np.ndarray) -> int:
    """64 bits of a set of shingles' hashes; a bit is set if it is in over half of them."""
    if not len(hashes):
        return 0
    total = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def _set_hash(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


_POINTS = np.random.default_rng(0).integers(0, 1 << 64, KEYS * IN_KEY, dtype=np.uint64)


def shingle_keys(hashes: np.ndarray) -> list[int]:
    """KEYS hashes of IN_KEY smallest ones; texts of similarity 0.8 share one but for one pair in some 5,000."""
    if not len(hashes):
        return []
    least = np.array([(hashes ^ p).min() ^ p for p in _POINTS]).reshape(KEYS, IN_KEY)
    return [_signed(xxhash.xxh64_intdigest(x.tobytes(), i)) for i, x in enumerate(least)]


def similar_links(texts: DataFrame, shingle: int = WIDE_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(a, b): links between the texts (fp, text; one row for each set of shingles) that connect those of
    similarity ``least`` or more whose fingerprints link, or that share a key. In each bucket of a key all are compared
    with its smallest fp, and what that does not hold with all; what fingerprints have linked is not compared again."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t, shingle) for t in b.column(1).to_pylist()]
            bits = np.array([set_print(h) for h in hashes], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits), pa.array([shingle_keys(h) for h in hashes], pa.list_(pa.int64()))], names=["fp", "bits", "keys"])

    printed = written(spread(texts).mapInArrow(released(keyed), "fp long, bits long, keys array<long>"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for one, two in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = shingle_hashes(one, shingle), shingle_hashes(two, shingle)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        with scratch(pairs.sparkSession) as keep:
            pairs = written(pairs.distinct())
            # Only texts that are in a pair are dealt to meet it.
            needed = written(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
            few = needed.count() <= BROADCAST_ROWS
            own = texts.join(F.broadcast(needed) if few else needed, "fp", "left_semi")
            both = pairs.join(own.toDF("a", "text_a"), "a").join(own.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
            return keep(both.mapInArrow(released(compared), "a long, b long"))

    # One text stands for all of a fingerprint; fingerprints that link bring their texts together.
    nodes = written(printed.groupBy("bits").agg(F.min("fp").alias("one")))
    linked = links(nodes.select(F.col("bits").alias("fp")))
    pairs = linked.join(nodes.toDF("a", "one_a"), "a").join(nodes.toDF("b", "one_b"), "b").select(F.least("one_a", "one_b").alias("a"), F.greatest("one_a", "one_b").alias("b"))
    same = printed.join(nodes, "bits").where("fp != one").select(F.least("fp", "one").alias("a"), F.greatest("fp", "one").alias("b"))
    near = verified(pairs.unionByName(same))
    roots = components(near.toDF("u", "v")).toDF("fp", "root")
    grouped = written(printed.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "keys"))
    every = grouped.select("fp", "root", F.explode("keys").alias("key"))
    shared = written(every.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("fp", "root")).alias("p")).where("n > 1").select("key", F.col("p.fp").alias("pivot"), F.col("p.root").alias("pivot_root")))
    rows = written(every.join(shared, "key").where("fp != pivot"))
    held = verified(rows.where("root != pivot_root").select(F.col("pivot").alias("a"), F.col("fp").alias("b")))
    loose = written(rows.where("root != pivot_root").join(held.toDF("pivot", "fp"), ["pivot", "fp"], "left_anti"))
    rest = loose.join(rows.select("key", F.col("fp").alias("other"), F.col("root").alias("other_root")), "key").where("root != other_root")
    return near.unionByName(held).unionByName(verified(rest.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))))


def _keep_first(docs: DataFrame, print_of: Callable, components_of: Callable) -> DataFrame:
    if "__row" in {c.lower() for c in docs.columns}:
        raise ValueError("the input already has a column __row")
    small_batches(docs.sparkSession)
    pin_splits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([print_of(t) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["row", "doc_id", "fp"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(docs.sparkSession) as keep:
        prints = written(spread(numbered).mapInArrow(released(run), "row long, doc_id long, fp long"))
        grouped = written(prints.join(components_of(prints, numbered.select("row", "text")), "fp"))
        first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
        gone = keep(grouped.select("row").join(first, "row", "left_anti")).withColumnRenamed("row", "__row")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(gone, "__row", "left_anti").select(docs.columns)
