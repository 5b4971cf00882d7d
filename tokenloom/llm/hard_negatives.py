"""Hard negatives by a norm-bucketed search.

Candidates are sorted by norm, longest first, and cut into shards and, within these, buckets. No vector of a bucket
can score more with an anchor than the anchor's norm times the bucket's longest (Cauchy-Schwarz), so a search for
scores from some limit on ends at the first bucket that falls short of it. Limits are the lower end of a window of
scores, and the k-th best score found so far, which rises as buckets go by.

Anchors come in blocks, dealt to shards of long vectors first. What they find there bounds the search of all others: a
block is sent only to shards that are long enough for one of its anchors, and blocks gather anchors of like need.
Positives (best rows of the anchor's own label) are searched first; their scores then set the windows of the negatives.

Scores are integers. They are made in doubles where a bound shows that this is exact, else in longs, else in
Python's integers.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import released, small_batches, stream_by_shard, written

SCALE = 256
#: Vectors in a shard (a payload of one task) and in a bucket, at most; anchors in a block.
SHARD_VECTORS, BUCKET, BLOCK = 16_384, 1_024, 256
#: What scales beyond this is held there; scores beyond a long's range are held at its ends.
EDGE = 1 << 62
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Norms are rounded, so a bound gets this much more.
SLACK = 1 + 1e-9

_ROWS = "row long, id long, label long, v array<long>, norm double"
_FOUND = "anchor long, slot int, id long, score long"


def integers(vectors: DataFrame, label: Column, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(row, id, label, v, norm): floor(scale * x) of each component as long, and a number for each row."""
    whole = F.col(embedding).cast("array<double>")
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(whole, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(EDGE))), F.lit(-float(EDGE)))).cast("long"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(embedding).alias("e"), F.when(fine, v).alias("v")).where("label is not null and e is not null and v is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v", norm.alias("norm"))


class Shard:
    """Vectors by falling norm, in buckets; ``longest`` has each bucket's first norm."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norms: np.ndarray, bucket: int = BUCKET):
        self.rows, self.ids, self.unnamed, self.labels, self.vectors, self.norms = rows, ids, unnamed, labels, vectors, norms
        self.starts = list(range(0, len(rows), bucket))
        self.ends = [*self.starts[1:], len(rows)]
        self.longest = norms[self.starts]
        self.most = int(max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0)))))
        self._doubles: np.ndarray | None = None

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, rows=self.rows, ids=self.ids, unnamed=self.unnamed, labels=self.labels, vectors=self.vectors, norms=self.norms)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes, bucket: int = BUCKET) -> Shard:
        return cls(**np.load(io.BytesIO(blob)), bucket=bucket)

    def scores(self, anchors: np.ndarray, a: int, b: int) -> np.ndarray:
        """Exact inner products of anchors with rows a to b."""
        bound = self.most * int(max(abs(int(anchors.max(initial=0))), abs(int(anchors.min(initial=0))))) * max(1, anchors.shape[1])
        if bound < 1 << 53:
            if self._doubles is None:
                self._doubles = self.vectors.astype(np.float64)
            return (anchors.astype(np.float64) @ self._doubles[a:b].T).astype(np.int64)
        if bound < 1 << 63:
            return anchors @ self.vectors[a:b].T
        exact = anchors.astype(object) @ self.vectors[a:b].T.astype(object)
        return np.clip(exact, LOWEST, HIGHEST).astype(np.int64)

    def search(self, anchor_rows: np.ndarray, labels: np.ndarray, anchors: np.ndarray, norms: np.ndarray, windows: list[list[tuple[int, int, int]]], same: bool, k: int) -> tuple[list[tuple[int, int, int | None, int]], int]:
        """((anchor row, slot, id, score) of the k best here in each of an anchor's windows, buckets looked at).

        A window: (slot, lowest, highest score). ``same``: rows of the anchor's label but itself, else rows of other
        labels."""
        best: list[list[list[tuple[int, int, int]]]] = [[[] for _ in w] for w in windows]
        floors = [[low for _, low, _ in w] for w in windows]
        needs = np.array([min(f, default=HIGHEST) for f in floors], np.float64)
        looked = 0
        for start, end, longest in zip(self.starts, self.ends, self.longest, strict=True):
            going = np.flatnonzero(norms * longest * SLACK >= needs)
            if not len(going):
                break  # all that follow are shorter still
            looked += 1
            scores = self.scores(anchors[going], start, end)
            for at, got in zip(going.tolist(), scores, strict=True):
                kin = self.labels[start:end] == labels[at]
                fits = kin & (self.rows[start:end] != anchor_rows[at]) if same else ~kin
                for slot, (_, _, high) in enumerate(windows[at]):
                    hits = np.flatnonzero(fits & (got >= floors[at][slot]) & (got <= high))
                    if not len(hits):
                        continue
                    if len(hits) > 4 * k:  # ties with the k-th stay
                        hits = hits[got[hits] >= np.partition(got[hits], len(hits) - k)[len(hits) - k]]
                    new = zip((-got[hits]).tolist(), self.unnamed[start:end][hits].tolist(), self.ids[start:end][hits].tolist(), strict=True)
                    best[at][slot] = sorted([*best[at][slot], *new])[:k]
                    if len(best[at][slot]) == k:
                        floors[at][slot] = max(floors[at][slot], -best[at][slot][-1][0])
                needs[at] = min(floors[at], default=HIGHEST)
        found = [(int(anchor_rows[at]), slot, None if unnamed else i, -less) for at, w in enumerate(windows) for (slot, _, _), rows in zip(w, best[at], strict=True) for less, unnamed, i in rows]
        return found, looked


def _shards(rows: DataFrame, shards: int, shard_vectors: int) -> DataFrame:
    """(shard, longest, payload): rows in ranges of falling norm. Equal norms are parted by the row's hash, so no
    norm, however common, fills a task; a range that came out long gives several payloads."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed(many: int) -> pa.RecordBatch:
            nonlocal held
            both = pa.Table.from_batches(held).combine_chunks()
            part, rest = both.slice(0, many), both.slice(many)
            held = rest.to_batches() if rest.num_rows else []
            ids = part["id"].combine_chunks()
            one = Shard(
                part["row"].to_numpy(), ids.fill_null(0).to_numpy(), np.array(ids.is_null()), part["label"].to_numpy(), np.stack([np.asarray(x, np.int64) for x in part["v"].to_pylist()]).reshape(part.num_rows, -1), part["norm"].to_numpy()
            )
            return pa.RecordBatch.from_arrays([pa.array([float(one.norms[0])]), pa.array([one.to_bytes()], pa.binary())], names=["longest", "payload"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            while sum(x.num_rows for x in held) >= shard_vectors:
                yield packed(shard_vectors)
        if held:
            yield packed(sum(x.num_rows for x in held))

    dealt = rows.repartitionByRange(shards, F.desc("norm"), F.xxhash64("row")).sortWithinPartitions(F.desc("norm"))
    parts = written(dealt.mapInArrow(released(build), "longest double, payload binary"))
    return written(parts.select(F.monotonically_increasing_id().alias("shard"), "longest", "payload"))


def _blocks(anchors: DataFrame, key: str) -> DataFrame:
    """Blocks of anchors (row, label, v, norm, windows) that share ``key`` and need candidates of like norms: (key,
    need, body). ``need``: the least norm that a candidate must have for any of them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(b.schema.get_field_index(key)).to_numpy()
            power = np.frexp(b.column(b.schema.get_field_index("need")).to_numpy())[1]
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(power) != 0)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, z in zip(cuts, cuts[1:], strict=False):
                for at in range(a, z, BLOCK):
                    part = b.slice(at, min(BLOCK, z - at))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as out:
                        out.write_batch(part)
                    need = min(part.column(part.schema.get_field_index("need")).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([int(keys[at])]), pa.array([need], pa.float64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[key, "need", "body"])

    lows = F.array_min(F.transform("windows", lambda w: w["low"]))
    # A limit of zero or less is met by vectors of any norm.
    need = F.when(lows <= 0, 0.0).when(F.col("norm") == 0, float("inf")).otherwise(lows.cast("double") / (F.col("norm") * SLACK))
    rows = anchors.withColumn("need", need).where(F.size("windows") > 0)
    return rows.repartition(key).sortWithinPartitions(key, "need").mapInArrow(released(pack), f"{key} long, need double, body binary")


def _ask(trees: DataFrame, sent: DataFrame, tasks: int, copies: int, same: bool, k: int) -> DataFrame:
    """Blocks (shard, body) against their shards."""

    def ask(parts) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for s, payload, b in parts:
            if s != now:
                now, tree = s, Shard.from_bytes(payload) if payload else None
            found: list[tuple[int, int, int | None, int]] = []
            for body in b.column(b.schema.get_field_index("body")).to_pylist():
                one = pa.ipc.open_stream(body).read_next_batch().to_pydict()
                windows = [[(w["slot"], w["low"], w["high"]) for w in ws] for ws in one["windows"]]
                anchors = np.array(one["v"], np.int64).reshape(len(windows), -1)
                if tree:
                    found += tree.search(np.array(one["row"]), np.array(one["label"]), anchors, np.array(one["norm"]), windows, same, k)[0]
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor", "slot", "id", "score"])

    return stream_by_shard(trees, sent, "shard", tasks, ask, _FOUND, copies)


def mine(
    vectors: DataFrame, is_anchor, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, shard_vectors: int = SHARD_VECTORS
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    An anchor (``is_anchor``, a condition over vec_id) has as positives its ``positives`` best other rows of its label.
    For each of them the ``negatives`` best rows of other labels are returned whose score is at least ``low`` and
    at most ``high`` percent of the positive's. Ties go to the smaller vec_id, and last to rows without one.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A vec_id that comes twice
    is two rows: each asks, and each is the other's candidate. A row without vec_id is a candidate, never an anchor.
    Components that a shorter vector lacks count as zero. Other columns are ignored. No rows, or none that qualify,
    give no rows. Windows of positives that score below zero hold nothing.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2_048)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = written(integers(vectors, F.col("label") if label is None else label, vec_id, embedding, scale))
    n, shortest, length = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n or not length:
        return spark.createDataFrame([], schema)
    if shortest != length:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("v"))))
    trees = _shards(rows, max(1, -(-n // shard_vectors)), shard_vectors)
    # One number a shard of ``shard_vectors`` rows, by falling norm.
    bounds = trees.select("shard", "longest").orderBy(F.desc("longest"), "shard").collect()
    numbers, longest = [b.shard for b in bounds], [b.longest for b in bounds]
    shards = len(numbers)
    copies = max(1, spark.sparkContext.defaultParallelism // shards)
    by_place = F.array(*[F.lit(s) for s in numbers])
    anchors = rows.where(F.coalesce(is_anchor(F.col("id")), F.lit(False)))

    def reach(blocks: DataFrame) -> DataFrame:
        """A row for each shard but home that is long enough for one of a block's anchors: of all shards the first ones."""
        many = F.size(F.filter(F.array(*[F.lit(x) for x in longest]), lambda x: x >= F.col("need")))
        sent = blocks.where(many > 0).withColumn("at", F.explode(F.sequence(F.lit(0), many - 1))).where(F.col("at") != F.col("home"))
        return sent.select(F.get(by_place, F.col("at")).alias("shard"), "body")

    def search(asking: DataFrame, same: bool, k: int) -> DataFrame:
        """The k best in each of an anchor's windows: at one shard of long vectors first, then wherever the k-th score
        found there can be beaten."""
        homes = asking.withColumn("home", F.pmod(F.xxhash64("row"), F.lit(max(1, shards // 8))))
        first = _blocks(homes, "home").select(F.get(by_place, F.col("home").cast("int")).alias("shard"), "body")
        at_home = written(_ask(trees, first, shards * copies, copies, same, k))
        if shards == 1:
            return _best(at_home, k)
        kth = at_home.groupBy("anchor", "slot").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
        kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("least"))  # a window each
        raised = F.transform("windows", lambda w: F.struct(w["slot"].alias("slot"), F.greatest(w["low"], F.col("least")[w["slot"]]).alias("low"), w["high"].alias("high")))
        bounded = homes.join(kth, F.col("row") == F.col("anchor"), "left").withColumn("windows", F.when(F.col("least").isNull(), F.col("windows")).otherwise(raised)).drop("anchor", "least")
        return _best(at_home.unionByName(_ask(trees, reach(_blocks(bounded, "home")), shards * copies, copies, same, k)), k)

    whole = F.array(F.struct(F.lit(0).alias("slot"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")))
    chosen = written(search(anchors.withColumn("windows", whole), True, positives).drop("slot").withColumnRenamed("rank", "slot").withColumnsRenamed({"id": "positive_id", "score": "positive_score"}))
    # Negatives: a window for each positive, from ``low`` to ``high`` percent of its score.
    p = F.col("positive_score").cast("decimal(38,0)")
    window = F.struct(F.col("slot"), F.ceil(p * low / 100).cast("long").alias("low"), F.floor(p * high / 100).cast("long").alias("high"))
    windows = chosen.where("positive_score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_list(window)).alias("windows"))  # at most ``positives`` each
    hard = search(anchors.join(windows, F.col("row") == F.col("anchor")).drop("anchor"), False, negatives)
    named = hard.join(chosen, ["anchor", "slot"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and slot, of at most k from each shard."""
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
