"""Exact top-k search by inner product over KD-trees, one a shard.

Each shard's vectors are split at medians, widest dimension first, into leaves with tight bounding
boxes. A box bounds the inner product of any query with what it holds, so each query visits leaves
best bound first and stops at the first that cannot reach its k-th score. That score travels: a
query first searches one shard, and takes what it found to all others as a bound.

Shards hold ``SHARD_VECTORS`` vectors each, however many there are; queries come as blocks, which
stream past each shard's tree.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stream_by_shard, written

SHARD_VECTORS = 16_384
LEAF = 128
BLOCK = 256
NONE = np.iinfo(np.int64).min
#: Stands for a vec_id that is null, behind all others.
UNNAMED = np.iinfo(np.int64).max


class KdTree:
    """Nodes in one array: leaves own ranges of the reordered vectors, and all have boxes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, children: np.ndarray, ranges: np.ndarray):
        self.ids, self.rows, self.vectors, self.low, self.high, self.children, self.ranges = ids, rows, vectors, low, high, children, ranges

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> KdTree:
        """``ids`` name vectors in results, ``rows`` tell vectors of the same id apart."""
        order, low, high, children, ranges = np.argsort(ids, kind="stable"), [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own, node = vectors[order[a:b]], len(low)
            low.append(own.min(axis=0)), high.append(own.max(axis=0)), children.append([-1, -1]), ranges.append([a, b])
            if parent >= 0:
                children[parent][side] = node
            wide = int((high[-1] - low[-1]).argmax())
            if b - a > leaf and high[-1][wide] > low[-1][wide]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], middle, kind="introselect")]
                todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        return cls(ids[order], rows[order], vectors[order], np.array(low), np.array(high), np.array(children), np.array(ranges))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, rows=self.rows, vectors=self.vectors, low=self.low, high=self.high, children=self.children, ranges=self.ranges)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, blob: bytes) -> KdTree:
        return cls(**np.load(io.BytesIO(blob)))

    def search(self, queries: np.ndarray, query_rows: np.ndarray, bounds: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query its (score, -id) best k here, without itself and without what is below its
        bound (a score that k others are known to reach)."""
        # Products of a query with the nearer of a box's sides, summed: what no vector inside exceeds.
        most = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        out = []
        for q, own, bound, top in zip(queries, query_rows, bounds, most, strict=True):
            best: list[tuple[int, int]] = []
            floor, open_nodes = int(bound), [(-int(top[0]), 0)]
            while open_nodes:
                reach, node = heapq.heappop(open_nodes)
                if -reach < floor:  # an equal score may still win by its id
                    break
                left, right = self.children[node]
                if left >= 0:
                    for child in (left, right):
                        if top[child] >= floor:
                            heapq.heappush(open_nodes, (-int(top[child]), int(child)))
                    continue
                a, b = self.ranges[node]
                got = self.vectors[a:b] @ q
                at = np.flatnonzero((got >= floor) & (self.rows[a:b] != own))
                for s, i in zip(got[at].tolist(), self.ids[a:b][at].tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    floor = max(floor, best[0][0])
            out.append(sorted(best, reverse=True))
        return out


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(row long, id long, v array<long>): floor(scale * x) of each component, and a number for each row.
    Null vectors, and vectors with null or non-finite components, take no part; a null id is ``UNNAMED``."""
    whole = F.col(embedding).cast("array<double>")
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(embedding).isNotNull() & fine)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(vec_id).cast("long"), F.lit(int(UNNAMED))).alias("id"), F.transform(whole, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query row's k highest integer inner products with
    all rows but itself, ties to the smaller vec_id; fewer, if there are fewer rows.

    ``is_query``: a condition over vec_id. A vec_id that comes twice asks twice, and each of its rows is a
    candidate for the other. A row without vec_id is a candidate, last of those that tie, and never asks. Components that a shorter vector lacks count as zero. Extra columns are
    ignored. Products must fit in 64 bits.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    rows = written(integers(vectors, vec_id, embedding, scale))
    n, shortest, length = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    length = max(1, length or 0)
    if shortest != length:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("v"))))
    shards = max(1, -(-n // shard_vectors))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = KdTree.build(pdf["id"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.int64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "payload": [tree.to_bytes()]})

    trees = written(dealt.groupBy("shard").applyInPandas(build, "shard long, payload binary"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                own, ids, bounds = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("row", "id", "bound"))
                home, v = part.column(part.schema.get_field_index("home"))[0].as_py(), part.column(part.schema.get_field_index("v"))
                blobs = [pa.array([x.tobytes()]) for x in (own, ids, _matrix(v), bounds)]
                yield pa.RecordBatch.from_arrays([pa.array([home]), *blobs], names=["home", "own", "ids", "v", "bounds"])

    def ask(parts) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for s, payload, b in parts:
            if s != now:
                now, tree = s, KdTree.from_bytes(payload) if payload else None
            out: list[tuple[int, int, int, int]] = []
            for own, ids, v, bounds in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("own", "ids", "v", "bounds")), strict=True):
                own, ids, bounds = (np.frombuffer(x, np.int64) for x in (own, ids, bounds))
                found = tree.search(np.frombuffer(v, np.int64).reshape(len(own), -1), own, bounds, k) if tree else []
                out += [(int(r), int(q), -i, s) for r, q, best in zip(own, ids, found, strict=False) for s, i in best]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

    block_schema, found_schema = "home long, own binary, ids binary, v binary, bounds binary", "query_row long, query_id long, vec_id long, score long"
    queries = rows.where((F.col("id") != int(UNNAMED)) & F.coalesce(is_query(F.col("id")), F.lit(False)))
    # Each query at home: the shard that its block is dealt to.
    homes = queries.select("row", "id", "v", F.lit(int(NONE)).alias("bound"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("home")).repartition("home").sortWithinPartitions("home")
    first = written(_by_home(homes, blocks, block_schema))
    tasks = max(shards, spark.sparkContext.defaultParallelism)
    copies = max(1, tasks // shards)
    at_home = written(stream_by_shard(trees, first.withColumnRenamed("home", "shard"), "shard", shards * copies, ask, found_schema, copies))
    if shards == 1:
        return _ranked(at_home, k)
    # The k-th score found at home bounds the search of all other shards.
    kth = at_home.groupBy("query_row").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    bounded = homes.drop("bound").join(kth.where(F.col("n") >= k), F.col("row") == F.col("query_row"), "left")
    second = bounded.select("row", "id", "v", F.coalesce("least", F.lit(int(NONE))).alias("bound"), "home").repartition("home").sortWithinPartitions("home")
    others = written(_by_home(second, blocks, block_schema)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"))).where("shard != home").drop("home")
    elsewhere = stream_by_shard(trees, others, "shard", shards * copies, ask, found_schema, copies)
    return _ranked(at_home.unionByName(elsewhere), k)


def _by_home(queries: DataFrame, blocks, schema: str) -> DataFrame:
    """Blocks of queries that share a home."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            homes = b.column(b.schema.get_field_index("home")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(homes)) + 1).tolist(), len(homes)] if len(homes) else [0]
            for a, z in zip(cuts, cuts[1:], strict=False):
                yield from blocks(iter([b.slice(a, z - a)]))

    return queries.mapInArrow(split, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """A query has at most k rows from each shard; of these the k best."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("vec_id").alias("vec_id")))), 1, k)
    rows = found.groupBy("query_row", "query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.nullif("b.vec_id", F.lit(int(UNNAMED))).alias("vec_id"), (-F.col("b.less")).alias("score"))
