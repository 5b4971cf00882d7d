"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import ARROW_ROWS, release_memory, released, small_batches
from ..storage import scratch, shared_dir, written

__all__ = ["ARROW_ROWS", "release_memory", "released", "scratch", "shared_dir", "small_batches", "written"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pin_splits(spark: SparkSession) -> None:
    """Make every scan of a table cut its files alike, so that rows keep their places from scan to
    scan. Spark cuts small inputs by the number of cores it has just then, which changes when executors
    are lost; from now on it goes by today's number, unless the session names one already."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", max(1, spark.sparkContext.defaultParallelism))


@contextlib.contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """For actions inside: what the JVM would not compile, as the method for a stage is too long, Spark runs
    in smaller ones. The session's setting comes back afterwards."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, 8000)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def input_partitions(df: DataFrame) -> int:
    """How many tasks the input has: a size that follows the data and needs no extra pass."""
    return max(1, df.rdd.getNumPartitions())


def stream_by_shard(
    build: DataFrame,
    probe: DataFrame,
    shard: str,
    n_tasks: int,
    fn: Callable[[Iterator[tuple[int, bytes, pa.RecordBatch]]], Iterator[pa.RecordBatch]],
    schema: str,
    copies: int = 1,
) -> DataFrame:
    """Meet large built state with the rows that probe it, without a join and with bounded memory.

    ``build`` has (shard, payload binary), one row a shard; ``probe`` has the column ``shard``
    and any others. Each shard's payload goes to ``copies`` tasks; probe rows are dealt over the
    copies. In a task, rows are sorted so that the payload precedes the probes, which then stream
    by. ``fn`` gets an iterator of (shard, payload, batch of probe rows) and yields result batches.
    """
    names = [c for c in probe.columns if c != shard]
    fields = [F.col(c).alias(f"p_{i}") for i, c in enumerate(names)]
    nothing = [F.lit(None).cast(probe.schema[c].dataType).alias(f"p_{i}") for i, c in enumerate(names)]
    left = build.select(
        F.col(shard).cast("long").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"),
        F.lit(0).alias("kind"),
        F.col("payload"),
        *nothing,
    )
    right = probe.select(
        F.col(shard).cast("long").alias("shard"),
        # By the row itself: a task that runs again deals its rows alike, in whatever order they come.
        F.pmod(F.xxhash64(*probe.columns), F.lit(copies)).cast("int").alias("copy") if copies > 1 else F.lit(0).alias("copy"),
        F.lit(1).alias("kind"),
        F.lit(None).cast("binary").alias("payload"),
        *fields,
    )
    both = left.unionByName(right).repartition(n_tasks, "shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            held: tuple[int, bytes | None] = (-1, None)
            for batch in batches:
                shards, kinds = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                start = 0
                while start < len(shards):
                    if kinds[start] == 0:
                        held = (shards[start], batch.column(3)[start].as_py())
                        start += 1
                        continue
                    end = start
                    while end < len(shards) and kinds[end] == 1 and shards[end] == shards[start]:
                        end += 1
                    payload = held[1] if held[0] == shards[start] else None
                    columns = [batch.column(4 + i).slice(start, end - start) for i in range(len(names))]
                    yield shards[start], payload, pa.RecordBatch.from_arrays(columns, names=names)
                    start = end

        yield from fn(parts())

    return both.mapInArrow(run, schema)
