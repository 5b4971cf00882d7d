"""The folder that driver and executors share, and tables that are written to it once."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, on one machine, a new temporary
    folder, set for the session; a cluster must name one, as its executors write where the driver reads."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tokenloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: The folder of the innermost ``scratch``.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go when it ends, also by an error. The value writes a table that stays: nothing else made
    inside may be read outside."""
    around = _scratch.get()
    folder = f"{around or shared_dir(spark)}/s-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        inner = _scratch.set(around)
        try:
            return written(df)
        finally:
            _scratch.reset(inner)

    here = _scratch.set(folder)
    try:
        yield keep
    finally:
        _scratch.reset(here)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet into the shared folder (inside ``scratch``: into its own there) and
    read them again."""
    path = f"{_scratch.get() or shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
