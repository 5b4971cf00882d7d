"""Text exports written by all tasks at once, and seen whole or not at all.

Each task writes its lines to a part of its own. When all have, the driver writes one listing, which names the parts in the
order of the rows; that takes the place of the one before in one step, and only what it names is the export. A job that
fails takes its parts away and leaves what was there. Nothing is gathered in one task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..shipping import ship
from .places import Places, Schemes

LISTING = "_listing.json"


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int
    bytes: int


class LinesSink(DataSource):
    """``df.write.format("lines").mode("overwrite").option("header", ...).save(folder)`` for one column of strings."""

    schemes: Schemes | None = None

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return LinesWriter(self.options["path"].rstrip("/"), self.options.get("header"), self.schemes)


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, header: str | None, schemes: Schemes | None):
        self.folder, self.header, self.schemes, self.job = folder, header, schemes, f"job-{uuid.uuid4().hex}"

    def _place(self):
        return Places(self.schemes).of(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        place, folder = self._place()
        task, rows, size = TaskContext.get(), 0, 0
        # An attempt that is run again writes a part of its own; the listing names one of them.
        name = f"{self.job}/part-{task.partitionId():06d}-{task.taskAttemptId()}.txt"
        with place.create(f"{folder}/{name}") as out:
            for b in iterator:
                body = "".join(f"{x or ''}\n" for x in b.column(0).to_pylist()).encode()
                out.write(body)
                rows, size = rows + b.num_rows, size + len(body)
        return Part(task.partitionId(), name, rows, size)

    def commit(self, messages: list[Part | None]) -> None:
        place, folder = self._place()
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
        if self.header is not None:
            name = f"{self.job}/header.txt"
            with place.create(f"{folder}/{name}") as out:
                out.write(f"{self.header}\n".encode())
            parts = [Part(-1, name, 1, len(self.header.encode()) + 1), *parts]
        body = json.dumps({"parts": [{"name": m.name, "rows": m.rows, "bytes": m.bytes} for m in parts]})
        place.put(f"{folder}/{LISTING}", body.encode())
        # What no listing names any more.
        for e in list(place.entries(folder)):
            if e.kind == "directory" and e.name.startswith("job-") and e.name != self.job:
                place.remove(f"{folder}/{e.name}")

    def abort(self, messages: list[Part | None]) -> None:
        place, folder = self._place()
        place.remove(f"{folder}/{self.job}")


def register(spark: SparkSession, schemes: Schemes | None = None) -> None:
    ship(spark)
    spark.dataSource.register(type("LinesSink", (LinesSink,), {"schemes": schemes}) if schemes else LinesSink)


def write_lines(lines: DataFrame, folder: str, header: str | None = None, schemes: Schemes | None = None) -> None:
    """Write a column of strings, in the order of the rows. The folder must be one that driver and executors share."""
    register(lines.sparkSession, schemes)
    out = lines.write.format("lines").mode("overwrite")
    (out.option("header", header) if header is not None else out).save(folder)


def listed(folder: str, schemes: Schemes | None = None) -> list[dict]:
    """name, rows and bytes of the parts of an export, in order; none if nothing was ever written whole."""
    place, inner = Places(schemes).of(folder.rstrip("/"))
    try:
        return json.loads(place.read(f"{inner}/{LISTING}", 1 << 30))["parts"]
    except OSError:
        return []


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(part, line) of an export, ``part`` from 0 in order."""
    parts = [p["name"] for p in listed(folder)]
    if not parts:
        return spark.createDataFrame([], "part int, line string")
    names = F.array(*[F.lit(p.rsplit("/", 1)[-1]) for p in parts])
    rows = spark.read.text([f"{folder.rstrip('/')}/{p}" for p in parts])
    return rows.select((F.array_position(names, F.regexp_extract("_metadata.file_path", "[^/]*$", 0)) - 1).cast("int").alias("part"), F.col("value").alias("line"))
