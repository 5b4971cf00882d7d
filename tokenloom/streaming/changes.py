"""Change feeds, as tables and streams. What keeps state is in ``live``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CHANGES = "ts timestamp, path string, op string"
#: Quiet time after which a status, or a whole project, is counted anew.
STATUS_GAP, PROJECT_GAP = "300 milliseconds", "2 seconds"


def debounce(events: DataFrame, keys: list[str], gap: str = PROJECT_GAP, ts: str = "ts") -> DataFrame:
    """One row for each burst of a table's events: those no further apart than the gap, which fires once after
    it. Works on streams too, behind a watermark, which only later events move: ``live.debounced`` needs none."""
    rows = events.where(F.col(ts).isNotNull()).groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return rows.agg(F.count("*").alias("events")).select(*keys, F.col("w.start").alias("first_ts"), F.col("w.end").alias("fires_at"), "events")


def read_changes(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of changes from JSON files that arrive in a folder."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).json(folder)


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path."""
    order = W.partitionBy("path").orderBy(F.desc("ts"), "op")
    return changes.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
