"""Exports by all tasks, progress of running jobs, and vocabularies that executors hold."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tokenloom import progress
from tokenloom.operators import tokenizers as T
from tokenloom.plans import report
from tokenloom.sources import export


@pytest.fixture(autouse=True)
def many_tasks(spark):
    """Rows as few as these would be gathered into one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def whole(folder):
    return "".join(open(os.path.join(folder, p["name"])).read() for p in export.listed(folder))


def test_parts_in_order(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.range(5000, numPartitions=7).orderBy(F.desc("id")).select(F.col("id").cast("string").alias("line"))
    export.write_lines(rows, folder, "head")
    assert whole(folder).splitlines() == ["head", *map(str, range(4999, -1, -1))]
    parts = export.listed(folder)
    assert len(parts) > 2 and sum(p["rows"] for p in parts) == 5001 and sum(p["bytes"] for p in parts) == len(whole(folder))
    back = export.read_lines(spark, folder)
    assert back.where("part = 0").first().line == "head" and back.count() == 5001
    # Another export takes its place, and its parts go.
    export.write_lines(rows.limit(1), folder)
    assert whole(folder) == "4999\n" and len(os.listdir(folder)) == 2
    export.write_lines(rows.limit(0), folder)
    assert whole(folder) == "" and export.read_lines(spark, folder).count() == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    bad = spark.range(100, numPartitions=5).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception, match="broken"):
        export.write_lines(bad, folder)
    assert export.listed(folder) == [] and [x for x in os.listdir(folder) if not x.startswith(".")] == [] if os.path.isdir(folder) else True
    export.write_lines(spark.createDataFrame([("a",), (None,)], "line string"), folder)
    with pytest.raises(Exception, match="broken"):
        export.write_lines(bad, folder)
    assert sorted(whole(folder).splitlines()) == ["", "a"]  # what was there stays


def test_csv_has_no_single_task(spark, tmp_path):
    listing = spark.range(3000, numPartitions=4).orderBy("id").select(F.concat(F.lit("f"), "id").alias("display"), F.col("id").alias("tokens"))
    report.write_csv(listing, str(tmp_path / "csv"))
    lines = whole(str(tmp_path / "csv")).splitlines()
    assert lines[:2] == [report.HEADER, '"f0","0"'] and lines[-1] == '"f2999","2999"' and len(export.listed(str(tmp_path / "csv"))) > 2


def test_progress_of_a_running_job(spark):
    marks = []

    @F.pandas_udf("bigint")
    def slow(x):
        time.sleep(0.4)
        return x

    with progress.watched(spark, lambda done, known: marks.append((done, known)), every=0.05):
        assert spark.range(24, numPartitions=12).select(slow("id").alias("x")).agg(F.sum("x")).first()[0] == 276
    done = [d for d, _ in marks]
    assert done == sorted(done) and len(set(done)) >= 3 and done[-1] >= 12 and all(d <= n for d, n in marks)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    with pytest.raises(ZeroDivisionError), progress.watched(spark, lambda *_: None):
        raise ZeroDivisionError


def test_vocabularies_in_turn_stay_within_bounds(spark, monkeypatch):
    """Five in turn, then the first again: what is sent stays below the bound, and counts are right."""
    made = [T.RankVocabulary(T.synthetic_ranks() | {bytes([i, 65, 65]) * (i + 1): 1000 + j for j, i in enumerate(range(97, 97 + n))}) for n in (3, 4, 5, 6, 7)]
    T._sent.clear()
    size = os.path.getsize(T.send(spark, made[0])._path)
    monkeypatch.setattr(T, "SENT_BYTES", int(size * 2.5))
    gone = []
    plain = T.Broadcast.unpersist
    monkeypatch.setattr(T.Broadcast, "unpersist", lambda self, *a: (gone.append(self), plain(self, *a)))
    df = spark.createDataFrame([("hello",), ("aAA",), (None,)], "text string")
    want = [[r["count"] for r in T.count_exact(df, v).collect()] for v in made]
    assert len(gone) >= 3 and sum(s for _, _, s in T._sent.values()) <= T.SENT_BYTES
    assert [[r["count"] for r in T.count_exact(df, v).collect()] for v in made] == want
    assert T.send(spark, made[4]) is T.send(spark, made[4])
    monkeypatch.setattr(T, "KEPT_BYTES", 1)
    assert [r["count"] for r in T.count_exact(df, made[0]).collect()] == want[0]
