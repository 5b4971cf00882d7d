"""Counts kept up by changes: retractions, recounts, timers and generations, against batch recounts."""

import json
import random
import time

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tokenloom.plans import registry as R
from tokenloom.streaming import changes, live

COUNTED = live.COUNTED


def feed(folder, batches):
    """A stream of rows: a file of JSON for each batch, read in this order."""
    folder.mkdir(exist_ok=True)
    for rows in batches:
        n = len(list(folder.iterdir()))
        at = folder / f"{n:04d}.json"
        at.write_text("\n".join(json.dumps(r) for r in rows))
        import os

        os.utime(at, (1_000_000 + n, 1_000_000 + n))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def run(spark, tmp_path, batches):
    feed(tmp_path / "in", batches)
    live.start(live.deltas(stream(spark, tmp_path / "in", COUNTED)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    return spark.read.schema(live.DELTA).parquet(str(tmp_path / "out"))


def row(path, version, count, deleted=False, generation=0, exact=True):
    return {"model_id": "m", "path": path, "folder": path[:2], "language": path[-1], "generation": generation, "version": version, "deleted": deleted, "count": count, "exact": exact}


def recount(rows, by):
    """All rows counted at once: the newest of each path."""
    newest = {}
    for r in rows:
        order = (r["generation"], r["version"], r["deleted"], r["count"], r["exact"], r["folder"], r["language"])
        if r["path"] not in newest or order > newest[r["path"]][0]:
            newest[r["path"]] = (order, r)
    last = max((r["generation"] for _, r in newest.values()), default=0)
    out = {}
    for _, r in newest.values():
        if not r["deleted"] and r["generation"] == last:
            f, t, e = out.get(r[by], (0, 0, True))
            out[r[by]] = (f + 1, t + r["count"], e and r["exact"])
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_totals_equal_a_recount(spark, tmp_path, seed):
    """Saves, deletions, renamings and repeats, dealt to batches in any order."""
    r = random.Random(seed)
    rows = []
    for v in range(60):
        path = f"/{r.choice('ab')}/f{r.randrange(8)}.{r.choice('xy')}"
        rows.append(row(path, v, r.randrange(100), r.random() < 0.25, 1 if seed and v > 30 else 0, r.random() < 0.7))
        if r.random() < 0.2:  # a renaming: gone there, new here
            rows += [row(path, v + 0, 0, True), row(path + "x", v, 7)]
    rows += r.choices(rows, k=20)
    r.shuffle(rows)
    cuts = sorted(r.randrange(len(rows)) for _ in range(2))
    out = run(spark, tmp_path, [rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :]])
    for by in ("folder", "language"):
        assert {x[by]: (x.files, x.tokens, x.exact) for x in live.totals(out, by).collect()} == recount(rows, by)
    whole = recount([x | {"folder": ""} for x in rows], "folder").get("", (0, 0, True))
    assert tuple(live.totals(out).first()) == whole
    held = {x.path: (x.version, x["count"]) for x in live.counts(spark, str(tmp_path / "cp")).collect()}
    assert sum(c for _, c in held.values()) >= whole[1] and all(p in {x["path"] for x in rows} for p in held)
    # The same files again leave nothing.
    n = out.count()
    assert run(spark, tmp_path, [rows[:30]]).count() == n


def test_totals_of_nothing(spark):
    none = spark.createDataFrame([], live.DELTA)
    assert live.totals(none, "folder").count() == 0 and tuple(live.totals(none).first()) == (0, 0, True)


def test_totals_as_a_stream(spark, tmp_path):
    """Sums are state themselves: two queries, each a part of the way."""
    run(spark, tmp_path, [[row("/a/1", 1, 5), row("/a/2", 1, 6)], [row("/a/1", 2, 50), row("/a/2", 2, 0, True), row("/b/1", 1, 1, exact=False)]])
    changed = spark.readStream.schema(live.DELTA).parquet(str(tmp_path / "out"))
    q = live.totals(changed, "folder").writeStream.format("memory").queryName("live_sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(x) for x in spark.table("live_sums").collect()) == [("/a", 1, 50, True), ("/b", 1, 1, False)]


def change(path, second, op="save"):
    return {"ts": f"2024-01-01T00:00:{second:02d}Z", "path": str(path), "op": op}


def test_a_change_recounts_its_file(spark, tmp_path):
    work = tmp_path / "work"
    work.mkdir()
    (work / "a.ts").write_text("x" * 10)
    (work / "b.py").write_text("y" * 20)
    (work / "c.bin").write_bytes(b"\0")
    model = R.BY_ID["claude-opus-5"]

    def keep(rows):
        feed(tmp_path / "in", [rows])
        live.keep_counts(changes.read_changes(spark, str(tmp_path / "in")), model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return {x.path[len(str(work)) + 1 :]: x["count"] for x in live.counts(spark, str(tmp_path / "cp")).collect()}

    size = lambda n: -(-n * 10 // round(model.ratio * 10))
    assert keep([change(work / "a.ts", 1, "create"), change(work / "b.py", 1), change(work / "c.bin", 1), change(work / "none", 1)]) == {"a.ts": size(10), "b.py": size(20)}
    (work / "a.ts").write_text("x" * 1000)
    assert keep([change(work / "a.ts", 2), change(work / "a.ts", 3), {"op": "save"}]) == {"a.ts": size(1000), "b.py": size(20)}
    assert keep([change(work / "b.py", 4, "rename"), change(work / "a.ts", 0, "delete")]) == {"a.ts": size(1000)}  # an older deletion is late
    out = spark.read.schema(live.DELTA).parquet(str(tmp_path / "out"))
    assert [tuple(x) for x in live.totals(out, "language").collect()] == [("TypeScript", 1, size(1000), False)]


def test_a_failed_batch_runs_again(spark, tmp_path):
    """The storage fails once, in the middle of a batch: the batch leaves nothing, and runs again with the same result."""
    (tmp_path / "work").mkdir()
    for i in range(6):
        (tmp_path / "work" / f"f{i}").write_text("x" * i)
    broken, work = tmp_path / "broken", str(tmp_path / "work")
    broken.write_text("")

    def opened():
        import os

        if os.path.exists(str(broken)):
            raise RuntimeError("the storage is away")
        return fs.SubTreeFileSystem(work, fs.LocalFileSystem())

    feed(tmp_path / "in", [[change(f"vault:///f{i}", i) for i in range(6)]])
    keep = lambda: live.keep_counts(changes.read_changes(spark, str(tmp_path / "in")), "o3", str(tmp_path / "out"), str(tmp_path / "cp"), schemes={"vault": opened})
    with pytest.raises(Exception, match="away"):
        keep().awaitTermination()
    broken.unlink()
    for _ in range(2):  # the second has nothing left to do
        keep().awaitTermination()
    out = spark.read.schema(live.DELTA).parquet(str(tmp_path / "out"))
    assert tuple(live.totals(out).first())[0] == 6 and out.count() == 6


def test_quiet_streams_fire(spark, tmp_path):
    """No later event is needed, and each one puts it off."""
    feed(tmp_path / "in", [[{"k": "a"}, {"k": "a"}], [{"k": "b"}], [{"k": "a"}]])
    with live.rocksdb(spark):
        q = live.debounced(stream(spark, tmp_path / "in", "k string"), ["k"], 1_500).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    try:
        fired = lambda: spark.table("fired").groupBy("k").agg(F.sum("events").alias("n")).collect()

        def wait(n):
            until = time.time() + 120
            while sum(x.n for x in fired()) < n and time.time() < until:
                time.sleep(0.3)

        wait(4)
        feed(tmp_path / "in", [[{"k": "a"}]])
        wait(5)
        time.sleep(2)  # nothing fires twice
        assert sorted((x.k, x.n) for x in fired()) == [("a", 4), ("b", 1)]
        rows = spark.table("fired").collect()
        # A slow machine may part a burst, but never a batch, and nothing fires before its time.
        assert len(rows) <= 4 and all((x.fires_at - x.first_ts).total_seconds() >= 1.5 for x in rows)
    finally:
        q.stop()


def test_superseded_results_are_dropped(spark, tmp_path):
    schema = "k string, generation bigint, result string"
    ask, answer = (lambda k, g: {"k": k, "generation": g}), (lambda k, g, x: {"k": k, "generation": g, "result": x})
    feed(tmp_path / "in", [
        [ask("a", 1), ask("b", 1), answer("c", 5, "before its request")],
        [ask("a", 2), answer("a", 1, "late"), ask("c", 5), {"k": "a"}],
        [answer("a", 1, "later"), answer("b", 1, "b1"), answer("c", 5, "again")],
        [answer("a", 2, "a2"), ask("a", 1), answer("b", 1, "b1")],
    ])
    live.start(live.current(stream(spark, tmp_path / "in", schema), ["k"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.schema(schema).parquet(str(tmp_path / "out"))
    assert sorted(tuple(x) for x in out.collect()) == [("a", 2, "a2"), ("b", 1, "b1"), ("c", 5, "before its request")]


@pytest.mark.parametrize("seed", [0, 1])
def test_whatever_the_order_the_newest_result_is_the_last(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [x for k in "abc" for g in range(5) for x in ({"k": k, "generation": g}, {"k": k, "generation": g, "result": f"{k}{g}"})]
    r.shuffle(rows)
    feed(tmp_path / "in", [rows[:10], rows[10:20], rows[20:]])
    schema = "k string, generation bigint, result string"
    live.start(live.current(stream(spark, tmp_path / "in", schema), ["k"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.schema(schema).parquet(str(tmp_path / "out"))
    assert out.groupBy("k").agg(F.max_by("result", "generation").alias("last"), F.count("*").alias("n"), F.countDistinct("generation").alias("d")).where("last != concat(k, '4') or n != d").count() == 0
    seen = -1
    for batch in (rows[:10], rows[10:20], rows[20:]):
        known = max([seen, *(x["generation"] for x in batch if x["k"] == "a")])
        got = [x.generation for x in out.where("k = 'a'").collect()]
        assert all(x["generation"] not in got for x in batch if x["k"] == "a" and x.get("result") and x["generation"] < known)
        seen = known


def test_live_totals_sends_counts_instead_of_texts(spark, monkeypatch):
    """A document that many events save is counted once; no text goes through the stream."""
    from tokenloom.plans import catalog

    seen, deltas = [], catalog.live.deltas
    monkeypatch.setattr(catalog.live, "deltas", lambda counted: seen.append(counted._jdf.queryExecution().analyzed().toString()) or deltas(counted))
    assert catalog.queries()["live_totals"](spark, "/root/testdata/sf0.001").count() > 0
    assert "event_id" in seen[0] and "text#" not in seen[0]
