"""Counts kept up by changes, in Spark's own state store.

A changed file is read and counted in the batch that reports it (``recounted``). A keyed state holds the newest count of
each model and path; what is newer takes its place, and leaves as two deltas: the old count off, the new one on
(``deltas``). Totals are sums of deltas (``totals``), by whatever they are grouped, streaming or not, so that no change is
ever answered by counting all files again. What is newest goes by a total order of all that a row says, so repeats,
late rows and batches in any order end in the same state.

``debounced`` fires once a key has been quiet for a while, by a timer that each event sets anew, and needs no later event.
``current`` lets through only results of the newest request of their key.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import columns as C
from ..operators.count import count_tokens
from ..plans import registry as R
from ..shipping import ship
from ..sources.discover import read_texts
from ..sources.places import Schemes
from ..sources.vocabulary import VocabularyStore

#: What a count says: of ``generation``, the newest wins; in it the newest ``version``; of equals, a deletion.
COUNTED = "model_id string, path string, folder string, language string, generation bigint, version bigint, deleted boolean, count bigint, exact boolean"
_HELD = "folder string, language string, generation bigint, version bigint, deleted boolean, count bigint, exact boolean"
#: What a change leaves: files, tokens and inexact files more or less.
DELTA = "model_id string, path string, folder string, language string, generation bigint, version bigint, files bigint, tokens bigint, inexact bigint"


#: State as timers and several values need it; batches write what changed, not all state; all states of an executor
#: share its memory, and nothing is set aside on disk for those that are small.
_ROCKSDB = {
    "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "rocksdb.changelogCheckpointing.enabled": "true",
    "rocksdb.allowFAllocate": "false",
    "rocksdb.boundedMemoryUsage": "true",
    "rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """For queries that start inside: state is kept in RocksDB. The session's settings come back afterwards; a query
    that has started keeps its own."""
    names = {f"spark.sql.streaming.stateStore.{k}": v for k, v in _ROCKSDB.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class _Newest(StatefulProcessor):
    """Holds the newest count of a model and path."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _HELD)

    @staticmethod
    def order(row: tuple) -> tuple:
        """All that a row (as in ``_HELD``) says, newest last."""
        folder, language, generation, version, deleted, count, exact = row
        return generation, version, deleted, count, exact, folder or "", language or ""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [f.split(" ")[0] for f in _HELD.split(", ")]
        old = best = tuple(self.held.get()) if self.held.exists() else None
        for pdf in rows:
            for row in zip(*(pdf[n].tolist() for n in names), strict=True):
                if best is None or self.order(row) > self.order(best):
                    best = row
        if best == old:
            return
        self.held.update(best)
        out = [(*key, x[0], x[1], x[2], x[3], sign, sign * x[5], 0 if x[6] else sign) for x, sign in ((old, -1), (best, 1)) if x is not None and not x[4]]
        if out:
            yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in DELTA.split(", ")])

    def close(self) -> None:
        pass


def recounted(changes: DataFrame, model: R.Model | str, store: VocabularyStore | None = None, generation: int = 0, folder: Column | None = None, schemes: Schemes | None = None) -> DataFrame:
    """``COUNTED`` of changes (ts, path, op): files that were saved or created are read and counted here and now; those
    that were deleted or renamed, or cannot be read as text, are gone. A change's time is its version. Works on
    streams and tables. Changes without a path or a time are nothing."""
    gone = F.coalesce(F.col("op").isin("delete", "rename"), F.lit(False))
    fresh = changes.where("path is not null and ts is not null").select("path", F.unix_micros("ts").alias("version"), F.when(~gone, F.col("path")).alias("at"))
    # What is gone has no place to be read from.
    return counts_of(read_texts(fresh, "at", schemes).select("path", "version", "text"), model, store, generation, folder)


def counts_of(texts: DataFrame, model: R.Model | str, store: VocabularyStore | None = None, generation: int = 0, folder: Column | None = None) -> DataFrame:
    """``COUNTED`` of texts (path, version, text); a null text is of a file that is gone. ``folder``: what totals group by,
    of the column path; else the file's directory."""
    found = _known(model)
    counted = count_tokens(texts.select("path", "version", "text", F.col("text").isNull().alias("deleted")), found, store=store)
    return counted_as(counted, found, generation, folder)


def counted_as(counted: DataFrame, model: R.Model | str, generation: int = 0, folder: Column | None = None) -> DataFrame:
    """``COUNTED`` of texts that are counted already (path, version, deleted, count, exact): where many changes bring the
    same texts, these need not travel with each."""
    parts = C.segments("path")
    within = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/") if folder is None else folder
    return counted.select(
        F.lit(_known(model).model_id).alias("model_id"), "path", within.alias("folder"), C.language("path").alias("language"), F.lit(generation).cast("bigint").alias("generation"), F.col("version").cast("bigint").alias("version"), "deleted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), F.coalesce("exact", F.lit(False)).alias("exact")
    )


def _known(model: R.Model | str) -> R.Model:
    found = model if isinstance(model, R.Model) else R.find_model(model)
    if found is None:
        raise ValueError(f"no such model: {model}")
    return found


def deltas(counted: DataFrame) -> DataFrame:
    """``DELTA`` of a stream of ``COUNTED``: a file's old count off, its new one on."""
    ship(counted.sparkSession)
    return counted.groupBy("model_id", "path").transformWithStateInPandas(_Newest(), DELTA, "Append", "None")


def totals(changed: DataFrame, *by: str) -> DataFrame:
    """Files, tokens and whether all are exact, of ``DELTA``; groups without files are gone. On a stream the sums
    themselves are state, and a group that is gone comes with no files, so that a sink can drop it. Of several
    generations only the newest counts where ``by`` does not name it: filter streams by it before."""
    rows = changed
    if "generation" not in by and not changed.isStreaming:
        newest = F.broadcast(changed.agg(F.max("generation").alias("__newest")))  # one row
        rows = changed.join(newest, F.col("generation") == F.col("__newest"))
    sums = rows.groupBy(*by).agg(F.sum("files").alias("files"), F.sum("tokens").alias("tokens"), F.sum("inexact").alias("inexact"))
    kept = sums if changed.isStreaming or not by else sums.where("files > 0")
    return kept.select(*by, F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("inexact", F.lit(0)) == 0).alias("exact"))


def start(rows: DataFrame, folder: str, checkpoint: str, once: bool = True, every: str = "1 second") -> StreamingQuery:
    """Write a stream to a folder of Parquet files, each batch once, whatever fails: until the source is read up
    (``once``), or for as long as it runs."""
    with rocksdb(rows.sparkSession):
        out = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
        return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


def keep_counts(changes: DataFrame, model: R.Model | str, folder: str, checkpoint: str, store: VocabularyStore | None = None, generation: int = 0, schemes: Schemes | None = None, once: bool = True) -> StreamingQuery:
    """A query that recounts what changes say, and leaves deltas in ``folder``; its checkpoint holds the counts. To
    count all anew (another vocabulary, other rules), start it again with the next generation: totals are of the newest
    only, and what an older one still brings changes nothing."""
    return start(deltas(recounted(changes, model, store, generation, schemes=schemes)), folder, checkpoint, once)


def counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(model_id, path, version, generation, count, exact) as the state of ``keep_counts`` has them after its last
    batch."""
    with rocksdb(spark):
        rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held").load()
        held = rows.select("key.model_id", "key.path", "value.*").where("not deleted")
        return held.select("model_id", "path", "version", "generation", "count", "exact")


class _Quiet(StatefulProcessor):
    """Counts events until none has come for ``gap`` milliseconds."""

    def __init__(self, gap: int, fields: list[str]):
        self.gap, self.fields = gap, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.burst = handle, handle.getValueState("burst", "first_ms bigint, events bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, n = timerValues.getCurrentProcessingTimeInMs(), sum(len(pdf) for pdf in rows)
        first, before = self.burst.get() if self.burst.exists() else (now, 0)
        self.burst.update((first, before + n))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(now + self.gap)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.burst.exists():
            first, n = self.burst.get()
            self.burst.clear()
            at = expiredTimerInfo.getExpiryTimeInMs()
            yield pd.DataFrame([(*key, pd.Timestamp(first, unit="ms"), pd.Timestamp(at, unit="ms"), n)], columns=self.fields)

    def close(self) -> None:
        pass


def debounced(events: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """(keys, first_ts, fires_at, events): a row for each burst of a stream's events, once its key has been quiet for
    ``gap_ms`` by the clock. Each event sets the timer anew; it runs out without any later event."""
    ship(events.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "first_ts timestamp", "fires_at timestamp", "events bigint"])
    return events.select(*keys).groupBy(*keys).transformWithStateInPandas(_Quiet(gap_ms, [*keys, "first_ts", "fires_at", "events"]), schema, "Append", "ProcessingTime")


class _Current(StatefulProcessor):
    """Remembers a key's newest request, and whether its result has gone out."""

    def __init__(self, fields: list[str]):
        self.fields = fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "generation bigint, answered boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        generation, answered = self.newest.get() if self.newest.exists() else (-1, False)
        result = None
        for pdf in rows:
            for g, value in zip(pdf["generation"].tolist(), pdf["result"].tolist(), strict=True):
                if g > generation:
                    generation, answered, result = g, False, None
                if g == generation and not answered and isinstance(value, str) and (result is None or value < result):
                    result = value  # of several results of one request the smallest: order tells nothing
        if result is not None:
            answered = True
            yield pd.DataFrame([(*key, generation, result)], columns=self.fields)
        self.newest.update((generation, answered))

    def close(self) -> None:
        pass


def current(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, generation, result) of a stream of requests and results (keys, generation, result; a request's result is
    null): each key's result once, if no newer request was known when it came. What comes of superseded work, and
    what comes again, is dropped; a result that overtakes its own request is not."""
    ship(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "generation bigint", "result string"])
    fine = rows.where("generation is not null").select(*keys, F.col("generation").cast("bigint").alias("generation"), F.col("result").cast("string").alias("result"))
    return fine.groupBy(*keys).transformWithStateInPandas(_Current([*keys, "generation", "result"]), schema, "Append", "None")
