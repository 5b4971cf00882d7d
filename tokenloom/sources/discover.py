"""Finding files, and reading those that are to be counted.

Folders are walked by the executors, a level at a time: each job lists the folders that the one before has found,
in as many tasks as these need, and writes what is in them to the shared folder. The driver knows how many there are
and no more. Texts are read by the tasks that count them, and only of files that no earlier test has left out; files are
dealt to these tasks by their bytes. Spark's own file sources are of no use here: they pass over dotfiles, files whose
name begins with an underscore and empty files.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import columns as C
from ..operators.relations import running_total
from ..plans.registry import MAX_BYTES, NEVER_WALKED
from ..shipping import ship
from ..storage import shared_dir, written
from .ignore import IgnoreRules, parse_rules, rules_text
from .places import Local, Places, Schemes

FOUND = "path string, relative string, size bigint, mtime bigint, outcome string"


#: Folders that a task lists, and tasks of one level, at most.
FOLDERS, MOST_TASKS = 64, 10_000
#: Bytes that a task reads, and what opening a file counts for.
TASK_BYTES, OPEN_BYTES = 64 << 20, 64 << 10


def _inside(place, directory: str, below: str, rules: IgnoreRules, prune_ignored: bool) -> Iterator[tuple[str, str, str, int | None, int | None, bool, bool]]:
    """(path, path below the root, outcome, size, mtime, by a link, ignored) of what is in one folder."""
    for e in place.entries(directory):
        path, relative = os.path.join(directory, e.name), f"{below}{e.name}"
        if e.kind == "directory":
            if prune_ignored and rules.is_ignored(relative, True):
                yield path, relative, "ignored-directory", None, None, e.link, True
            elif e.name not in NEVER_WALKED:
                yield path, relative, "directory", None, None, e.link, False
        elif e.kind != "other":
            yield path, relative, e.kind, e.size, e.mtime, e.link, rules.is_ignored(relative)


def walk(root: str, rules: IgnoreRules | None = None, follow_once: bool = True, prune_ignored: bool = True) -> Iterator[tuple[str, str, int | None, int | None, str]]:
    """(path, path below the root, size, mtime in ms, outcome) of what is in a folder of this machine.

    Outcomes: file; ignored-directory (not walked: the rules name it); unreadable (its size cannot be
    told). A directory is known by its real path and walked once (unless ``follow_once`` is off), by the path that is
    fewest folders below the root, and of those the smallest; linked files are files of their own; directories that
    cannot be read hold nothing; the root itself is always walked. Directories that are never walked are reported
    only if the rules name them.
    """
    rules, place = rules or IgnoreRules([]), Local()
    seen, level = {place.real(root)}, [(root, "")]
    while level:
        inner = []
        for directory, below in level:
            for path, relative, outcome, size, mtime, _, _ in sorted(_inside(place, directory, below, rules, prune_ignored)):
                if outcome == "directory":
                    inner.append((path, f"{relative}/"))
                else:
                    yield path, relative, size, mtime, outcome
        level = []
        for path, below in sorted(inner):
            real = place.real(path)
            if not follow_once or real not in seen:
                seen.add(real)
                level.append((path, below))


_LEVEL = "root string, path string, relative string, real string, outcome string, size bigint, mtime bigint, linked boolean, ignored boolean, rules string"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(),) * 5 + (pa.int64(),) * 2 + (pa.bool_(),) * 2 + (pa.string(),)
    columns = list(zip(*rows, strict=True)) or [[]] * 10
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[f.split(" ")[0] for f in _LEVEL.split(", ")])


@lru_cache(maxsize=256)
def _parsed(text: str) -> IgnoreRules:
    return IgnoreRules(parse_rules(text))


def discover(
    spark: SparkSession, roots: list[str] | DataFrame, respect_ignore: bool = True, follow_once: bool = True, prune_ignored: bool = True, schemes: Schemes | None = None, on_progress: Callable[[int], None] | None = None
) -> DataFrame:
    """(root, path, relative, size, mtime, outcome, ignored) of folders and files, as ``walk`` finds them.
    ``ignored``: the rules of the folder name the file. A single file has no rules.

    ``roots``: paths or URIs, or a table with a column root. Each folder has its own rules, which are read where the
    folder is listed. A folder that a link leads to again is left out by an anti join with all that were listed before
    and with those of its level; while no link is met, no path can come twice, and no join is made. A name that is
    no UTF-8 cannot be opened again by its path, and is unreadable. ``on_progress`` gets the number of files found
    so far, after each level.
    """
    ship(spark)
    base = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}"
    asked = spark.createDataFrame([(r,) for r in roots], "root string") if isinstance(roots, list) else roots.select("root")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(schemes)
        for b in batches:
            rows = []
            for root in b.column(0).to_pylist():
                place, path = places.of(root)
                e = place.look(path)
                folder = e.kind == "directory"
                rules = rules_text(place, path) if folder and respect_ignore else None
                rows.append((root, path if folder else root, "" if folder else os.path.basename(root), place.real(path) if folder else None, e.kind, e.size, e.mtime, False, False, rules))
            yield _rows(rows)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, rows = Places(schemes), []
        for b in batches:
            for at in b.to_pylist():
                place, rules = places.of(at["path"])[0], _parsed(at["rules"] or "")
                for path, relative, outcome, size, mtime, link, ignored in _inside(place, at["path"], f"{at['relative']}/" if at["relative"] else "", rules, prune_ignored):
                    linked, real = at["linked"] or link, None
                    try:
                        path.encode()
                    except UnicodeEncodeError:
                        path, relative = (x.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for x in (path, relative))
                        outcome, size, mtime = "unreadable", None, None
                    if outcome == "directory":
                        # What no link leads to is where it says it is.
                        real = place.real(path) if linked else os.path.join(at["real"], path.rsplit("/", 1)[-1])
                    rows.append((at["root"], path, relative, real, outcome, size, mtime, linked, ignored, None))
                    if len(rows) >= 10_000:  # a folder of any size streams by
                        yield _rows(rows)
                        rows = []
        yield _rows(rows)

    def level(rows: DataFrame, n: int) -> tuple[DataFrame, int, int, int]:
        """Written rows, and how many folders, linked folders and files they have."""
        rows.write.parquet(f"{base}/{n}")
        out = spark.read.schema(_LEVEL).parquet(f"{base}/{n}")
        folder = F.col("outcome") == "directory"
        return out, *out.agg(F.count_if(folder), F.count_if(folder & F.col("linked")), F.count_if(F.col("outcome") == "file")).first()

    now, folders, links, files = level(asked.mapInArrow(start, _LEVEL), 0)
    rules, listed, levels = now.where("outcome = 'directory'").select("root", "rules").dropDuplicates(["root"]), [], 1
    linked = False
    if on_progress:
        on_progress(files)
    while folders:
        todo = now.where("outcome = 'directory'").select("root", "path", "relative", "real", "linked")
        linked = linked or links > 0
        if follow_once and linked:
            first = todo.groupBy("root", "real").agg(F.min_by(F.struct("path", "relative", "linked"), "path").alias("f")).select("root", "real", "f.*")
            for earlier in listed:
                first = first.join(earlier.select("root", "real"), ["root", "real"], "left_anti")
            todo = written(first.select("root", "path", "relative", "real", "linked"))
        listed.append(todo)
        if len(listed) > 8 and linked:  # few tables to join with, however deep the folders
            listed = [written(_union([x.select("root", "real") for x in listed]))]
        tasks = min(MOST_TASKS, -(-folders // FOLDERS))
        dealt = todo.join(rules, "root", "left").repartition(tasks, "path")
        now, folders, links, found = level(dealt.select("root", "path", "relative", "real", "linked", "rules").mapInArrow(inside, _LEVEL), levels)
        levels, files = levels + 1, files + found
        if on_progress:
            on_progress(files)
    every = spark.read.schema(_LEVEL).parquet(*[f"{base}/{n}" for n in range(levels)])
    return every.where("outcome != 'directory'").select("root", "path", "relative", "size", "mtime", "outcome", "ignored")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def exclude_glob(names: tuple[str, ...] = NEVER_WALKED) -> str:
    return "{" + ",".join(f"**/{n}/**" for n in names) + "}"


def in_never_walked(path) -> Column:
    """The glob as a condition on a path's directories."""
    parts = C.segments(path)
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(n) for n in NEVER_WALKED]))


def packed(files: DataFrame, size: str = "size", path: str = "path", task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files`` dealt to tasks by their bytes: in the order of their paths, each task gets files until it has
    ``task_bytes`` (opening a file counts as well). So tasks differ by one file at most, and no file is larger than what
    is counted at all. A null size counts as none."""
    weight = F.least(F.coalesce(size, F.lit(0)), F.lit(MAX_BYTES)) + OPEN_BYTES
    placed = running_total(files.withColumn("__weight", weight), [path], tokens="__weight")
    total = placed.agg(F.coalesce(F.max("running_total"), F.lit(0))).first()[0]
    # As many tasks as there are shares, but no fewer than cores where files suffice.
    cores = files.sparkSession.sparkContext.defaultParallelism
    share = max(OPEN_BYTES, min(task_bytes, -(-total // cores)))
    tasks = max(1, -(-total // share))
    at = F.least(F.expr(f"(running_total - 1) div {share}"), F.lit(tasks - 1)).cast("int")
    return placed.repartitionById(tasks, at).drop("__weight", "running_total")


def read_texts(files: DataFrame, path: str = "path", schemes: Schemes | None = None) -> DataFrame:
    """``files`` with skip (unreadable or binary, else null) and text. Bytes are read on the executors, one file at a
    time, from wherever a path's scheme says. Works on streams too."""
    ship(files.sparkSession)
    at = files.columns.index(path)
    schema = files.select("*", F.lit(None).cast("string").alias("read_error"), F.lit(None).cast("binary").alias("content")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(schemes)
        for b in batches:
            for i, p in enumerate(b.column(at).to_pylist()):
                try:
                    place, inner = places.of(p or "")
                    body, error = place.read(inner, MAX_BYTES + 1), None
                except (OSError, ValueError):
                    body, error = None, "unreadable"
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([error], pa.string()), pa.array([body], pa.binary())], names=[*b.schema.names, "read_error", "content"])

    read = files.mapInArrow(run, schema)
    binary = F.coalesce(C.looks_binary("content"), F.lit(False))
    skip = F.when(F.col("read_error").isNotNull(), F.col("read_error")).when(binary, "binary")
    return read.select(*files.columns, skip.alias("skip"), F.when(skip.isNull(), C.decode_utf8("content")).alias("text"))


class WalkSource(DataSource):
    """``spark.read.format("tree").load(folder)``: a folder's files, walked on one task."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema) -> DataSourceReader:
        return _WalkReader(self.options.get("path", "."), self.options.get("respectIgnore", "true") == "true")


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WalkSource)


class _WalkReader(DataSourceReader):
    def __init__(self, root: str, respect_ignore: bool):
        self.root, self.respect_ignore = root, respect_ignore

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.root)]

    def read(self, partition: InputPartition):
        yield from walk(partition.value, IgnoreRules.of_root(partition.value) if self.respect_ignore else None)
