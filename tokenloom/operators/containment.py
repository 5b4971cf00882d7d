"""Which paths contain which, by sweeps over sorted paths.

With a slash behind each path, all that a path holds follows it at once in byte order. So one pass over sorted paths, which
remembers what it has last kept (or the chain of roots it is in), tells what each path is in; no path is taken apart
into its ancestors, so none of these, however common, gathers rows in a task. Paths are sorted by ranges, in one shuffle.
What reaches over a border between ranges is a path, or a chain of roots, a range: small tables, which meet the rows of
their range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import written


def _key(path: str) -> Column:
    return F.concat(F.col(path), F.lit("/"))


def _outermost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted paths (the last column) those that are not in, and not the same as, the last one kept."""
    kept, inside, none = None, None, False
    for b in batches:
        at = []
        for i, p in enumerate(b.column(b.num_columns - 1).to_pylist()):
            if p is None:
                if not none:
                    none = True
                    at.append(i)
            elif kept is None or (p != kept and not p.startswith(inside)):
                kept, inside = p, f"{p}/"
                at.append(i)
        yield b.take(pa.array(at, pa.int64()))


def outermost(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct paths that are in no other of them. A null is kept once; an empty path holds all absolute ones.

    Each task first sweeps what it has, so that neither repeats nor what a chosen folder holds are shuffled."""
    ship(paths.sparkSession)
    kind = f"{path} {paths.schema[path].dataType.simpleString()}"
    rows = paths.select(path).sortWithinPartitions(_key(path)).mapInArrow(_outermost, kind)
    ranged = rows.repartitionByRange(_key(path)).sortWithinPartitions(_key(path))
    placed = written(ranged.select(F.spark_partition_id().alias("__range"), path).mapInArrow(_outermost, f"__range int, {kind}"))
    # The last path that was kept before a range begins: one a range, so few; it is the range before's own last, unless
    # that is inside of what was kept before it.
    last, carried, kept = placed.where(F.col(path).isNotNull()).groupBy("__range").agg(F.max_by(path, _key(path)).alias("last")).orderBy("__range").collect(), [], None
    for r in last:
        carried.append((r["__range"], kept))
        if kept is None or not r["last"].startswith(f"{kept}/"):
            kept = r["last"]
    before = placed.sparkSession.createDataFrame(carried, f"__range int, __kept {paths.schema[path].dataType.simpleString()}")
    both = placed.join(F.broadcast(before), "__range", "left")  # a row a range
    inside = F.col("__kept").isNotNull() & F.startswith(F.col(path), F.concat("__kept", F.lit("/")))
    return both.where(~F.coalesce(inside, F.lit(False))).select(path)


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (their last two columns: whether they are a root, the path) without the roots, with the innermost root
    of these that holds each."""
    chain: list[str] = []
    for b in batches:
        at, owners = [], []
        for i, (root, p) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)):
            if p is not None:
                while chain and p != chain[-1] and not p.startswith(f"{chain[-1]}/"):
                    chain.pop()
                if root:
                    if not chain or p != chain[-1]:
                        chain.append(p)
                    continue
            at.append(i)
            owners.append(chain[-1] if chain and p is not None else None)
        kept = b.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns[:-2], pa.array(owners, pa.string())], names=[*b.schema.names[:-2], "__owner"])


def innermost_root(files: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """``files`` with ``root``: the longest of ``roots`` (a column root) that is the path or holds it, else null. Any number
    of roots; files and roots are shuffled once. A column root that ``files`` have is replaced. Repeated rows
    stay, however many are alike: ranges part them by their other columns."""
    ship(files.sparkSession)
    own = files.drop(root)
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    parted = [F.col(c) for c in own.columns if not any(k in kinds[c] for k in ("map<", "variant"))]
    nothing = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns]
    held = own.select(*own.columns, F.lit(False).alias("__root"), F.col(path).alias("__path"))
    chosen = roots.select(F.col(root).alias("__path")).where("__path is not null").distinct()
    rows = held.unionByName(chosen.select(*nothing, F.lit(True).alias("__root"), "__path"))
    # A root stands before what it holds, and before a file of its name.
    order = [_key("__path"), ~F.col("__root"), F.xxhash64(*parted)]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(["__range int", *[f"`{c}` {kinds[c]}" for c in own.columns], "__at string", "__owner string"])
    placed = written(ranged.select(F.spark_partition_id().alias("__range"), *own.columns, F.col("__path").alias("__at"), "__root", "__path").mapInArrow(_owned, schema))
    # Roots of ranges before that a range's first file is in: its own ancestors, for one file a range.
    firsts = placed.where("__at is not null").groupBy("__range").agg(F.min_by("__at", _key("__at")).alias("first"))
    steps = F.split("first", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    chains = firsts.select("__range", F.explode(above).alias("__path")).join(chosen, "__path").groupBy("__range").agg(F.sort_array(F.collect_list(F.struct(F.length("__path").alias("n"), F.col("__path").alias("p"))), asc=False).alias("__chain"))
    both = placed.join(F.broadcast(chains), "__range", "left")  # a row a range, of as many roots as its path has parts
    holds = F.filter("__chain", lambda r: (F.col("__at") == r["p"]) | F.startswith(F.col("__at"), F.concat(r["p"], F.lit("/"))))
    return both.select(*[F.col(c) for c in own.columns], F.coalesce("__owner", F.get(holds, F.lit(0))["p"]).alias(root))
