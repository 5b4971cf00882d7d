"""A count from paths to a report: discover, classify, look up, read, count, remember."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import relations as rel
from ..operators.count import count_tokens
from ..sources.discover import discover, packed, read_texts
from ..sources.vocabulary import VocabularyStore
from . import registry as R

OUTCOMES = ["path", "mtime", "tokens", "exact", "skip"]


def count_selection(
    spark: SparkSession, paths: list[str], model: R.Model | str | None = None, config: EngineConfig | None = None, cache: DataFrame | None = None, store: VocabularyStore | None = None, buffers: DataFrame | None = None
) -> DataFrame:
    """(path, mtime, tokens, exact, skip) of every file that a selection of folders and files holds.

    Paths below other chosen paths are counted once. A file that alone is chosen is counted even if
    ignore rules name it. Counts in ``cache`` are used where model, path and time agree; open
    ``buffers`` (path, text) stand for what is on disk. A vocabulary that the store lacks is fetched if
    the store may and the setting ``download_tokenizers`` says so.
    """
    config = config or EngineConfig()
    found = model if isinstance(model, R.Model) else R.find_model(model or config.default_model) or R.default_model()
    if store is not None and config.download_tokenizers and store.path(found) and not store.is_downloaded(found):
        store.ensure(found)
    roots = [r["path"] for r in rel.dedupe_selection(spark.createDataFrame([(os.path.abspath(p),) for p in paths], "path string")).orderBy("path").collect()]
    files = discover(spark, roots, config.ignore_gitignored_files)
    if len(roots) == 1 and not os.path.isdir(roots[0]):
        files = files.withColumn("ignored", F.lit(False))
    skip = F.when(F.col("outcome") == "unreadable", "unreadable").when(F.col("outcome") == "ignored-directory", "gitignored")
    classified = rel.classify(files, ignored=F.col("ignored")).withColumn("skip", F.coalesce(skip, "skip")).dropDuplicates(["path"])
    left_out = classified.where("skip is not null").select("path", "mtime", F.lit(None).cast("bigint").alias("tokens"), F.lit(None).cast("boolean").alias("exact"), "skip")
    work = classified.where("skip is null").select(F.lit(found.model_id).alias("model_id"), "path", "mtime", "size")
    known = None
    if buffers is not None:
        opened = buffers.select("path", "text").join(work, "path")
        work = work.join(buffers.select("path"), "path", "left_anti")
    if cache is not None:
        known = rel.cache_hits(work, cache).select("path", "mtime", F.col("count").alias("tokens"), "exact", F.lit(None).cast("string").alias("skip"))
        work = rel.cache_misses(work, cache)
    read = read_texts(packed(work.select("path", "mtime", "size"))).drop("size")
    unread = read.where("skip is not null").select("path", "mtime", F.lit(None).cast("bigint").alias("tokens"), F.lit(None).cast("boolean").alias("exact"), "skip")
    texts = read.where("skip is null").select("path", "mtime", "text")
    if buffers is not None:
        texts = texts.unionByName(opened.select("path", "mtime", "text"))
    counted = count_tokens(texts, found, store=store).select("path", "mtime", F.col("count").alias("tokens"), "exact", F.lit(None).cast("string").alias("skip"))
    out = left_out.unionByName(unread).unionByName(counted)
    return out.unionByName(known) if known is not None else out


def cacheable(outcomes: DataFrame, model: R.Model) -> DataFrame:
    """What a count leaves for the cache."""
    return outcomes.where("skip is null").select(F.lit(model.model_id).alias("model_id"), "path", "mtime", F.col("tokens").alias("count"), "exact")


def project_total(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """Total and exactness over the outermost roots; no rows where project scans are off."""
    config = options.get("config") or EngineConfig()
    totals = rel.totals(count_selection(spark, roots, **options).where("skip is null"), exact="exact")
    return totals if config.enable_project_scan else totals.limit(0)
