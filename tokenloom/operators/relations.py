"""Relational operators over files, counts and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import columns as C
from ..plans import registry as R
from ..storage import written
from .containment import innermost_root, outermost


def by_locale(label: str | Column) -> Column:
    """Order as people read names (root collation)."""
    return F.collate(label, "UNICODE")


# Models


def resolve(ids: DataFrame, models: DataFrame, aliases: DataFrame, id_column: str = "model_id") -> DataFrame:
    """``ids`` with resolved_id: itself if live, else what took its place, else null. Models and
    aliases are small by nature (a registry) and broadcast."""
    live = F.broadcast(models.select(F.col("model_id").alias("__live")))
    renamed = F.broadcast(aliases.join(models, "model_id", "left_semi").select(F.col("alias").alias("__alias"), F.col("model_id").alias("__to")))
    out = ids.join(live, F.col(id_column) == F.col("__live"), "left").join(renamed, F.col(id_column) == F.col("__alias"), "left")
    return out.select(*ids.columns, F.coalesce("__live", "__to").alias("resolved_id"))


def initial_models(choices: DataFrame, models: DataFrame, aliases: DataFrame) -> DataFrame:
    """``choices`` (saved, configured, any others) with the model to start with, and the id to save in
    a retired one's place (null: nothing to save)."""
    first = models.orderBy("ord").select("model_id").first()[0]
    both = resolve(resolve(choices, models, aliases, "saved").withColumnRenamed("resolved_id", "__saved"), models, aliases, "configured")
    moved = F.when(F.col("__saved").isNotNull() & (F.col("__saved") != F.col("saved")), F.col("__saved"))
    return both.select(*choices.columns, F.coalesce("__saved", "resolved_id", F.lit(first)).alias("model_id"), moved.alias("migrate_to"))


def providers(models: DataFrame) -> DataFrame:
    return models.groupBy("provider").agg(F.min("ord").alias("first_ord"), F.count("*").alias("models"))


def vocabulary_sharing(models: DataFrame) -> DataFrame:
    """Which models one download serves."""
    return models.where(C.is_downloadable("encoder.kind")).groupBy(F.col("encoder.repo").alias("repo")).agg(F.count("*").alias("models"), F.array_sort(F.collect_list("model_id")).alias("model_ids"))


def catalog(models: DataFrame) -> DataFrame:
    words = F.create_map(*[F.lit(x) for pair in R.CATALOG_ACCURACY.items() for x in pair])
    limit = F.when(F.coalesce("context_limit", F.lit(0)) != 0, F.concat(C.format_limit("context_limit"), F.lit(" context"))).otherwise("no published limit")
    return models.select("ord", "model_id", "label", F.concat_ws(" · ", "provider", limit, words[C.accuracy("encoder.kind")]).alias("description"))


def picker(models: DataFrame, current: str | None = None) -> DataFrame:
    """Rows of a list to choose from: a separator wherever the provider changes, then the model."""
    words = F.create_map(*[F.lit(x) for pair in R.PICKER_ACCURACY.items() for x in pair])
    before = F.lag("provider").over(W.orderBy("ord"))  # a registry: a few rows
    rows = models.withColumn("new", before.isNull() | (before != F.col("provider")))
    separators = rows.where("new").select("ord", F.lit(0).alias("line"), F.col("provider").alias("label"), F.lit(None).cast("string").alias("model_id"), F.lit(None).cast("string").alias("detail"))
    mark = F.when(F.col("model_id") == F.lit(current), "* ").otherwise("")
    detail = F.concat(C.format_number(F.coalesce("context_limit", F.lit(0))), F.lit(" token context · "), words[C.accuracy("encoder.kind")])
    return separators.unionByName(rows.select("ord", F.lit(1).alias("line"), F.concat(mark, F.col("label")).alias("label"), "model_id", detail.alias("detail")))


def registry_violations(models: DataFrame, aliases: DataFrame) -> DataFrame:
    """(rule, subject) of everything that a sound registry has not."""
    order = W.orderBy("ord")
    runs = models.withColumn("before", F.lag("provider").over(order)).where("before is null or before != provider").groupBy("provider").count().where("count > 1")
    found = [
        models.groupBy("model_id").count().where("count > 1").select(F.lit("duplicate id").alias("rule"), F.col("model_id").alias("subject")),
        models.where("context_limit < 4096 or context_limit > 20000000").select(F.lit("implausible limit"), "model_id"),
        runs.select(F.lit("scattered provider"), "provider"),
        aliases.join(models, "model_id", "left_anti").select(F.lit("alias of no live model"), "alias"),
        aliases.join(models.select(F.col("model_id").alias("alias")), "alias", "left_semi").select(F.lit("alias hides a live model"), "alias"),
        models.where("encoder.kind != 'tiktoken' and not (encoder.chars_per_token > 1 and encoder.chars_per_token < 10)").select(F.lit("implausible ratio"), "model_id"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


# Selections and roots


def _ancestors(path: Column) -> Column:
    """Every proper ancestor of an absolute path that ends without a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def dedupe_selection(selection: DataFrame, path: str = "path") -> DataFrame:
    """Distinct paths that are not below another one, by a sweep over sorted paths."""
    return outermost(selection, path)


#: Roots that are sent to the files, at most; more are met by a sweep.
BROADCAST_ROOTS = 1_000


def owning_root(files: DataFrame, roots: DataFrame, path: str = "path", few: int | None = None) -> DataFrame:
    """``files`` with the longest root that holds them (null: none). A few roots go to the files, which then
    stay where they are; many are sorted with the files, and met by a sweep."""
    few = BROADCAST_ROOTS if few is None else few
    own = roots.select("root").where("root is not null").distinct()
    if own.limit(few + 1).count() > few:
        return innermost_root(files, own, path)
    above = F.concat(_ancestors(F.col(path)), F.array(F.col(path)))
    sent = F.broadcast(own.agg(F.collect_list("root").alias("__roots")))  # one row of at most ``few``
    longest = F.get(F.filter(F.reverse(above), lambda x: F.array_contains(F.col("__roots"), x)), F.lit(0))
    return files.crossJoin(sent).withColumn("root", longest).drop("__roots")


def _directories(path: str) -> Column:
    parts = C.segments(path)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def common_root(files: DataFrame, path: str = "path") -> DataFrame:
    """One row: the longest common run of directories."""
    return _common(files.select(_directories(path).alias("d")))


def _common(directories: DataFrame) -> DataFrame:
    """The longest common prefix of all lists ``d``: that of the smallest and the largest."""
    ends = directories.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    least = F.least(F.size("a"), F.size("b"))
    same = F.filter(F.sequence(F.lit(0), least), lambda i: F.slice(F.col("a"), 1, i) == F.slice(F.col("b"), 1, i))
    return ends.select(F.coalesce(F.slice("a", 1, F.array_max(same)), F.array().cast("array<string>")).alias("root"))


# Outcomes


def classify(files: DataFrame, path: str = "path", size: str = "size", ignored: str | Column | None = None) -> DataFrame:
    return files.withColumn("skip", C.skip_reason(path, size, F.lit(False) if ignored is None else ignored))


def outcome_counts(files: DataFrame) -> DataFrame:
    """Files counted, skipped and ignored, by their column ``skip``."""
    return files.agg(
        F.count_if(F.col("skip").isNull()).alias("files_counted"),
        F.count_if(F.col("skip").isNotNull() & (F.col("skip") != "gitignored")).alias("files_skipped"),
        F.count_if(F.col("skip") == "gitignored").alias("files_ignored"),
    )


def totals(counted: DataFrame, tokens: str = "tokens", exact: str | None = None) -> DataFrame:
    """Sum of tokens, and whether every count is exact (so it is without any)."""
    sums = [F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("total_tokens")]
    return counted.agg(*sums, *([F.coalesce(F.bool_and(exact), F.lit(True)).alias("exact")] if exact else []))


def running_total(counted: DataFrame, order: list[str], within: list[str] | None = None, tokens: str = "tokens") -> DataFrame:
    """``counted`` with the total up to each row, as a stopped count would report it; null tokens add
    nothing. Rows that tie in ``order`` follow each other by their other columns. ``counted`` must not
    have a column running_total.

    Without groups (``within``) the rows are one sequence: they are dealt into ranges of it, once, as a
    table in the shared folder; ranges are summed, and only their sums are put in one order."""
    kinds = {f.name: f.dataType.simpleString() for f in counted.schema}
    ties = [c for c in counted.columns if c not in order and not any(k in kinds[c] for k in ("map<", "variant"))]
    full = [*order, *ties]
    if within:
        sums = F.sum(F.coalesce(tokens, F.lit(0))).over(W.partitionBy(*within).orderBy(*full).rowsBetween(W.unboundedPreceding, 0))
        return counted.withColumn("running_total", sums.cast("bigint"))
    # Ranges are sampled anew each time that they are made, so both uses read the rows as they were dealt.
    placed = written(counted.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__part").agg(F.sum(tokens).alias("s"))
    offsets = sums.select("__part", F.coalesce(F.sum("s").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    inner = F.sum(F.coalesce(tokens, F.lit(0))).over(W.partitionBy("__part").orderBy(*full).rowsBetween(W.unboundedPreceding, 0))
    return placed.join(F.broadcast(offsets), "__part").withColumn("running_total", (inner + F.col("__offset")).cast("bigint")).drop("__part", "__offset")


def progress_marks(counted: DataFrame, seq: str, n: int) -> DataFrame:
    """The rows at which a count of n files reports: about every hundredth (``seq`` from 1), and the last."""
    return counted.where((F.col(seq) % max(1, n // 100) == 0) | (F.col(seq) == n))


def openable(requested: DataFrame, counted: DataFrame) -> DataFrame:
    """Of the requested paths those that were counted: no others are to be opened."""
    return requested.join(counted.select("path"), "path", "left_semi")


def overlaid(texts: DataFrame, buffers: DataFrame) -> DataFrame:
    """``texts`` (path, text and others) with what an editor holds open (``buffers``: path, text) in place of what is
    stored. Of several buffers of a path the largest text counts; a buffer without text is an empty one."""
    held = buffers.where("path is not null").groupBy("path").agg(F.max(F.coalesce("text", F.lit(""))).alias("__open"))
    both = texts.join(held, "path", "left").withColumn("text", F.coalesce("__open", "text"))
    return both.select(texts.columns)


# Rankings


def ranked_slices(groups: DataFrame, most: int = R.MAX_SLICES) -> DataFrame:
    """(rank, label, tokens, files, share) of ``groups`` (label, tokens, files): the largest, then one
    row Other for the rest. Only the largest are ever sorted together. Groups are made once, and written."""
    groups = written(groups)
    order = [F.desc("tokens"), by_locale("label"), F.col("label")]
    head = groups.orderBy(*order).limit(most)
    whole = groups.agg(F.sum("tokens").alias("all_tokens"), F.sum("files").alias("all_files"), F.count("*").alias("groups"))
    ranked = head.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # at most ``most`` rows
    shown = ranked.agg(F.sum("tokens").alias("t"), F.sum("files").alias("f"), F.count("*").alias("n"))
    rest = whole.crossJoin(shown).where("groups > n").select((F.col("n") + 1).cast("int").alias("rank"), F.lit("Other").alias("label"), (F.col("all_tokens") - F.col("t")).alias("tokens"), (F.col("all_files") - F.col("f")).alias("files"))
    rows = ranked.select("rank", "label", "tokens", "files").unionByName(rest)
    total = whole.select("all_tokens")  # one row
    return rows.crossJoin(F.broadcast(total)).select("rank", "label", F.col("tokens").cast("bigint").alias("tokens"), F.col("files").cast("bigint").alias("files"), C.share("tokens", "all_tokens").alias("share"))


def by_folder(counted: DataFrame, most: int = R.MAX_SLICES) -> DataFrame:
    """Slices of the folders directly below the common root. Files are summed by directory first, in one pass; the root
    and the labels come from these sums."""
    sums = written(counted.groupBy(_directories("path").alias("d")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("files")))
    depth = F.size("root")
    label = F.when(F.size("d") > depth, F.try_element_at("d", depth + 1)).otherwise(F.lit("(root)"))
    labelled = sums.crossJoin(F.broadcast(_common(sums.select("d"))))  # one row
    return ranked_slices(labelled.groupBy(label.alias("label")).agg(F.sum("tokens").alias("tokens"), F.sum("files").alias("files")), most)


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    known = F.broadcast(R.languages(files.sparkSession).withColumnRenamed("language", "__known"))
    out = files.withColumn("ext", C.extension(path)).join(known, "ext", "left")
    return out.withColumn("language", C.language_or(path, F.col("__known"))).drop("ext", "__known")


def by_language(counted: DataFrame, most: int = R.MAX_SLICES) -> DataFrame:
    groups = with_language(counted).groupBy(F.col("language").alias("label")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("files"))
    return ranked_slices(groups, most)


def largest_first(counted: DataFrame) -> DataFrame:
    return counted.orderBy(F.desc("tokens"), by_locale("path"), "path")


def listing(counted: DataFrame, key: str = "tokens", ascending: bool | None = None, term: str | None = None, most: int | None = R.MAX_LISTED) -> DataFrame:
    """Rows to show (path, display, tokens): those whose display holds the term, in either case;
    sorted by tokens (largest first) or by path, unless told otherwise; the first ``most``."""
    rows = counted.where(F.contains(F.lower("display"), F.lit(term.strip().lower()))) if term and term.strip() else counted
    up = (key == "path") if ascending is None else ascending
    name = by_locale("display")
    first = [F.asc("tokens") if up else F.desc("tokens")] if key == "tokens" else []
    rows = rows.orderBy(*first, name.asc() if up or key == "tokens" else name.desc(), "path")
    return rows.limit(most) if most is not None else rows


def display_root(*files: DataFrame) -> DataFrame:
    """The common root of files of all outcomes, ignored directories among them."""
    paths = files[0].select("path")
    for f in files[1:]:
        paths = paths.unionByName(f.select("path"))
    return common_root(paths)


# The count cache


def cache_hits(work: DataFrame, cache: DataFrame) -> DataFrame:
    """Work (model_id, path, mtime) with the count and its exactness, where all three agree."""
    return work.join(cache.select("model_id", "path", "mtime", "count", "exact"), ["model_id", "path", "mtime"])


def cache_misses(work: DataFrame, cache: DataFrame) -> DataFrame:
    return work.join(cache, ["model_id", "path", "mtime"], "left_anti")


def cache_without(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """The cache without the changed paths, for every model; what only begins alike stays."""
    return cache.join(changed.select("path").distinct(), "path", "left_anti").select(cache.columns)


def cache_with(cache: DataFrame, counts: DataFrame) -> DataFrame:
    """New counts take the place of those of the same model and path."""
    return cache.join(counts.select("model_id", "path"), ["model_id", "path"], "left_anti").select(cache.columns).unionByName(counts.select(cache.columns))
