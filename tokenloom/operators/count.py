"""Counting tokens of texts for a model: exactly where its vocabulary is at hand, else by ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import registry as R
from ..sources.vocabulary import VocabularyStore
from . import tokenizers as T


def count_tokens(texts: DataFrame, model: R.Model | str, text: str = "text", store: VocabularyStore | None = None) -> DataFrame:
    """``texts`` with count and exact, by the model's vocabulary if the store has one that can be read, else by its
    ratio."""
    found = R.find_model(model) if isinstance(model, str) else model
    if found is None:
        raise ValueError(f"no such model: {model}")
    return count_with(texts, found.ratio, store.load(found) if store else None, text)


def count_with(texts: DataFrame, ratio: float, vocabulary: T.RankVocabulary | T.TokenizerFile | None, text: str = "text", most: int = R.MAX_BYTES) -> DataFrame:
    """``texts`` with count and exact. An empty or null text is exactly 0. A text of more than ``most`` UTF-16 units is
    estimated by the ratio, and so is one that the vocabulary fails on, or any other where there is none."""
    if vocabulary is None:
        return texts.withColumn("__t", C.token_count(text, ratio)).select(*texts.columns, F.col("__t.count").alias("count"), F.col("__t.exact").alias("exact"))
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    countable = C.utf16_length(text) <= most
    # Python functions see every row, whatever stands around them: what is not to be counted is null there.
    counted = T.count_exact(texts, vocabulary, F.when(~empty & countable, F.col(text)), "__count")
    exact = empty | (countable & F.col("__count").isNotNull())
    count = F.when(empty, F.lit(0).cast("bigint")).when(exact, F.col("__count")).otherwise(C.heuristic_tokens(text, ratio))
    return counted.select(*[F.col(c) for c in texts.columns], count.alias("count"), exact.alias("exact"))


def is_exact(model: R.Model, store: VocabularyStore | None) -> bool:
    return store is not None and store.load(model) is not None


def estimate_all(texts: DataFrame, id_columns: list[str], text: str = "text", models: list[R.Model] | None = None) -> DataFrame:
    """(ids, model_id, tokens) for every text and model: the models are a literal array in each row, so
    no join is made."""
    pairs = F.array(*[F.struct(F.lit(m.model_id).alias("model_id"), F.lit(m.ratio).alias("ratio")) for m in models or R.MODELS])
    rows = texts.select(*id_columns, C.utf16_length(text).alias("units")).select(*id_columns, "units", F.explode(pairs).alias("m"))
    return rows.select(*id_columns, "m.model_id", F.ceil(F.col("units").cast("double") / F.col("m.ratio")).cast("bigint").alias("tokens"))


def register(spark: SparkSession) -> None:
    """SQL functions: heuristic_tokens(text, ratio), pretokenize(text), count_tokens(text, model) —
    the last an estimate by the model's ratio, as a function of one row has no vocabulary."""
    ratios = ", ".join(f"'{m.model_id}', {m.ratio}D" for m in R.MODELS)
    retired = ", ".join(f"'{old}', '{live}'" for old, live in R.ALIASES.items())
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION heuristic_tokens(text STRING, ratio DOUBLE) RETURNS BIGINT RETURN CAST(ceil(length(encode(text, 'UTF-16BE')) / 2D / ratio) AS BIGINT)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pretokenize(text STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(text, r\"{T.PIECES}\", 0)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION count_tokens(text STRING, model STRING) RETURNS BIGINT RETURN "
        f"CAST(ceil(length(encode(text, 'UTF-16BE')) / 2D / map({ratios})[coalesce(map({retired})[model], model)]) AS BIGINT)"
    )
