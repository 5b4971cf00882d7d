"""Toxicity: a counterfactual-regularised linear classifier.

Words and the beginnings and ends of words are a text's features; each counts once a text. The
features are chosen, and logistic regression is fitted, on a bounded sample of the labelled rows
(``SAMPLE_ROWS``, those with the smallest hashes). Sentences of that sample which name a group, or tell
a person's gender, are written again with another group's word in its place, and the fit is penalised by
the square of each change of score: a mention of a group must not move the score by itself. A swap
changes the features of two words only, so all swaps of the sample are counted by what they change.

Sampling, counting features and gathering them are jobs on the executors; the driver holds the
sample's few chosen features only. Scoring uses one broadcast table of ``MAX_FEATURES`` weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import spread
from .common import release_memory, released, small_batches

#: Labelled rows in the fit, at most.
SAMPLE_ROWS = 24_000
#: Features with a weight, at most.
MAX_FEATURES = 4_000
#: Texts of either label that a feature needs.
LEAST_TEXTS = 6
#: Counted features a task holds before it hands them on.
FLUSH = 250_000
THRESHOLD = 0.3

# Names of groups, and words that tell a person's gender, by what may stand in another's
# place; in English, German, French and Spanish.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("woman", "man"),
    ("women", "men"),
    ("mexican", "chinese", "american", "indian", "turkish", "polish"),
    ("immigrants", "refugees", "citizens", "natives"),
    ("deaf", "blind", "disabled", "autistic"),
    ("elderly", "young"),
    ("he", "she", "they"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("er", "sie"),
    ("ausländer", "flüchtlinge", "bürger"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("il", "elle"),
    ("immigrés", "réfugiés", "citoyens"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("él", "ella"),
    ("inmigrantes", "refugiados", "ciudadanos"),
)

_WORDS = re.compile(r"\w+")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
_SWAP = {t: [o for o in group if o != t] for group in IDENTITY_TERMS for t in group}
_NAMES = re.compile(r"\b(" + "|".join(sorted(_SWAP, key=len, reverse=True)) + r")\b")


def features_of(word: str) -> list[str]:
    """The word, and the beginnings and ends of longer ones."""
    n = len(word)
    return [word, *("^" + word[:k] for k in (3, 4, 5, 6) if n > k), *("$" + word[-k:] for k in (4, 5) if n > k)]


def text_features(text: str) -> set[str]:
    return {f for w in set(_WORDS.findall(text.lower())) for f in features_of(w)}


def swaps(text: str) -> Iterator[tuple[str, str]]:
    """Each sentence that names a group, with every other name that may stand there."""
    low = text.lower()
    if not _NAMES.search(low):
        return
    for sentence in _SENTENCES.split(low):
        for m in _NAMES.finditer(sentence):
            for other in _SWAP[m[0]]:
                yield sentence, sentence[: m.start()] + other + sentence[m.end() :]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    #: Swapped sentences in the fit that could move the score.
    swaps: int = 0

    def score(self, text: str | None, of_word: dict[str, dict[str, float]]) -> float:
        """``of_word`` keeps the weighted features of words that were seen."""
        hits: dict[str, float] = {}
        for w in set(_WORDS.findall((text or "").lower())):
            x = of_word.get(w)
            if x is None:
                if len(of_word) > 200_000:
                    of_word.clear()
                x = of_word[w] = {f: self.weights[f] for f in features_of(w) if f in self.weights} or _NONE
            if x is not _NONE:
                hits.update(x)
        # In a fixed order, so that equal texts get equal scores.
        return float(1 / (1 + np.exp(-(self.bias + sum(hits[f] for f in sorted(hits))))))


_NONE: dict[str, float] = {}


def _sample(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """(text, label) of at most SAMPLE_ROWS labelled rows; copies of a text count once. A label above 0 is
    toxic, any other is not; a doc_id that is labelled twice is toxic if any label says so."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic").cast("double") > 0).cast("int")).alias("label")).where(usable)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # SAMPLE_ROWS bounds it
    return rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("label").alias("label"), F.min("doc_id").alias("doc_id")).join(
        rows.select("doc_id", "text", F.xxhash64("text").alias("h")).dropDuplicates(["doc_id", "h"]), ["doc_id", "h"]
    ).select("text", "label")


def _count_features(rows: DataFrame) -> DataFrame:
    """(f, n0, n1): texts of each label that have a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["f", "n0", "n1"])

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[label].update(text_features(text))
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield out()
        yield out()

    return rows.mapInArrow(released(run), "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _choose(counts: DataFrame, n0: int, n1: int) -> list[str]:
    """The features that tell most about the label (squared deviation over expectation)."""
    share = n1 / max(1, n0 + n1)
    seen = F.col("n0") + F.col("n1")
    told = F.pow(F.col("n1") - seen * share, F.lit(2.0)) / (seen * max(1e-9, share * (1 - share)))
    names = F.lit(list(_SWAP)) if _SWAP else F.array()
    kept = counts.where((seen >= LEAST_TEXTS) | F.array_contains(names, F.col("f")))
    return [r.f for r in kept.orderBy(F.desc(told), "f").limit(MAX_FEATURES).collect()]


def _vectors(rows: DataFrame, at: dict[str, int]) -> tuple[list[np.ndarray], np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The sample's chosen features and labels, and which features its swaps take and bring, how often."""
    sent = rows.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value

        def vector(text: str) -> list[int]:
            return sorted(index[f] for f in text_features(text) if f in index)

        for b in batches:
            kind, one, two, labels, order = [], [], [], [], []
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [(vector(text), [])]
                for x, y in swaps(text):
                    u, v = text_features(x), text_features(y)
                    found.append((sorted(index[f] for f in u - v if f in index), sorted(index[f] for f in v - u if f in index)))
                place = xxhash.xxh64_intdigest(text.encode()) >> 1
                for k, (u, v) in enumerate(found):
                    if k == 0 or u or v:
                        kind.append(min(k, 1)), one.append(u), two.append(v), labels.append(label), order.append(place)
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *lists, pa.array(labels, pa.int32()), pa.array(order, pa.int64())], names=["kind", "one", "two", "label", "at"])

    out = rows.mapInArrow(released(run), "kind int, one array<int>, two array<int>, label int, at long")
    texts = out.where("kind = 0").select("one", "label", "at").toArrow().combine_chunks()
    # As many rows as there are terms to put in each other's place, times what a sentence may hold already.
    changed = out.where("kind = 1").groupBy("one", "two").agg(F.count("*").alias("n")).orderBy("one", "two").toArrow().combine_chunks()
    # In an order of the texts' own, so that a fit gives the same weights each time.
    order = np.argsort(texts["at"].to_numpy(), kind="stable")
    one = _arrays(texts["one"])
    swapped = list(zip(_arrays(changed["one"]), _arrays(changed["two"]), strict=True))
    return [one[i] for i in order], texts["label"].to_numpy()[order].astype(float), swapped, changed["n"].to_numpy()


def _arrays(lists: pa.ChunkedArray) -> list[np.ndarray]:
    whole = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    return np.split(whole.flatten().to_numpy(zero_copy_only=False), np.cumsum(whole.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(whole) else []


class _Rows:
    """0/1 rows as index lists, with the two products that the fit needs."""

    def __init__(self, rows: list[np.ndarray], d: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if rows else np.zeros(0, np.int64)
        self.col, self.n, self.d = (np.concatenate(rows) if rows else np.zeros(0, np.int64)), len(rows), d

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.n)

    def back(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, x[self.row], minlength=self.d)


def fit_vectors(rows: list[np.ndarray], y: np.ndarray, swapped: list[tuple[np.ndarray, np.ndarray]], d: int, l2: float = 6e-4, counterfactual: float = 4.0, steps: int = 400, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam: mean log loss + l2 |w|² + counterfactual · mean (change of logit)².
    ``swapped``: the features before and after, each pair as often as ``times`` has it (else once)."""
    if not len(y) or y.min() == y.max():
        return np.zeros(d), -4.0 if not len(y) or y.max() == 0 else 4.0
    x, a, b = _Rows(rows, d), _Rows([s[0] for s in swapped], d), _Rows([s[1] for s in swapped], d)
    share = np.ones(a.n) / max(1, a.n) if times is None else times / max(1, times.sum())
    w, bias = np.zeros(d), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        wrong = 1 / (1 + np.exp(-(x.dot(w) + bias))) - y
        g = x.back(wrong) / x.n + 2 * l2 * w
        if a.n:
            moved = share * (a.dot(w) - b.dot(w))
            g += 2 * counterfactual * (a.back(moved) - b.back(moved))
        g = np.append(g, wrong.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks and the
    condition ``usable`` (over doc_id) allows. Rows without id, text or label teach nothing; without
    labelled rows of both kinds the score is the same for every text: low, or high if all are toxic."""
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels, F.lit(True) if usable is None else usable).persist()
    try:
        n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
        chosen = _choose(_count_features(sample), n.get(0, 0), n.get(1, 0)) if n else []
        rows, y, swapped, times = _vectors(sample, {f: i for i, f in enumerate(chosen)})
    finally:
        sample.unpersist()
    w, bias = fit_vectors(rows, y, swapped, len(chosen), times=times)
    del rows, y, swapped
    release_memory()
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-3}, bias, int(times.sum()))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Add the score (0 to 1) of every row's whole ``text``; null and empty texts get the score of
    no features. ``docs`` must not have that column already."""
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has a column {column}")
    small_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, float]] = {}
        for b in batches:
            out = [sent.value.score(t, held) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, column])

    return spread(docs).mapInArrow(released(run), docs.select("*", F.lit(0.0).alias(column)).schema)


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns as they are."""
    return score(docs, model, "__toxicity").where(F.col("__toxicity") < threshold).drop("__toxicity")
