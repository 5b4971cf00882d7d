"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages, as long as the benchmark items they may hold. Passages
and items are TF-IDF vectors over the benchmark's words (document frequencies are counted over all
documents), projected on the leading singular vectors of such vectors, which a distributed randomised
SVD finds from the items and the passages of all distinct texts. A passage whose projection is near an
item's by cosine, and that has enough of the item's weight, is compared with it word by word: the longest common
subsequence must cover most of the item, and the item's answer must be there. A passage that is nearer still may
have fewer of the words, if it keeps the answer: a paraphrase.

Some items have little of their length in any few directions (more items than directions, or words of their own). For
those, and only those, the cosine is that of the whole vectors, by the list of items that each word has; ``Index.kept``
tells which they are.

The benchmark is taken in blocks of at most ``ITEMS_IN_BLOCK`` items, which end with the item that makes
``WORDS_IN_BLOCK`` words full, so what is broadcast is bounded (about 250 MB, or one item); every passage of every document is searched for each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.spread import spread
from .common import input_partitions, released, small_batches, written

ITEMS_IN_BLOCK, WORDS_IN_BLOCK = 5_000, 250_000
#: Directions: as many as there are items, but between these.
RANK, MOST_RANK, OVERSAMPLING, POWER_ITERATIONS = 96, 256, 16, 1
#: Tasks that add up the passages' products, each with a matrix of its own to pass on, at least; one
#: more for each INPUT_TASKS of the input.
FIT_TASKS, INPUT_TASKS = 16, 8
#: Words in more than this share of the documents weigh nothing, unless an item has no rarer ones
#: (an item's rarest TELLING_WORDS always weigh something).
MAX_SHARE, TELLING_WORDS = 0.05, 6
#: A candidate has this cosine, and words of this share of the item's weight.
MIN_COSINE, MIN_MASS = 0.2, 0.4
#: An item with less of its length in the projection than this is searched by its whole vector.
MIN_KEPT = 0.7
#: Shares of an item's words in common order, and of its answer's words, that make a leak.
MIN_COMMON, MIN_ANSWER = 0.75, 0.5
#: What makes a paraphrase: this share of the item's words in common order, and of those that few documents have, which
#: must be so many at least; this share of its answer's words, not all of them in many documents; and this cosine.
LIKE_COMMON, LIKE_TELLING, LIKE_ANSWER, LIKE_COSINE = 0.45, 4, 0.9, 0.25
#: Passages, and characters of texts, that are looked at together.
TOGETHER, CHARACTERS = 2_048, 1 << 21

# ASCII but letters, digits and underscore parts words.
_PARTING = bytes(0x20 if b < 0x80 and not (chr(b).isalnum() or b == 0x5F) else b for b in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PARTING).split()


def answer_of(text: str) -> list[bytes]:
    """The words of the last sentence that has any: what stands for the answer of an item without one."""
    return next((w for s in reversed(_SENTENCE.split(text)) if (w := words_of(s))), [])


def common_subsequence(item: list[bytes], passage: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    every = (1 << len(item)) - 1
    open_bits = every
    for w in passage:
        if m := where.get(w):
            both = open_bits & m
            open_bits = ((open_bits + both) | (open_bits - both)) & every
    return len(item) - open_bits.bit_count()


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    answer: list[bytes]


@dataclass
class Class:
    """Items of like length, searched alike: their places, weights, and unit vectors; these are projected
    ones (a matrix), or whole ones: for each word from its start to the next one's the items that have it, and how
    much of their length it is."""

    size: int
    members: np.ndarray
    mass: np.ndarray
    vectors: np.ndarray | None
    starts: np.ndarray | None = None
    holders: np.ndarray | None = None
    parts: np.ndarray | None = None


@dataclass
class Index:
    """A block of items: their words' numbers and weights, the projection, and the items by class."""

    number: dict[bytes, int]
    weight: np.ndarray
    #: The words that few documents have.
    rare: np.ndarray
    project: np.ndarray
    items: list[Item]
    own: list[np.ndarray]
    classes: list[Class]
    #: How much of each item's length the projection keeps.
    kept: np.ndarray

    @cached_property
    def weighted(self) -> np.ndarray:
        """Each word's direction times its weight."""
        return self.project * self.weight[:, None].astype(np.float32)

    def leaks(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item_id, cosine, common share, answer share) of each item that leaked into the text."""
        return self.leaks_of([text])[0]

    def leaks_of(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float]]]:
        """The leaks of each text. Texts are looked at together: their words stand in one line, and windows end where
        their text does."""
        said = [words_of(t) for t in texts]
        best: list[dict[int, tuple[int, float, float, float]]] = [{} for _ in texts]
        lengths = np.array([len(w) for w in said])
        ends_of = np.cumsum(lengths)
        begins = ends_of - lengths
        ids = np.fromiter(map(self.number.get, chain.from_iterable(said), repeat(-1)), np.int64, count=int(lengths.sum()))
        telling = np.flatnonzero(ids >= 0)
        telling = telling[self.weight[ids[telling]] > 0]
        if not len(telling):
            return [[] for _ in texts]
        own = ids[telling]
        sums = np.concatenate([[0.0], np.cumsum(self.weight[own])])
        for c in self.classes:
            # Windows of twice the size, a size apart: each run of ``size`` words is inside of one.
            many = np.where(lengths > 0, -(-np.maximum(1, lengths - c.size) // c.size), 0)
            text = np.repeat(np.arange(len(texts)), many)
            starts = begins[text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * c.size
            ends = np.minimum(starts + 2 * c.size, ends_of[text])
            first, last = np.searchsorted(telling, starts), np.searchsorted(telling, ends)
            heavy = sums[last] - sums[first]
            windows = np.flatnonzero((heavy >= MIN_MASS * c.mass.min() - 1e-9) & (last > first))
            for at in range(0, len(windows), TOGETHER):
                some = windows[at : at + TOGETHER]
                for k, m, cosine in self.near(c, own, first[some], last[some], heavy[some]):
                    k = some[k]
                    t = int(text[k])
                    item, found = self.items[c.members[m]], best[t]
                    passage = said[t][max(0, int(starts[k] - begins[t]) - c.size // 2) : int(ends[k] - begins[t]) + c.size // 2]
                    if (got := self.verify(int(c.members[m]), passage, cosine)) and (item.item_id not in found or got[2:] > found[item.item_id][2:]):
                        found[item.item_id] = got
        return [sorted(x.values()) for x in best]

    def near(self, c: Class, own: np.ndarray, first: np.ndarray, last: np.ndarray, heavy: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(window, member, cosine) of what is near, and has enough of the member's weight. ``own``: telling words; a
        window has those from first to last, which weigh ``heavy``."""
        sizes = last - first
        spots = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        words, window = own[spots], np.repeat(np.arange(len(first)), sizes)
        cuts = np.cumsum(sizes) - sizes
        if c.vectors is not None:
            z = np.add.reduceat(self.weighted[words], cuts, axis=0)
            z /= np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-12)[:, None]
            cosines = z @ c.vectors.T
            at, of = np.nonzero(cosines >= MIN_COSINE)
            enough = heavy[at] >= MIN_MASS * c.mass[of] - 1e-9
            for k, m in zip(at[enough].tolist(), of[enough].tolist(), strict=True):
                yield k, m, float(cosines[k, m])
            return
        # Whole vectors: a window's repeated words count as often, in its length too.
        order = np.lexsort((words, window))
        words, window = words[order], window[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(words) != 0) | (np.diff(window) != 0)]))
        words, window, times = words[new], window[new], np.diff(np.append(new, len(words)))
        value = self.weight[words] * times
        length = np.sqrt(np.bincount(window, weights=value * value, minlength=len(first)))
        held = c.starts[words + 1] - c.starts[words]
        listed = np.repeat(c.starts[words] - np.concatenate([[0], np.cumsum(held)[:-1]]), held) + np.arange(int(held.sum()))
        pair = np.repeat(window, held) * len(c.members) + c.holders[listed]
        pairs, at = np.unique(pair, return_inverse=True)
        dots = np.bincount(at, weights=np.repeat(value, held) * c.parts[listed], minlength=len(pairs))
        cosines = dots / np.maximum(length[pairs // len(c.members)], 1e-12)
        at, of = pairs // len(c.members), pairs % len(c.members)
        for i in np.flatnonzero((cosines >= MIN_COSINE) & (heavy[at] >= MIN_MASS * c.mass[of] - 1e-9)):
            yield int(at[i]), int(of[i]), float(cosines[i])

    def verify(self, at: int, passage: list[bytes], cosine: float) -> tuple[int, float, float, float] | None:
        item = self.items[at]
        common = common_subsequence(item.words, passage) / len(item.words)
        if common < LIKE_COMMON:
            return None
        answer = common_subsequence(item.answer, passage) / len(item.answer) if item.answer else 1.0
        if common >= MIN_COMMON and answer >= MIN_ANSWER:
            return item.item_id, cosine, common, answer
        if cosine < LIKE_COSINE or not item.answer or answer < LIKE_ANSWER:
            return None
        rare = [w for w in item.words if self.rare[self.number[w]]]
        kept = common_subsequence(rare, passage)
        if kept < LIKE_TELLING or kept < LIKE_COMMON * len(rare):
            return None
        # Of an answer of words that all texts have, keeping it proves nothing.
        told = any(w not in self.number or self.rare[self.number[w]] for w in item.answer)
        return (item.item_id, cosine, common, answer) if told else None


def _items(benchmark: DataFrame, answer: str | None) -> Iterator[list[Item]]:
    """Blocks of items; those without words, and rows without an id, are nothing to leak."""
    columns = [F.col("item_id").cast("long").alias("item_id"), "text", (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer")]
    block: list[Item] = []
    held = 0
    for r in benchmark.select(*columns).where("item_id is not null and text is not null").toLocalIterator():
        words, said = words_of(r["text"]), words_of(r["answer"]) if r["answer"] else answer_of(r["text"])
        if not words:
            continue
        block.append(Item(r["item_id"], words, said))
        held += len(words)
        if len(block) == ITEMS_IN_BLOCK or held >= WORDS_IN_BLOCK:
            yield block
            block, held = [], 0
    if block:
        yield block


def _document_frequencies(docs: DataFrame, number: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Rows, and how many of them hold each word of the benchmark; over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, n = sent.value, Counter(), 0
        known = held.keys()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(known & set(words_of(text)))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *(held[w] for w in counts)], pa.int64()), pa.array([n, *counts.values()], pa.int64())], names=["w", "n"])

    out, n = np.zeros(len(number)), 0
    for r in docs.select("text").mapInArrow(released(run), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["w"] < 0:
            n = r["n"]
        else:
            out[r["w"]] = r["n"]
    return n, out


def _passages(docs: DataFrame, number: dict[bytes, int], size: int) -> DataFrame:
    """(ids) of the passages of all distinct texts."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for b in batches:
            out = []
            for text in b.column(2).to_pylist():
                words = words_of(text)
                cut = ([i for w in words[a : a + size] if (i := get(w)) is not None] for a in range(0, len(words), size))
                out.append([own for own in cut if own])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["h1", "h2", "passages"])

    texts = docs.select(F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), "text").where("text is not null")
    cut = texts.mapInArrow(released(run), "h1 long, h2 long, passages array<array<int>>").where(F.size("passages") > 0)
    return cut.dropDuplicates(["h1", "h2"]).select(F.explode("passages").alias("ids"))


def _gram_times(passages: DataFrame, weight: np.ndarray, q: np.ndarray) -> np.ndarray:
    """AᵀA q over the passages' weighted rows A: each task adds up its own, then blocks of rows are summed."""
    sent, blocks = passages.sparkSession.sparkContext.broadcast((weight, q)), max(1, len(weight) // 2048)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, q = sent.value
        out = np.zeros_like(q)
        for b in batches:
            sizes = b.column(0).value_lengths().to_numpy()
            ids, sizes = b.column(0).flatten().to_numpy(), sizes[sizes > 0]
            if not len(ids):
                continue
            w = weight[ids, None]
            sums = np.add.reduceat(w * q[ids], np.cumsum(sizes) - sizes, axis=0)
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[order], prepend=-1))
            out[ids[order][first]] += np.add.reduceat((w * np.repeat(sums, sizes, axis=0))[order], first, axis=0)
        cut = np.array_split(out, blocks)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int64()), pa.array([c.tobytes() for c in cut])], names=["block", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, q.dtype) for p in pdf["part"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [total.tobytes()]})

    rows = passages.mapInArrow(run, "block long, part binary").groupBy("block").applyInPandas(add, "block long, part binary").collect()
    return np.concatenate([np.frombuffer(r["part"], q.dtype).reshape(-1, q.shape[1]) for r in sorted(rows, key=lambda r: r["block"])]) if rows else np.zeros_like(q)


def randomised_svd(passages: DataFrame, own: list[np.ndarray], weight: np.ndarray, rank: int = RANK, times_own: float = 1.0) -> np.ndarray:
    """The leading right singular vectors (words x rank) of the passages and the driver's ``own`` rows, each of
    these ``times_own`` times."""
    width = min(len(weight), rank + OVERSAMPLING)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((len(weight), width)))[0]

    def times(q: np.ndarray) -> np.ndarray:
        out = _gram_times(passages, weight, q)
        for ids in own:
            w = weight[ids, None]
            np.add.at(out, ids, times_own * w * (w * q[ids]).sum(axis=0))
        return out

    for _ in range(POWER_ITERATIONS):
        q = np.linalg.qr(times(q))[0]
    values, vectors = np.linalg.eigh(q.T @ times(q))
    return q @ vectors[:, np.argsort(-values)[:rank]]


def build(docs: DataFrame, items: list[Item]) -> Index:
    number = {w: i for i, w in enumerate(sorted({w for item in items for w in item.words}))}
    n, df = _document_frequencies(docs, number)
    own = [np.array([number[w] for w in item.words]) for item in items]
    weight = np.maximum(0.0, np.log((n + 2) / (df + 1)) + np.log(MAX_SHARE))
    few = weight > 0
    for ids in own:  # an item of frequent words only is told by its rarest ones
        rare = ids[np.argsort(df[ids], kind="stable")[:TELLING_WORDS]]
        weight[rare] = np.maximum(weight[rare], 0.5)
    weighed = {w: i for w, i in number.items() if weight[i] > 0}
    tasks = max(FIT_TASKS, input_partitions(docs) // INPUT_TASKS)
    passages = written(_passages(docs, weighed, int(np.median([len(o) for o in own]))).repartition(tasks))
    # Items are few beside the passages; they count for as much as all of these, so that directions are theirs as well.
    alike = max(1.0, float((df * weight**2).sum() / max(1e-12, sum((weight[o] ** 2).sum() for o in own))))
    project = randomised_svd(passages, own, weight, min(MOST_RANK, max(RANK, len(items))), alike).astype(np.float32)
    sizes = np.array([1 << max(3, int(len(ids) - 1).bit_length()) for ids in own])
    mass = np.array([weight[ids].sum() for ids in own])
    whole = [(u, weight[u] * k) for u, k in (np.unique(ids, return_counts=True) for ids in own)]
    lengths = np.array([np.sqrt(x @ x) for _, x in whole])
    projected = np.array([x @ project[u] for u, x in whole])
    kept = np.linalg.norm(projected, axis=1) / np.maximum(lengths, 1e-12)
    groups: dict[tuple[int, bool], list[int]] = {}
    for i in range(len(items)):
        groups.setdefault((int(sizes[i]), bool(kept[i] >= MIN_KEPT)), []).append(i)
    classes = []
    for (size, latent), members in sorted(groups.items()):
        c = Class(size, np.array(members), mass[members], None)
        if latent:
            c.vectors = (projected[members] / np.maximum(np.linalg.norm(projected[members], axis=1, keepdims=True), 1e-12)).astype(np.float32)
        else:
            words = np.concatenate([whole[i][0] for i in members])
            order = np.argsort(words, kind="stable")
            c.holders = np.repeat(np.arange(len(members)), [len(whole[i][0]) for i in members])[order]
            c.parts = np.concatenate([whole[i][1] / lengths[i] for i in members])[order]
            c.starts = np.searchsorted(words[order], np.arange(len(number) + 1))
        classes.append(c)
    return Index(number, weight, few, project, items, own, classes, kept)


LEAKS = "array<struct<item_id:bigint,cosine:double,common:double,answer:double>>"
_LEAK = pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.float64())])


def mark(docs: DataFrame, benchmark: DataFrame, answer: str | None = None, column: str = "leaks") -> DataFrame:
    """Add ``column``, the benchmark items that leaked into each row's whole ``text``, with the cosine
    of the passage, the share of the item's words that it has in order and that of the answer's.

    ``benchmark``: item_id, text and, if named, an ``answer`` column (where it is null, and without
    one, the last sentence stands for the answer). Null and empty texts, and an empty benchmark, have
    no leaks; an item given twice is found twice; all rows and columns of ``docs`` pass through, which
    must not have ``column`` already.
    """
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has a column {column}")
    small_batches(docs.sparkSession)
    docs = spread(docs)
    out, at = docs.withColumn(column, F.array().cast(LEAKS)), docs.columns.index("text")
    for k, items in enumerate(_items(benchmark, answer)):
        if k:  # one block's index in a worker at a time
            out = written(out)
        index = docs.sparkSession.sparkContext.broadcast(build(docs, items))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, new = b.column(at).to_pylist(), []
                while len(new) < len(texts):  # so many texts together as their characters allow, or one
                    size, end = len(texts[len(new)] or ""), len(new) + 1
                    while end < len(texts) and (size := size + len(texts[end] or "")) <= CHARACTERS:
                        end += 1
                    new += index.value.leaks_of(texts[len(new) : end])
                leaks = [[*(tuple(x.values()) for x in old), *found] for found, old in zip(new, b.column(b.num_columns - 1).to_pylist(), strict=True)]
                rows = [[dict(zip(("item_id", "cosine", "common", "answer"), x, strict=True)) for x in row] for row in leaks]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.list_(_LEAK))], names=b.schema.names)

        out = out.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField(column, T._parse_datatype_string(LEAKS))]))
    return out


def pairs(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer) of every leak; ``docs``: doc_id, text."""
    marked = mark(docs.select("doc_id", "text"), benchmark, answer)
    return marked.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.cosine", "x.common", "x.answer")


def reject(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns as they are."""
    return mark(docs, benchmark, answer, "__leaks").where(F.size("__leaks") == 0).drop("__leaks")
