"""BPE encoding and decoding over a pair occurrence index.

All distinct new words of some batches are laid out as one array of symbols. An index maps each
mergeable pair to all its positions; ranks are applied in ascending order, each to its whole
list of positions at once, and only the lists of the pairs beside a merge are touched. A word's
symbols then are its tokens. What stands between white space recurs, so its tokens are kept (a
bounded number of them) for the batches that follow, by the text as it is: only new pieces are
normalised and split.

The vocabulary file is read on the driver (its path is a parameter) and broadcast: its size is
that of one tokenizer, whatever the data.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..operators.spread import spread
from .common import released, small_batches

# Unicode's White_Space characters, as the tokenizer's pattern means them.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Characters that Unicode versions treat differently: unassigned in some, or beyond the basic plane.
RARE = regex.compile("[\\p{Cn}\\u1c80-\\u1c8f\\ua7c0-\\ua7ff\\U00010000-\\U0010ffff]")

#: What plain Latin text does not hold: there the standard library's faster engine agrees.
PLAIN = re.compile("[^\\x00-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]|[\\x1c-\\x1f]")

#: Bits that hold a token id.
SHIFT = 20

#: A vocabulary file beyond this is refused rather than broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces whose tokens a worker keeps, and as many of the ones before: pieces that recur stay.
MAX_KEPT_WORDS = 300_000
#: Texts that are encoded together: batches are gathered up to so many bytes.
GATHERED_BYTES = 4 << 20


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable, else the next free
    character from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class WordBpe:
    """One tokenizer file of the kind: BPE with word ends, bytes as characters, no decoder."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("unk_token") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models over bytes are supported")
        if spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("decoders and post-processors are not supported")
        kinds = {n["type"] for n in spec["normalizer"]["normalizers"]}
        if kinds != {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalizers {sorted(kinds)} are not supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pieces = regex.compile(split["pattern"]["Regex"].replace("\\s", WHITE_SPACE))
        self.plain_pieces = re.compile(split["pattern"]["Regex"].replace("[^\\s\\p{L}\\p{N}]", "(?:[^\\s\\w]|_)").replace("[\\p{L}]", "[^\\W\\d_]").replace("[\\p{N}]", "\\d"))
        self.spaces = re.compile(f"[{WHITE_SPACE}]+")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        #: left << SHIFT | right: (rank, merged)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(self.vocab[a] << SHIFT | self.vocab[b], (rank, self.vocab[a + b]))
        self.no_rank = len(model["merges"])
        self.parts = {rank: (pair >> SHIFT, pair & (1 << SHIFT) - 1, merged) for pair, (rank, merged) in self.merges.items()}
        keys = sorted(self.merges)
        self.pair_keys = np.array([*keys, 1 << 62])
        self.pair_ranks = np.array([*(self.merges[k][0] for k in keys), self.no_rank])
        chars = byte_characters()
        self.inner = [self.vocab.get(c) for c in chars]
        self.last = [self.vocab.get(c + self.suffix) for c in chars]
        self.inner_of, self.last_of = (np.array([-1 if i is None else i for i in x]) for x in (self.inner, self.last))
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.kept: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word, by the pair occurrence index over all of them."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw])
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner_of[flat]
        last = ends[sizes > 0] - 1
        symbol[last] = self.last_of[flat[last]]
        owner = np.repeat(np.arange(len(words)), sizes)
        if (symbol < 0).any():  # bytes that the vocabulary lacks
            symbol, owner = symbol[symbol >= 0], owner[symbol >= 0]
        at = np.arange(len(symbol))
        first = np.append(True, owner[1:] != owner[:-1])[: len(symbol)]
        before = np.where(first, -1, at - 1)
        after = np.where(np.append(first[1:], True)[: len(symbol)], -1, at + 1)

        def ranks_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            """The merge of each pair; one past the last where there is none."""
            key = left << SHIFT | right
            spot = np.searchsorted(self.pair_keys, key)
            return np.where(self.pair_keys[spot] == key, self.pair_ranks[spot], self.no_rank)

        #: rank: the positions of its pair
        index: dict[int, list[int]] = {}
        pairs = at[after >= 0]
        ranks = ranks_of(symbol[pairs], symbol[after[pairs]])
        order = np.argsort(ranks, kind="stable")
        pairs, ranks = pairs[order], ranks[order]
        cuts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])[: len(ranks)]).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(ranks)], strict=False):
            if ranks[i] != self.no_rank:
                index[int(ranks[i])] = pairs[i:j].tolist()
        active = list(index)
        heapq.heapify(active)
        again: set[int] = set()
        while active:
            rank = heapq.heappop(active)
            left, right, merged = self.parts[rank]
            spots = np.array(index.pop(rank))
            spots = spots[symbol[spots] == left]
            nexts = after[spots]
            spots = spots[(nexts >= 0) & (symbol[nexts] == right)]
            if left == right:
                # Overlapping pairs: the leftmost goes first.
                free, taken = [], -1
                for i in sorted(set(spots.tolist())):
                    if i != taken:
                        free.append(i)
                        taken = int(after[i])
                spots = np.array(free, np.int64)
            if not len(spots):
                continue
            nexts = after[spots]
            beyond = after[nexts]
            symbol[spots], symbol[nexts], after[spots] = merged, -1, beyond
            inside = beyond >= 0
            before[beyond[inside]] = spots[inside]
            ahead = before[spots]
            starts = np.concatenate([spots[inside], ahead[ahead >= 0]])
            found = ranks_of(symbol[starts], symbol[after[starts]])
            for r, i in zip(found.tolist(), starts.tolist(), strict=True):
                if r == self.no_rank:
                    continue
                if r < rank:  # that pair should have come before others of this word
                    again.add(int(owner[i]))
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
                    heapq.heappush(active, r)
        ids = symbol[symbol >= 0].tolist()
        counts = np.cumsum(np.bincount(owner[symbol >= 0], minlength=len(words))).tolist()
        out = [ids[i:j] for i, j in zip([0, *counts], counts, strict=False)]
        if again:
            some = sorted(again)
            for w, tokens in zip(some, self.merge_in_turn([words[w] for w in some]), strict=True):
                out[w] = tokens
        return out

    def merge_in_turn(self, words: list[str]) -> list[list[int]]:
        """The same, one position at a time: a merge that makes a pair of a lower rank in its word holds the
        word's other positions back until that pair is merged."""
        symbol: list[int] = []
        before: list[int] = []
        after: list[int] = []
        owner: list[int] = []
        heads: list[int] = []
        for w, word in enumerate(words):
            raw = word.encode()
            ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
            ids = [i for i in ids if i is not None]
            at = len(symbol)
            heads.append(at if ids else -1)
            symbol += ids
            before += [-1, *range(at, at + len(ids) - 1)] if ids else []
            after += [*range(at + 1, at + len(ids)), -1] if ids else []
            owner += [w] * len(ids)
        merge_of = self.merges.get
        #: rank: positions of its pair, left symbol, right symbol, merged symbol
        index: dict[int, tuple[list[int], int, int, int]] = {}
        for i, j in enumerate(after):
            if j >= 0 and (m := merge_of(symbol[i] << SHIFT | symbol[j])):
                if (e := index.get(m[0])) is None:
                    index[m[0]] = ([i], symbol[i], symbol[j], m[1])
                else:
                    e[0].append(i)
        active = list(index)
        heapq.heapify(active)
        push = heapq.heappush
        while active:
            rank = heapq.heappop(active)
            at, left, right, merged = index.pop(rank)
            at.sort()
            waiting: list[int] = []
            held = -1  # a word in which a merge made a pair of a lower rank: that one goes first
            for i in at:
                if symbol[i] != left:
                    continue
                j = after[i]
                if j < 0 or symbol[j] != right:
                    continue
                if owner[i] == held:
                    waiting.append(i)
                    continue
                symbol[i], symbol[j] = merged, -1
                after[i] = k = after[j]
                h = before[i]
                if k >= 0:
                    before[k] = i
                    if m := merge_of(merged << SHIFT | symbol[k]):
                        if (e := index.get(m[0])) is None:
                            index[m[0]] = ([i], merged, symbol[k], m[1])
                            push(active, m[0])
                        else:
                            e[0].append(i)
                        if m[0] < rank:
                            held = owner[i]
                if h >= 0 and (m := merge_of(symbol[h] << SHIFT | merged)):
                    if (e := index.get(m[0])) is None:
                        index[m[0]] = ([h], symbol[h], merged, m[1])
                        push(active, m[0])
                    else:
                        e[0].append(h)
                    if m[0] < rank:
                        held = owner[i]
            if waiting:
                if (e := index.get(rank)) is None:
                    index[rank] = (waiting, left, right, merged)
                    push(active, rank)
                else:
                    e[0].extend(waiting)
        out = []
        for i in heads:
            ids = []
            while i >= 0:
                ids.append(symbol[i])
                i = after[i]
            out.append(ids)
        return out

    def cut(self, text: str) -> list[str]:
        """What stands between white space: neither normalising nor splitting looks beyond it. Python takes
        four control characters for white space that the tokenizer does not."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in self.spaces.split(text) if x]
        return text.split()

    def split(self, text: str) -> list[str | int]:
        """Special tokens as ids, all else as normalised words."""
        if text.isascii() and text.isalpha():
            return [text.lower()]
        out: list[str | int] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if not part.isascii() and RARE.search(part):
                    # The library's own Unicode tables split these; merging stays here.
                    shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                    out += [bytes(self.byte_of[c] for c in piece).decode() for piece, _ in shown]
                    continue
                if not part.isascii():
                    # One character at a time: a final sigma gets no form of its own.
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                low = part.lower()
                out += (self.pieces if PLAIN.search(low) else self.plain_pieces).findall(low)
        return out

    def learn(self, chunks: list[str]) -> None:
        """Keep the tokens of what is not kept yet."""
        split = [self.split(c) for c in chunks]
        tokens = dict.fromkeys(w for s in split for w in s if isinstance(w, str))
        # A word of plain letters is a piece as well, and may have been one.
        words = [w for w in tokens if not (w.isascii() and w.isalpha() and w in self.kept)]
        tokens.update((w, self.kept[w]) for w in tokens if w in self.kept and w.isascii() and w.isalpha())
        tokens.update(zip(words, self.merge_words(words), strict=True))
        for c, s in zip(chunks, split, strict=True):
            self.kept[c] = tuple(chain.from_iterable([w] if isinstance(w, int) else tokens[w] for w in s))

    def prepare(self, texts: Iterable[str]) -> None:
        """Learn all that ``texts`` hold, together."""
        if len(self.kept) > MAX_KEPT_WORDS:
            self.before, self.kept = self.kept, {}
        new: set[str] = set()
        for t in texts:
            new.update(self.cut(t))
        new.difference_update(self.kept)
        known = [c for c in new if c in self.before]
        self.kept.update(zip(known, map(self.before.__getitem__, known), strict=True))
        new.difference_update(known)
        self.learn(sorted(new))

    def encode(self, texts: list[str], prepared: bool = False) -> list[list[int]]:
        if not prepared:
            self.prepare(texts)
        get = self.kept.__getitem__
        return [list(chain.from_iterable(map(get, self.cut(t)))) for t in texts]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, the tokens one space apart."""
        try:
            return " ".join(map(self.token.__getitem__, ids))
        except KeyError:
            return " ".join([self.token[i] for i in ids if i in self.token])


_loaded: dict[int, WordBpe] = {}


def _worker(spec) -> WordBpe:
    """The tokenizer of a broadcast file, parsed once in a worker."""
    if spec.id not in _loaded:
        _loaded.clear()
        _loaded[spec.id] = WordBpe(json.loads(spec.value))
    return _loaded[spec.id]


def _shared(df: DataFrame, path: str):
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    with open(path, encoding="utf-8") as f:
        return _Spec(df.sparkSession.sparkContext.broadcast(f.read()))


class _Spec:
    """A broadcast text with an id that tells worker caches apart."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> str:
        return self.broadcast.value


def _gather(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches that are worked on together, as the column ``at`` has about GATHERED_BYTES in them."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(at).nbytes
        if size >= GATHERED_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _free(df: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"the input already has {sorted(taken)}; name other result columns")


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` array<int>, the tokens of ``text``. A null or empty text has none. The result
    column must not clash with an input column; all other columns pass through."""
    _free(df, ids)
    small_batches(df.sparkSession)
    spec = _shared(df, path)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(spec)
        for gathered in _gather(batches, at):
            bpe.prepare(t or "" for b in gathered for t in b.column(at).to_pylist())
            for b in gathered:
                out = bpe.encode([t or "" for t in b.column(at).to_pylist()], prepared=True)
                ends = np.cumsum([0, *map(len, out)])
                flat = np.fromiter(chain.from_iterable(out), np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=[*b.schema.names, ids])

    return spread(df).mapInArrow(released(run), T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the decoded ``ids`` (special tokens included, unknown ids left out). Null
    ids give an empty text."""
    _free(df, text)
    small_batches(df.sparkSession)
    spec = _shared(df, path)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(spec)
        for b in batches:
            column = b.column(at)
            values, starts, sizes = column.values.to_numpy(), column.offsets.to_pylist(), column.value_lengths().to_pylist()
            out = [bpe.decode(values[i : i + (n or 0)].tolist()) for i, n in zip(starts, sizes, strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, text])

    return df.mapInArrow(released(run), T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text);
    extra columns are ignored, null texts count as empty, repeated rows each give a row."""
    both = decode(encode(docs.select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
