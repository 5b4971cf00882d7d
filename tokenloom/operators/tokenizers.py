"""Exact token counts: pieces split off natively, and merged here once for each distinct piece of a batch.

A built-in regular expression splits texts inside the JVM; one Arrow function merges pieces by the vocabulary's ranks
and adds up. Nothing is shuffled, and no token leaves the function. Only tokenizer files of kinds that are not
byte-level pair encodings are left to the tokenizers library, where it is installed.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import released, small_batches
from .spread import spread

try:
    import tokenizers as library
except ImportError:
    library = None

# The alternatives that split texts before merging, in order, as published with each
# encoding. \s is Unicode's white space.
_CONTRACTED = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
_UPPER, _LOWER = r"\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}", r"\p{Ll}\p{Lm}\p{Lo}\p{M}"
_NO_HAN = r"&&[^\p{Han}]"
#: Han runs apart, words with a leading sign, digits by three, signs, space.
KIMI = "|".join(
    [
        r"\p{Han}+",
        rf"[^\r\n\p{{L}}\p{{N}}]?[{_UPPER}{_NO_HAN}]*[{_LOWER}{_NO_HAN}]+{_CONTRACTED}",
        rf"[^\r\n\p{{L}}\p{{N}}]?[{_UPPER}{_NO_HAN}]+[{_LOWER}{_NO_HAN}]*{_CONTRACTED}",
        r"\p{N}{1,3}",
        r" ?[^\s\p{L}\p{N}]+[\r\n]*",
        r"\s*[\r\n]+",
        r"\s+(?!\S)",
        r"\s+",
    ]
)
O200K = "|".join(
    [
        rf"[^\r\n\p{{L}}\p{{N}}]?[{_UPPER}]*[{_LOWER}]+{_CONTRACTED}",
        rf"[^\r\n\p{{L}}\p{{N}}]?[{_UPPER}]+[{_LOWER}]*{_CONTRACTED}",
        r"\p{N}{1,3}",
        r" ?[^\s\p{L}\p{N}]+[\r\n/]*",
        r"\s*[\r\n]+",
        r"\s+(?!\S)",
        r"\s+",
    ]
)
CL100K = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The split of each encoding that has a name.
ENCODINGS = {"o200k_base": O200K, "o200k_harmony": O200K, "cl100k_base": CL100K, "r50k_base": BYTE_LEVEL, "p50k_base": BYTE_LEVEL, "gpt2": BYTE_LEVEL}


def native(pattern: str) -> str:
    """A pattern in the words of Spark's regular expressions."""
    return pattern.replace(r"\p{Han}", r"\p{IsHan}").replace(r"\S", r"[^\p{IsWhite_Space}]").replace(r"\s++$", r"\p{IsWhite_Space}++\z").replace(r"\s", r"\p{IsWhite_Space}")


PIECES = native(KIMI)


def pretokenize(text: str | Column, pattern: str = PIECES) -> Column:
    """The pieces of a text, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def parse_rank_lines(lines: DataFrame) -> DataFrame:
    """(rank, token) of lines ``value``: base64, one space, a rank. Other lines are passed over."""
    parts = F.split(F.trim("value"), r"\s+")
    fine = F.size(parts) == 2
    token = F.try_to_binary(F.when(fine, parts[0]), F.lit("base64"))
    return lines.select(F.when(fine & parts[1].rlike(r"^\d+$"), parts[1]).try_cast("int").alias("rank"), token.alias("token")).where("rank is not null and token is not null and length(token) > 0")


def rank_density(ranks: DataFrame) -> DataFrame:
    """One row: entries, distinct ranks, ranks there should be, and how many are missing."""
    return ranks.agg(
        F.count("*").alias("entries"), F.countDistinct("rank").alias("distinct_ranks"), F.coalesce(F.max("rank") + 1, F.lit(0)).cast("bigint").alias("expected_ranks")
    ).withColumn("missing", F.col("expected_ranks") - F.col("distinct_ranks"))


def parse_rank_file(text: str) -> dict[bytes, int]:
    """Tokens and their ranks; refused when there are none, or ranks are missing."""
    out: dict[bytes, int] = {}
    for line in text.splitlines():
        parts = line.split()
        if len(parts) != 2 or not parts[1].isdigit():
            continue
        try:
            token = base64.b64decode(parts[0], validate=True)
        except ValueError:
            continue
        if token:
            out[token] = int(parts[1])
    if not out:
        raise ValueError("the rank file has no usable entries")
    expected = max(out.values()) + 1
    if missing := expected - len(set(out.values())):
        raise ValueError(f"the rank file is missing {missing} of {expected} ranks")
    return out


def synthetic_ranks() -> dict[bytes, int]:
    """Single bytes, then two merges: a table small enough to reckon by hand."""
    return {bytes([b]): b for b in range(256)} | {b"lo": 256, b"He": 257}


def _merge(ends: list[int], rank_of: Callable[[int, int, int], int | None]) -> list[int]:
    """Join adjacent parts, those of lowest rank first and of these the leftmost, until none join. Part i
    begins at i and ends at ``ends[i]``; ``rank_of`` (start, middle, end) tells the rank of two parts as one.
    Gives the starts of the parts that are left. Takes n log n steps."""
    n = len(ends)
    before, alive, waiting = list(range(-1, n - 1)), [True] * n, []

    def look(i: int) -> None:
        middle = ends[i]
        if middle < n and (rank := rank_of(i, middle, ends[middle])) is not None:
            heapq.heappush(waiting, (rank, i, ends[middle]))

    for i in range(n - 1):
        look(i)
    while waiting:
        _, i, end = heapq.heappop(waiting)
        middle = ends[i]
        if not alive[i] or middle >= n or ends[middle] != end:
            continue  # one of the two has been joined with another meanwhile
        alive[middle], ends[i] = False, end
        if end < n:
            before[end] = i
            look(i)
        if before[i] >= 0:
            look(before[i])
    return [i for i in range(n) if alive[i]]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece: itself if it is one, else what joining its bytes by rank gives."""
    if piece in ranks or not piece:
        return [piece] if piece else []
    starts = _merge(list(range(1, len(piece) + 1)), lambda i, _, end: ranks.get(piece[i:end]))
    return [piece[i:j] for i, j in zip(starts, [*starts[1:], len(piece)], strict=True)]


def merge_symbols(symbols: list[str], merges: dict[tuple[str, str], int]) -> list[str]:
    """The same by the ranks of pairs of symbols."""

    def joined(i: int, j: int) -> str:
        return symbols[i] if j == i + 1 else "".join(symbols[i:j])

    starts = _merge(list(range(1, len(symbols) + 1)), lambda i, middle, end: merges.get((joined(i, middle), joined(middle, end))))
    return [joined(i, j) for i, j in zip(starts, [*starts[1:], len(symbols)], strict=True)]


def _each(count: Callable[[str], int]) -> Callable[[list[str]], list[int | None]]:
    """Counts of texts; null for one that fails, which is not to take the others with it."""

    def one(text: str) -> int | None:
        try:
            return count(text)
        except Exception:
            return None

    return lambda texts: [one(t) for t in texts]


class RankVocabulary:
    """A rank table with its split. ``pieces``: the split as Spark's regular expressions have it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = KIMI):
        self.ranks, self.pattern, self.pieces = ranks, pattern, native(pattern)

    whole = False

    def counter(self) -> Callable[[str], int]:
        """Counts a piece."""
        ranks = self.ranks
        return lambda piece: len(merge_bytes(piece.encode(), ranks))


def _byte_characters() -> list[str]:
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class TokenizerFile:
    """A tokenizer.json. Byte-level pair encodings without a normalizer are read here; the library reads all other
    kinds (``whole``: it counts whole texts); without it these are refused, so that the model's count stays an
    estimate. A template's own tokens never count: they are there for an empty text as well, and that is taken off."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.text, self.whole = text, False
        model, split = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        # Tokens beside the vocabulary that are not special are found in texts before these are split.
        added = [t for t in spec.get("added_tokens") or [] if not t.get("special")]
        plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and not spec.get("normalizer") and not odd and not added
        if not plain:
            if library is None:
                raise ValueError("without the tokenizers library only byte-level BPE files without a normalizer or a prefix space are read")
            try:
                library.Tokenizer.from_str(text)
            except Exception as e:  # the library's own error has no narrower type
                raise ValueError(f"no tokenizer file: {e}") from e
            self.whole = True
            return
        self.pieces = native(BYTE_LEVEL) if split.get("use_regex", True) else r"(?s).+"
        self.vocab = model["vocab"]
        self.merges = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.unknown = model.get("unk_token")

    def counter(self) -> Callable[[str], int]:
        """Counts a piece."""
        chars, vocab, merges, unknown = _byte_characters(), self.vocab, self.merges, self.unknown

        def count(piece: str) -> int:
            symbols = [chars[b] for b in piece.encode()]
            symbols = [s for s in symbols if s in vocab or unknown in vocab] if unknown else [s for s in symbols if s in vocab]
            return len(merge_symbols(symbols, merges))

        return count

    def text_counter(self) -> Callable[[list[str]], list[int | None]] | None:
        if not self.whole:
            return None
        tokenizer = library.Tokenizer.from_str(self.text)
        tokenizer.no_truncation(), tokenizer.no_padding()
        # What a text says is text, be it a special token's name.
        tokenizer.encode_special_tokens = True
        empty = len(tokenizer.encode("").ids)
        return _each(lambda text: max(0, len(tokenizer.encode(text).ids) - empty))


#: Bytes of the pieces whose counts a worker keeps; then it begins anew. An entry takes some 100 bytes beside its text.
KEPT_BYTES, ENTRY_BYTES = 48 << 20, 100
#: Bytes of the vocabularies that executors hold, as they are sent; beyond it those not used for longest are released
#: (and sent again should they be asked for).
SENT_BYTES = 256 << 20
_sent: OrderedDict[tuple[str, int], tuple[object, Broadcast, int]] = OrderedDict()


def send(spark: SparkSession, vocabulary: RankVocabulary | TokenizerFile) -> Broadcast:
    """The vocabulary as executors have it: sent once an application, however many counts use it."""
    context = spark.sparkContext
    key = (context.applicationId, id(vocabulary))
    if key not in _sent:
        out = context.broadcast(vocabulary)
        _sent[key] = vocabulary, out, os.path.getsize(out._path) if out._path else 0
    _sent.move_to_end(key)
    for old in [k for k in _sent if k[0] != context.applicationId]:
        del _sent[old]  # gone with its application
    while sum(size for _, _, size in _sent.values()) > SENT_BYTES and len(_sent) > 1:
        _, (_, old, _) = _sent.popitem(last=False)
        old.unpersist()
    return _sent[key][1]


def token_counter(spark: SparkSession, vocabulary: RankVocabulary | TokenizerFile) -> Callable[[str | Column], Column]:
    """A function from a column of texts to numbers of tokens: 0 for null, null where a text cannot be
    encoded. The vocabulary is broadcast; it has the size of one model's, whatever the data. A worker holds the pieces of
    few texts at a time, and gives its memory back when it has seen all of a task's."""
    small_batches(spark)
    sent = send(spark, vocabulary)

    @F.arrow_udf("bigint")
    @released
    def of_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = sent.value.text_counter()
        for texts in batches:
            yield pa.array(count([t or "" for t in texts.to_pylist()]), pa.int64())

    @F.arrow_udf("bigint")
    @released
    def of_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count, kept, held = sent.value.counter(), {}, 0
        for pieces in batches:
            encoded = pieces.flatten().dictionary_encode()
            if held > KEPT_BYTES:
                kept.clear()
                held = 0
            entries = encoded.dictionary.to_pylist()
            for p in entries:
                if p not in kept:
                    kept[p] = count(p)
                    held += len(p) + ENTRY_BYTES
            each = np.fromiter((kept[p] for p in entries), np.int64, count=len(entries))
            sums = np.concatenate([[0], np.cumsum(each[encoded.indices.to_numpy()])]) if len(entries) else np.zeros(1, np.int64)
            ends = np.cumsum(np.nan_to_num(pieces.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            yield pa.array(np.diff(sums[np.concatenate([[0], ends])]) if len(ends) else ends)

    if vocabulary.whole:
        return lambda text: of_texts(F.col(text) if isinstance(text, str) else text)
    return lambda text: of_pieces(pretokenize(text, vocabulary.pieces))


def count_exact(texts: DataFrame, vocabulary: RankVocabulary | TokenizerFile, text: str | Column = "text", name: str = "count") -> DataFrame:
    """``texts`` with the number of tokens of each text (0 for null; null where it cannot be encoded)."""
    return spread(texts).withColumn(name, token_counter(texts.sparkSession, vocabulary)(text))
