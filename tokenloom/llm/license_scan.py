"""License scan: phrases, and templates with optional and replaceable regions.

Template markup: ``[[ ... ]]`` is a region that may be left out, ``{{a,b}}`` is replaceable by any
``a`` to ``b`` words. All else is mandatory wording. A template is compiled into an automaton over
words; a text is accepted where some run of its words takes the automaton from start to end, so
every mandatory word must be there exactly, in its order, with only the allowed words between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.spread import spread
from .common import small_batches

# The phrases and labels of the base count.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public licence wordings, as templates.
TEMPLATES = (
    ("mit", "[[this {{1,4}} is]] released under the mit license"),
    ("mit", "[[copyright c {{1,12}}]] permission is hereby granted free of charge to any person obtaining a copy of {{1,6}} and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0 [[the license you may not use this {{1,3}} except in compliance with the license]]"),
    ("gpl", "[[this {{1,4}} is]] licensed under the gnu general public license [[version {{1,2}}]]"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under [[a]] [[creative commons]] cc by nc [[{{1,2}} 4 0]]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes that part words become spaces; every other byte stays.
_PARTING = bytes(0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the runs of digits, letters a-z and characters beyond ASCII."""
    return (text or "").encode().lower().translate(_PARTING).split()


class Automaton:
    """Word automaton of one template. State i has edges: a word to i + 1, any word to i + 1, or
    jumps that take no word."""

    def __init__(self, markup: str):
        self.words: list[bytes | None] = []
        self.jumps: dict[int, set[int]] = {}
        opened: list[int] = []
        mandatory = []
        for item in re.findall(r"\[\[|\]\]|\{\{\d+,\d+\}\}|[^\s\[\]{}]+", markup):
            if item == "[[":
                opened.append(len(self.words))
            elif item == "]]":
                self.jumps.setdefault(opened.pop(), set()).add(len(self.words))
            elif item.startswith("{{"):
                least, most = map(int, item[2:-2].split(","))
                at = len(self.words)
                self.words += [None] * most
                for i in range(least, most):
                    self.jumps.setdefault(at + i, set()).add(at + most)
            else:
                word = item.encode().lower()
                if not opened:
                    mandatory.append(word)
                self.words.append(word)
        if opened or not mandatory:
            raise ValueError(f"a template needs closed regions and some mandatory wording: {markup}")
        self.rarest = max(mandatory, key=len)  # a text without it can't be accepted
        self.end = len(self.words)
        self.close = [self._closure({i}) for i in range(self.end + 1)]
        first = {self.words[i] for i in self.close[0] if i < self.end}
        self.first = None if None in first else frozenset(first)

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for j in self.jumps.get(todo.pop(), ()):
                if j not in out:
                    out.add(j)
                    todo.append(j)
        return frozenset(out)

    def accepts_at(self, words: list[bytes], start: int) -> int:
        """The end of the longest accepted run of words from ``start``, or -1."""
        states, found, i = self.close[0], -1, start
        while states:
            if self.end in states:
                found = i
            if i >= len(words):
                break
            w, after = words[i], set()
            for s in states:
                if s < self.end and (self.words[s] is None or self.words[s] == w):
                    after |= self.close[s + 1]
            states, i = after, i + 1
        return found

    def find(self, words: list[bytes]) -> tuple[int, int] | None:
        """The first accepted run."""
        for i, w in enumerate(words):
            if (self.first is None or w in self.first) and (end := self.accepts_at(words, i)) > i:
                return i, end
        return None


def phrase_starts(words: list[bytes], phrase: list[bytes]) -> list[int]:
    head, n = phrase[0], len(phrase)
    return [i for i, w in enumerate(words) if w == head and words[i : i + n] == phrase]


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(words_of(p), label) for p, label in phrases]
        self.templates = [(label, Automaton(markup)) for label, markup in templates]

    def scan(self, text: str | None) -> tuple:
        low = (text or "").encode().lower().translate(_PARTING)
        words = low.split()
        starts, base, found, spans = [], set(), set(), []
        for phrase, label in self.phrases:
            if phrase[-1] in low and (at := phrase_starts(words, phrase)):
                starts += at
                base.add(label)
        for label, automaton in self.templates:
            if automaton.rarest in low and (span := automaton.find(words)):
                found.add(label)
                spans.append({"label": label, "start": span[0], "end": span[1]})
        score = 1.0 if found else 0.5 if base else 0.0
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score, spans


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row.

    ``docs`` has doc_id and text; extra columns are ignored, repeated rows each give a row, a null or
    empty text has no words, no labels and score 0. Score: 1 where a template accepts a run of the
    text's words, 0.5 where only a phrase stands in it, else 0. ``spans``: each accepting template's
    label and first accepted run, as word positions [start, end)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(_SPAN)]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for b in batches:
            rows = [scanner.scan(t) for t in b.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs.select("doc_id", "text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long>>"
    )
