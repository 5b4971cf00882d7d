"""Ignore rules: each line becomes a regular expression, and the last rule that matches decides.

A root's rules make one expression: neighbours that decide alike are alternatives, and a block that takes back
stands as a negative look-ahead before all that came earlier. So one match tells what the last rule that matches says.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .places import Local

#: Bytes of an ignore file that are read.
RULES_BYTES = 64 << 20
#: The end of a name, which may hold line feeds; written alike in Python and Java.
END = r"(?![\s\S])"


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool
    directory_only: bool


def _translate(glob: str) -> str:
    """A pattern's segments as a regular expression (the same in Python and Java)."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + r"/[\s\S]+", i + 3
        elif c == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + "[" + ("^/" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def parse_rules(text: str) -> list[Rule]:
    """Rules in order. Blank lines and comments are nothing; trailing spaces go unless escaped."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        glob = line[1:] if negated else line
        directory_only = glob.endswith("/")
        glob = glob.rstrip("/") if directory_only else glob
        anchored = "/" in glob
        glob = glob.lstrip("/")
        if not glob:
            continue
        pattern = ("" if anchored else "(?:[^/]+/)*") + _translate(glob)
        try:
            re.compile(pattern)
        except re.error:  # a range that runs backwards, say: it names nothing
            continue
        rules.append(Rule(pattern, negated, directory_only))
    return rules


def rules_text(place, root: str) -> str:
    """The lines of a root's .gitignore, then those of .git/info/exclude; either may be absent."""
    text = []
    for name in (".gitignore", ".git/info/exclude"):
        try:
            text.append(place.read(os.path.join(root, name), RULES_BYTES).decode("utf-8", "replace"))
        except OSError:
            continue
    return "\n".join(text)


class IgnoreRules:
    """Rules of one root, applied to paths relative to it."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules

    @classmethod
    def of_root(cls, root: str) -> IgnoreRules:
        """The root's .gitignore, then .git/info/exclude; either may be absent."""
        return cls(parse_rules(rules_text(Local(), root)))

    def blocks(self, directory: bool) -> list[tuple[bool, str]]:
        """(negated, pattern) of the rules for directories, or for files; neighbours that decide alike are one."""
        mine = [r for r in self.rules if directory or not r.directory_only]
        return [(negated, "(?:" + "|".join(f"(?:{r.pattern})" for r in rules) + ")" + END) for negated, rules in groupby(mine, key=lambda r: r.negated)]

    def expression(self, directory: bool) -> str:
        """One expression that matches, from its beginning, a path that the rules name; no rules, no match."""
        out = "(?!)"
        for negated, pattern in self.blocks(directory):
            out = f"(?:(?!{pattern}){out})" if negated else f"(?:{pattern}|{out})"
        return f"^{out}"

    @cached_property
    def _compiled(self) -> dict[bool, list[tuple[bool, re.Pattern]]]:
        return {d: [(negated, re.compile(p)) for negated, p in reversed(self.blocks(d))] for d in (False, True)}

    def _decide(self, path: str, directory: bool) -> bool:
        return next((not negated for negated, p in self._compiled[directory] if p.match(path)), False)

    def is_ignored(self, path: str, directory: bool = False) -> bool:
        """Also below an ignored directory, which nothing can take back. The root itself and what is
        outside of it are not ignored."""
        path = path.strip("/")
        if not path or path == "." or path.split("/")[0] == "..":
            return False
        parts = path.split("/")
        return any(self._decide("/".join(parts[:i]), True) for i in range(1, len(parts))) or self._decide(path, directory)

    def column(self, path: Column) -> Column:
        """The same for a column of file paths relative to the root."""
        return _ignored(path, lambda p: p.rlike(self.expression(True)), lambda p: p.rlike(self.expression(False)))


def _ignored(path: Column, directory, file) -> Column:
    """Whether rules name a file or a directory above it. ``directory`` and ``file``: what they say of one path."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inside = F.when(F.size(parts) > 1, F.exists(above, directory)).otherwise(F.lit(False))
    outside = (path == "") | (path == ".") | path.startswith("../")
    return F.when(outside, F.lit(False)).otherwise(inside | file(path))


def compiled(rules: DataFrame, root: str = "root", text: str = "rules") -> DataFrame:
    """(root, for_directories, for_files): a row for each row of ``rules`` (a root and the text of its ignore file),
    with what names its directories and files as one expression each. A null text has no rules."""
    ship(rules.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [IgnoreRules(parse_rules(x or "")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r.expression(d) for r in own], pa.string()) for d in (True, False)]], names=["root", "for_directories", "for_files"])

    return rules.select(root, text).mapInArrow(run, f"root {rules.schema[root].dataType.simpleString()}, for_directories string, for_files string")


def with_ignored(files: DataFrame, rules: DataFrame, root: str = "root", relative: str = "relative", text: str = "rules") -> DataFrame:
    """``files`` (a root and a path relative to it) with ``ignored``: whether the rules of its root name it, in one plan
    for any number of roots. ``rules``: (root, text of its ignore file), one row a root; roots without one ignore nothing.

    Rules meet files by an equal join, so a root that holds most files can be split. Expressions are compiled when they
    change from one row to the next, so rows of a root stand together."""
    own = compiled(rules, root, text).withColumnRenamed("root", "__root")
    both = files.join(own, F.col(root) == F.col("__root"), "left").sortWithinPartitions(root)
    named = _ignored(F.col(relative), lambda p: F.regexp_instr(p, F.col("for_directories")) > 0, lambda p: F.regexp_instr(p, F.col("for_files")) > 0)
    return both.withColumn("ignored", F.coalesce(named, F.lit(False))).select(*[F.col(c) for c in files.columns], "ignored")
