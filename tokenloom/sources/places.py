"""Where files are: folders of this machine, or any storage that pyarrow opens, by the scheme of the path.

A plain path and ``file://`` are local. Other schemes are opened by ``schemes`` (a function for each that gives a
``pyarrow.fs.FileSystem``), else by pyarrow itself (s3, gs, hdfs and the like). Executors do the same for
themselves: what they get is the path and these functions.
"""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import stat
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

from pyarrow import fs

Schemes = dict[str, Callable[[], fs.FileSystem]]


class Entry(NamedTuple):
    """``kind``: directory, file, unreadable (its size cannot be told) or other. ``link``: by a symbolic link."""

    name: str
    kind: str
    size: int | None
    mtime: int | None
    link: bool


class Local:
    """This machine's folders, with symbolic links."""

    def entries(self, directory: str) -> Iterator[Entry]:
        """What is in a directory, in no order; nothing if it cannot be read."""
        try:
            scan = os.scandir(directory)
        except OSError:
            return
        with scan:
            for e in scan:
                link = e.is_symlink()
                try:
                    if e.is_dir():
                        yield Entry(e.name, "directory", None, None, link)
                        continue
                except OSError:
                    pass
                try:
                    s = e.stat()
                except OSError:
                    yield Entry(e.name, "unreadable", None, None, link)
                    continue
                yield Entry(e.name, "file" if stat.S_ISREG(s.st_mode) else "other", s.st_size, int(s.st_mtime * 1000), link)

    def look(self, path: str) -> Entry:
        name = os.path.basename(path)
        try:
            s = os.stat(path)
        except OSError:
            return Entry(name, "unreadable", None, None, False)
        if stat.S_ISDIR(s.st_mode):
            return Entry(name, "directory", None, None, False)
        return Entry(name, "file", s.st_size, int(s.st_mtime * 1000), False)

    def real(self, directory: str) -> str:
        return os.path.realpath(directory)

    def read(self, path: str, most: int) -> bytes:
        with open(path, "rb") as f:
            return f.read(most)

    def create(self, path: str) -> BinaryIO:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")

    def put(self, path: str, body: bytes) -> None:
        """A whole file in one step."""
        part = f"{path}.{uuid.uuid4().hex}.part"
        with self.create(part) as f:
            f.write(body)
        os.replace(part, path)

    def remove(self, directory: str) -> None:
        shutil.rmtree(directory, ignore_errors=True)


class Arrow:
    """A storage without links, by URI; it knows its paths without what stands in front (``scheme://``, and a host)."""

    def __init__(self, storage: fs.FileSystem, front: str):
        self.storage, self.front = storage, front

    def _inner(self, path: str) -> str:
        return path.removeprefix(self.front).rstrip("/")

    def _entry(self, x: fs.FileInfo) -> Entry:
        kind = {fs.FileType.Directory: "directory", fs.FileType.File: "file", fs.FileType.NotFound: "unreadable"}.get(x.type, "other")
        at = int(x.mtime_ns // 1_000_000) if kind == "file" and x.mtime_ns is not None else None
        return Entry(x.base_name, kind, x.size if kind == "file" else None, at, False)

    def entries(self, directory: str) -> Iterator[Entry]:
        try:
            found = self.storage.get_file_info(fs.FileSelector(self._inner(directory)))
        except OSError:
            return
        yield from map(self._entry, found)

    def look(self, path: str) -> Entry:
        try:
            return self._entry(self.storage.get_file_info(self._inner(path)))
        except OSError:
            return Entry(path.rsplit("/", 1)[-1], "unreadable", None, None, False)

    def real(self, directory: str) -> str:
        return directory

    def read(self, path: str, most: int) -> bytes:
        with self.storage.open_input_stream(self._inner(path)) as f:
            return f.read(most)

    def create(self, path: str) -> BinaryIO:
        inner = self._inner(path)
        self.storage.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return self.storage.open_output_stream(inner)

    def put(self, path: str, body: bytes) -> None:
        """A whole file in one step, as object stores write them."""
        with self.create(path) as f:
            f.write(body)

    def remove(self, directory: str) -> None:
        with contextlib.suppress(OSError):
            self.storage.delete_dir(self._inner(directory))


class Places:
    """Opens each storage once."""

    def __init__(self, schemes: Schemes | None = None):
        self.schemes, self.local = schemes or {}, Local()
        self.opened: dict[str, Arrow] = {}

    def of(self, path: str) -> tuple[Local | Arrow, str]:
        """The storage of a path, and the path as its entries are joined to it."""
        scheme = found[1] if (found := re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", path)) else "file"
        if scheme == "file":
            return self.local, path.removeprefix("file://")
        for front, storage in self.opened.items():
            if path.startswith(front):
                return storage, path
        if scheme in self.schemes:
            storage, front = self.schemes[scheme](), f"{scheme}://"
        else:
            storage, inner = fs.FileSystem.from_uri(path)
            whole = path.rstrip("/")
            front = whole.removesuffix(inner.rstrip("/"))
        self.opened[front] = Arrow(storage, front)
        return self.opened[front], path
