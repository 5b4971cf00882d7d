"""Vocabularies on the driver's disk, one folder a repository. Nothing is fetched unless asked to."""

from __future__ import annotations

import os
import threading
import urllib.request
from collections.abc import Callable

from ..operators.tokenizers import ENCODINGS, KIMI, RankVocabulary, TokenizerFile, parse_rank_file
from ..plans.registry import Model

#: A vocabulary beyond this is refused.
MAX_VOCABULARY_BYTES = 64 << 20
TIMEOUT_SECONDS = 120


def fetch_url(url: str) -> bytes | None:
    """The body, or None where there is none; what is gated or too large raises."""
    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT_SECONDS) as answer:
            if int(answer.headers.get("Content-Length") or 0) > MAX_VOCABULARY_BYTES:
                raise ValueError(f"{url} is larger than {MAX_VOCABULARY_BYTES} bytes")
            body = answer.read(MAX_VOCABULARY_BYTES + 1)
    except urllib.error.HTTPError as e:
        if e.code in (401, 403):
            raise PermissionError(f"{url} is gated: accept its terms and load the file by hand") from e
        if e.code == 404:
            return None
        raise
    if len(body) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{url} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return body


class VocabularyStore:
    """Loads, keeps and clears vocabularies. What is unavailable is remembered until asked for again."""

    def __init__(self, folder: str, fetch: Callable[[str], bytes | None] | None = None, base_url: str = "https://huggingface.co"):
        self.folder, self.fetch, self.base_url = folder, fetch, base_url
        self.lock, self.loaded, self.missing, self.generation = threading.Lock(), {}, set(), 0
        #: One lock for each repository that is being fetched: callers that come meanwhile wait for it.
        self.fetching: dict[str, threading.Lock] = {}

    def path(self, model: Model) -> str | None:
        name = {"hf": "tokenizer.json", "tiktokenModel": "tiktoken.model"}.get(model.kind)
        return os.path.join(self.folder, model.repo.replace("/", "--").replace("\\", "--"), name) if name else None

    def is_downloaded(self, model: Model) -> bool:
        return bool((p := self.path(model)) and os.path.isfile(p))

    def load(self, model: Model) -> RankVocabulary | TokenizerFile | None:
        """None where there is no file, or none that can be read: counts are then estimates. Encodings
        without a repository are read from a rank file of their name in the folder, if their split is known."""
        key = model.repo or model.encoding
        if key is None or (model.repo is None and model.encoding not in ENCODINGS):
            return None
        with self.lock:
            if key in self.loaded:
                return self.loaded[key]
            if key in self.missing:
                return None
            path = self.path(model) or os.path.join(self.folder, f"{model.encoding}.tiktoken")
            try:
                if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
                    raise ValueError("too large")
                with open(path, encoding="utf-8") as f:
                    text = f.read()
                made = TokenizerFile(text) if model.kind == "hf" else RankVocabulary(parse_rank_file(text), ENCODINGS.get(model.encoding, KIMI))
            except (OSError, ValueError, KeyError):
                self.missing.add(key)
                return None
            self.loaded[key] = made
            return made

    def ensure(self, model: Model) -> bool:
        """Load the model's vocabulary, fetching it first if the store may; whether counts are exact."""
        key = model.repo or model.encoding
        if key is None:
            return False
        with self.lock:
            self.missing.discard(key)
            generation = self.generation
            own = self.fetching.setdefault(key, threading.Lock())
        path = self.path(model)
        with own:
            if path and not os.path.isfile(path) and self.fetch:
                names = [os.path.basename(path), *(["tokenizer_config.json"] if model.kind == "hf" else [])]
                bodies = [self.fetch(f"{self.base_url}/{model.repo}/resolve/main/{n}") for n in names]
                with self.lock:
                    if bodies[0] is not None and generation == self.generation:  # not cleared meanwhile
                        for n, body in zip(names, bodies, strict=True):
                            if body is not None:  # the configuration is optional
                                write_atomically(os.path.join(os.path.dirname(path), n), body)
        return self.load(model) is not None

    def clear(self) -> None:
        with self.lock:
            self.generation += 1
            self.loaded.clear(), self.missing.clear()
            for directory, _, names in os.walk(self.folder, topdown=False):
                for n in names:
                    os.remove(os.path.join(directory, n))
                if directory != self.folder:
                    os.rmdir(directory)

    def size(self) -> int:
        """Bytes of all files one folder deep."""
        total = 0
        for entry in os.scandir(self.folder) if os.path.isdir(self.folder) else ():
            if entry.is_dir():
                total += sum(f.stat().st_size for f in os.scandir(entry.path) if f.is_file())
        return total


def write_atomically(path: str, body: bytes) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.part"
    try:
        with open(part, "wb") as f:
            f.write(body)
        os.replace(part, path)
    except OSError:
        if os.path.exists(part):
            os.remove(part)
        raise
