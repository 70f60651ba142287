"""The registry of analysed repositories: one small file with one writer at a time."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

from ..functions.distance import suggest
from . import remote


@dataclass
class Entry:
    """A repository; ``embedding`` says how far its vectors are."""

    name: str
    path: str
    hash: str
    indexed_at: str = ""
    nodes: int = 0
    edges: int = 0
    url: str = ""
    version: str = ""
    linked: list[str] = field(default_factory=list)
    embedding: dict = field(default_factory=dict)


class Registry:
    """Entries by hash in ``folder``; each change reloads under a lock and replaces the file.

    The folder is the driver's own: it lists repositories, not their data.
    """

    def __init__(self, folder: str) -> None:
        self.file = Path(folder) / "registry.json"
        self.file.parent.mkdir(parents=True, exist_ok=True)
        self.entries: dict[str, Entry] = {}
        self._load()

    def _load(self) -> None:
        self.entries = {k: Entry(**v) for k, v in json.loads(self.file.read_text()).items()} if self.file.exists() else {}

    @contextlib.contextmanager
    def _change(self) -> Iterator[None]:
        with open(f"{self.file}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            self._load()
            yield
            fresh = self.file.with_suffix(".new")
            fresh.write_text(json.dumps({k: asdict(v) for k, v in sorted(self.entries.items())}, indent=1))
            os.replace(fresh, self.file)

    @staticmethod
    def _short(name: str) -> str:
        return name.rsplit("/", 1)[-1]

    def get(self, key: str) -> Entry | None:
        """By hash, then name, then the name's last part; the smallest hash of several."""
        for test in (lambda e: e.hash == key, lambda e: e.name == key, lambda e: self._short(e.name) == key):
            found = sorted((e for e in self.entries.values() if test(e)), key=lambda e: e.hash)
            if found:
                return found[0]
        return None

    def resolve(self, key: str) -> Entry:
        """The one entry of a hash, a prefix of four or more of it, a name or its last part.

        LookupError if there is none, with a near name, or several.
        """
        if key in self.entries:
            return self.entries[key]
        tests = [lambda e: len(key) >= 4 and e.hash.startswith(key), lambda e: e.name == key, lambda e: self._short(e.name) == key]
        for test in tests:
            found = [e for e in self.entries.values() if test(e)]
            if len(found) == 1:
                return found[0]
            if found:
                raise LookupError(f"{key!r} is ambiguous: {', '.join(sorted(f'{e.name} ({e.hash})' for e in found))}")
        near = suggest(key, [e.name for e in self.entries.values()])
        raise LookupError(f"repo {key!r} not found in registry" + (f"; did you mean {near!r}?" if near else ""))

    def list(self) -> list[Entry]:
        return sorted(self.entries.values(), key=lambda e: (e.name, e.hash))

    def add(self, entry: Entry) -> None:
        """Add or replace; an entry that was there keeps its embedding's state."""
        with self._change():
            old = self.entries.get(entry.hash)
            if old and not entry.embedding:
                entry.embedding = old.embedding
            self.entries[entry.hash] = entry

    def remove(self, key: str) -> None:
        """Remove an entry and the links to it; nothing if it isn't there."""
        with self._change():
            found = self.get(key)
            if found:
                del self.entries[found.hash]
                for e in self.entries.values():
                    e.linked = [h for h in e.linked if h != found.hash]

    def _two(self, a: str, b: str) -> tuple[Entry, Entry]:
        found = [self.get(x) for x in (a, b)]
        for x, e in zip((a, b), found):
            if e is None:
                raise LookupError(f"repo {x!r} not found in registry")
        if found[0].hash == found[1].hash:
            raise ValueError("a repository can't be linked to itself")
        return found[0], found[1]

    def link(self, a: str, b: str) -> None:
        with self._change():
            x, y = self._two(a, b)
            x.linked = sorted({*x.linked, y.hash})
            y.linked = sorted({*y.linked, x.hash})

    def unlink(self, a: str, b: str) -> None:
        with self._change():
            x, y = self._two(a, b)
            x.linked = [h for h in x.linked if h != y.hash]
            y.linked = [h for h in y.linked if h != x.hash]

    def linked(self, key: str) -> list[str]:
        found = self.get(key)
        return list(found.linked) if found else []

    def update_embedding(self, key: str, **state) -> None:
        with self._change():
            self.resolve(key).embedding = {**self.resolve(key).embedding, **state}

    def clear_embedding(self, key: str) -> None:
        with self._change():
            self.resolve(key).embedding = {}

    def by_url(self, url: str) -> Entry | None:
        """The entry whose address is the same repository."""
        want = remote.parse(url).canonical
        return next((e for e in self.list() if e.url and remote.parse(e.url).canonical == want), None)

    def by_import_path(self, path: str) -> tuple[Entry, str] | None:
        """The entry whose repository begins an import path, the longest, and the rest of the path."""
        found = [(e, remote.parse(e.url).canonical) for e in self.list() if e.url]
        fit = [(e, c) for e, c in found if path == c or path.startswith(c + "/")]
        return max(((e, path[len(c) :].lstrip("/")) for e, c in fit), key=lambda x: len(path) - len(x[1]), default=None)
