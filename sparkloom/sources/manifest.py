"""The list of graphs, kept so that several writers can change it at once, and graphs loaded by name.

Each change is a new version: a file of its own, named by number, that holds the whole list (a line for each graph; graphs are
few). A writer reads the newest version, works out the next, writes it aside, and gives it its name only if no one else has
taken that: who comes second finds it there, reads it, and tries again on top of it. No entry is lost, and readers always see a
whole list.

To name a file that doesn't exist yet is one step in HDFS and the like (a rename fails where its target exists), and on a
local disk by a link. Stores whose rename replaces the target can't tell two writers apart; keep the list elsewhere there.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

ATTEMPTS = 100
TABLES = ("neurons", "synapses", "insights", "meta")


class Contended(RuntimeError):
    """Others kept changing the list."""


@dataclass(frozen=True)
class Entry:
    """A graph: its name, what it is called, where its tables are, and how large it is."""

    name: str
    label: str
    path: str
    count: int = 0
    synapses: int = 0


class Manifest:
    """The list in the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/manifest"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, version: int):
        return self._path(f"{self.root}/v{version:012d}.json")

    def version(self) -> int:
        """The newest version, 0 where there is none."""
        found = self._store.globStatus(self._path(f"{self.root}/v*.json"))
        return max((int(f.getPath().getName()[1:-5]) for f in found or ()), default=0)

    def _read(self, version: int) -> dict[str, Entry]:
        if not version:
            return {}
        stream = self._store.open(self._file(version))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {e["name"]: Entry(**e) for e in map(json.loads, text.splitlines()) if e}

    def _create(self, version: int, entries: dict[str, Entry]) -> bool:
        """Writes a version if it isn't there yet."""
        body = "\n".join(json.dumps(asdict(e), sort_keys=True) for e in entries.values()) or "null"
        aside, target = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._file(version)
        out = self._store.create(aside, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        try:
            if self._store.getUri().getScheme() != "file":
                return not self._store.exists(target) and self._store.rename(aside, target)
            os.link(aside.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            self._store.delete(aside, False)

    def entries(self, version: int | None = None) -> list[Entry]:
        """The graphs by name, as of the newest version or another."""
        found = self._read(self.version() if version is None else version)
        return [found[k] for k in sorted(found)]

    def change(self, how: Callable[[dict[str, Entry]], dict[str, Entry]]) -> int:
        """Applies ``how`` to the newest list, again if others came first; the version that it became."""
        for _ in range(ATTEMPTS):
            now = self.version()
            if self._create(now + 1, how(dict(self._read(now)))):
                return now + 1
        raise Contended(f"no change went through in {ATTEMPTS} attempts")

    def put(self, *entries: Entry) -> int:
        """Adds graphs, in place of those of the same name."""
        return self.change(lambda held: held | {e.name: e for e in entries})

    def remove(self, *names: str) -> int:
        return self.change(lambda held: {k: e for k, e in held.items() if k not in names})

    def find(self, name: str | None = None, default: str | None = None) -> Entry:
        """The graph ``name``; without a name the default, or the only one there is."""
        held = {e.name: e for e in self.entries()}
        wanted = name or default or (next(iter(held)) if len(held) == 1 else None)
        if wanted not in held:
            raise LookupError(f"no graph {wanted!r}; there are {sorted(held)}")
        return held[wanted]

    def load(self, name: str | None = None, default: str | None = None) -> dict[str, DataFrame]:
        """The tables of a graph that ``sinks.write_graph`` has written."""
        at = self.find(name, default).path
        return {t: self.spark.read.parquet(f"{at}/{t}") for t in TABLES}
