"""A streaming source of file changes: folder trees compared between micro-batches.

It asks for no support of the operating system and works on every mounted tree. A new stream (or one that restarts) begins with an
Overflow for its root, so that the index is reconciled once; from then on each batch has what changed since the last one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from searchloom.sources.filetree import _Folder, _Reader


class _Watcher(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.tree, self.seen, self.batches = _Reader(options), None, {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _now(self) -> dict[str, tuple]:
        return {r[1]: (r[4], r[6]) for r in self.tree.read(_Folder(self.tree.root, True)) if not r[7]}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now, root, n = self._now(), self.tree.root, start["n"]
        if self.seen is None:
            found = [("Overflow", root)]
        else:
            found = [("Removed", p) for p in self.seen.keys() - now.keys()] + [("Created" if p not in self.seen else "Modified", p) for p, v in now.items() if self.seen.get(p) != v]
        self.seen, when = now, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        rows = [(n + k + 1, when, root, p, kind) for k, (kind, p) in enumerate(sorted(found))]
        end = {"n": n + len(rows)}
        if rows:
            self.batches[n, end["n"]] = rows
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch again; after a restart it is unknown and the root is reconciled instead."""
        when = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        return iter(self.batches.get((start["n"], end["n"])) or [(end["n"], when, self.tree.root, self.tree.root, "Overflow")])

    def commit(self, end: dict) -> None:
        self.batches = {k: v for k, v in self.batches.items() if k[1] > end["n"]}


class FileChanges(DataSource):
    """spark.readStream.format("filechanges").option("masks", "*.tmp").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "filechanges"

    def schema(self) -> str:
        return "seq long, ts timestamp, root string, path string, kind string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Watcher(self.options)
