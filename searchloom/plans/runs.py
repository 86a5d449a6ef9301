"""Index runs: every known source reconciled in turn, its stored index brought up to date, with pause, resume and cancel.

A run is a loop over sources and over their few batches; rows stay in DataFrames. Each batch is one generation of the index, complete or
not there at all, so a run that is cancelled or fails keeps what it had committed and the next one goes on from there. Ordinary files
come first; heavy files follow, a task for each, so that none holds up the others. Files that vanished go only at the end of a source
that was gone through completely and is available.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions.files import heavy
from searchloom.operators import maintain
from searchloom.operators.index import StoredIndex
from searchloom.streaming import changes

HEAVY = 20 * 1024 * 1024
FILES = "root string, path string, name string, ext string, size long, modified_time long"


@dataclass
class Status:
    phase: str = "idle"  # idle, indexing, heavy, paused, done, cancelled
    sources_done: int = 0
    sources_total: int = 0
    current: str = ""
    written: int = 0
    removed: int = 0
    failed: int = 0
    seconds: dict = field(default_factory=dict)


class Runner:
    """Runs over sources. `scan(root)` gives the files found (None if the source is unavailable) and unreadable folders(root, folder);
    `extract(files)` adds content, problem and detail."""

    def __init__(self, spark: SparkSession, index: StoredIndex, scan: Callable[[str], tuple[DataFrame | None, DataFrame | None]], extract: Callable[[DataFrame], DataFrame], threshold: int = HEAVY):
        self.spark, self.index, self.scan, self.extract, self.threshold = spark, index, scan, extract, threshold
        self.files, self._version, self._oldest = spark.createDataFrame([], FILES), 0, 0
        self.status, self._go, self._stop = Status(), threading.Event(), threading.Event()
        self._rescan, self._lock = set(), threading.Lock()
        self._go.set()

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def cancel(self) -> None:
        """Ends the run after the batch that is being written; a paused run ends at once."""
        self._stop.set()
        self._go.set()

    def _keep(self, files: DataFrame) -> None:
        """The files table as it is now, written beside the index, so that plans don't grow from source to source."""
        at = lambda v: f"{self.index.path}/files/v={v}"
        self._version += 1
        self.index._delete(at(self._version))
        files.write.parquet(at(self._version))
        self.files = self.spark.read.schema(FILES).parquet(at(self._version))

    def _tidy(self) -> None:
        """Deletes the versions before the one in use, once no plan reads them any more."""
        for v in range(self._oldest, self._version):
            self.index._delete(f"{self.index.path}/files/v={v}")
        self._oldest = self._version

    def _may_go_on(self) -> bool:
        if not self._go.is_set():
            before, self.status.phase = self.status.phase, "paused"
            self._go.wait()
            self.status.phase = before
        return not self._stop.is_set()

    def _commit(self, todo: DataFrame, gone: DataFrame | None = None) -> None:
        """Extracts files and writes them, with what is gone, as one generation; the texts are read once."""
        began = time.time()
        rows = self.extract(todo)
        self.index.upsert(rows.where("problem = 0 or content <> ''"), gone)
        self.status.seconds["write"] = self.status.seconds.get("write", 0.0) + time.time() - began

    def run(self, sources: DataFrame, full: bool = False, now: int | None = None) -> DataFrame:
        """Runs over sources(root, db_path, last_full_scan) in the order of roots; the registry after it."""
        roots = [r["root"] for r in sources.select("root").orderBy("root").collect()]
        self._stop.clear()
        self.status = Status("indexing", sources_total=len(roots))
        for root in roots:
            if not self._may_go_on() or not self._source(root, full):
                break
            self.status.sources_done += 1
            sources = maintain.registry_touch(sources, root, int(time.time()) if now is None else now)
        self.status.phase = "cancelled" if self._stop.is_set() else "done"
        while not self._stop.is_set() and (again := self._take_rescans()):
            for root in again:
                self._source(root, False)
        return sources

    def _take_rescans(self) -> list[str]:
        with self._lock:
            again, self._rescan = sorted(self._rescan), set()
        return again

    def _source(self, root: str, full: bool) -> bool:
        self.status.current = root
        found, unreadable = self.scan(root)
        known = self.files.where(F.col("root") == root)
        if found is None:  # what is offline stays as it was
            return True
        found = found.select(*self.files.columns)
        plan = found.select("root", "path", F.lit("changed").alias("action")) if full else maintain.reconcile(known, found, unreadable)
        todo = found.join(plan.where("action in ('new', 'changed')"), ["root", "path"], "left_semi")
        big = heavy(F.col("ext"), F.col("size"), self.threshold)
        for phase, part in (("indexing", todo.where(~big)), ("heavy", todo.where(big))):
            n = part.count()
            if not n:
                continue
            self.status.phase = phase
            if not self._may_go_on():
                return False
            self._commit(part.repartition(min(n, 10_000), "path") if phase == "heavy" else part)
            self.status.written += n
            self._keep(maintain.upsert(self.files, part))
        self.status.phase = "indexing"
        if not full and self._may_go_on():
            gone = plan.where("action = 'remove'").select("root", "path")
            n = gone.count()
            if n:
                self.index.remove(gone)
                self._keep(maintain.remove(self.files, gone))
                self.status.removed += n
        self._tidy()
        return not self._stop.is_set()

    def apply(self, batch: DataFrame, scan: DataFrame, running: bool = False) -> None:
        """Applies change events(seq, ts, root, path, kind) by the current scan(.., is_dir). Roots of an overflow are reconciled now, or, while a
        run is on, once after it, however many overflows there were."""
        after, fresh, rescan = changes.apply_batch(self.files, batch, scan)
        gone = maintain.remove(self.files.select("root", "path"), after.select("root", "path"))
        self.index.upsert(self.extract(fresh).where("problem = 0 or content <> ''"), gone)
        self._keep(after)
        self._tidy()
        with self._lock:
            self._rescan |= {r["root"] for r in rescan.collect()}
        if not running:
            for root in self._take_rescans():
                self._source(root, False)
