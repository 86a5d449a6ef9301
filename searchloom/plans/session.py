"""Searches as you type: the latest query wins, and excerpts come for visible rows only."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession

from searchloom.operators import snippet
from searchloom.plans import search
from searchloom.plans.query import SearchQuery, parse


class LatestSearch:
    """Runs one search at a time; a newer one cancels the jobs of the one before, and a result that came too late is dropped."""

    def __init__(self, spark: SparkSession, docs: DataFrame, debounce: float = 0.25):
        self.spark, self.docs, self.debounce = spark, docs, debounce
        self.lock, self.turn, self.group, self.timer = threading.Lock(), 0, None, None

    def submit(self, query: SearchQuery, deliver: Callable[[SearchQuery, list[Row]], None]) -> None:
        """Starts after a moment without newer queries; `deliver` gets the rows of one page in another thread, so a limit is needed."""
        if query.limit is None:
            raise ValueError("a search for display needs a limit")
        with self.lock:
            self.turn += 1
            turn = self.turn
            if self.timer:
                self.timer.cancel()
            self.timer = threading.Timer(self.debounce, lambda: InheritableThread(target=self._run, args=(turn, query, deliver)).start())
            self.timer.start()

    def _run(self, turn: int, query: SearchQuery, deliver) -> None:
        sc = self.spark.sparkContext
        with self.lock:
            if turn != self.turn:
                return
            if self.group:
                sc.cancelJobGroup(self.group)
            self.group = group = f"search-{uuid.uuid4().hex}"
        sc.setJobGroup(group, query.pattern, interruptOnCancel=True)
        try:
            rows = search.search(self.docs, query).collect()
        except Exception:
            if turn == self.turn:
                raise
            return  # cancelled for a newer one
        if turn == self.turn:
            deliver(query, rows)

    def cancel(self) -> None:
        with self.lock:
            self.turn += 1
            if self.group:
                self.spark.sparkContext.cancelJobGroup(self.group)

    def excerpts(self, query: SearchQuery, visible: DataFrame) -> DataFrame:
        """Excerpts of visible rows (root, path), whatever the size of the result."""
        wanted = search._phrases(query, parse(query.pattern))[0]
        page = visible.select("root", "path").join(self.docs.select("root", "path", "content"), ["root", "path"])
        return snippet.add(page, wanted, query.exact_words)
