"""Shared pieces of the training-data operators: tables in the shared folder, words, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, for lower-casing A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space between plain words.
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, other letters as they are; `lower` decides cheaply whether there is anything to do."""
    return F.when(F.lower(c) == c, c).otherwise(F.translate(c, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark is local (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        jdir = sc._jsc.sc().getCheckpointDir()
        if jdir.isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="searchloom-"))
            jdir = sc._jsc.sc().getCheckpointDir()
        base = jdir.get()
    return base.rstrip("/")


#: Settings while a table is written: its shuffle files go with the job, and Arrow batches of long texts stay small.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def trim() -> None:
    """Gives a worker's freed memory back to the system, where that can be asked for."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    `write` returns the table read back; `drop` deletes one early; what is left goes when the driver ends,
    since results that are still lazy may read it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/searchloom-{uuid.uuid4().hex}", {}
        atexit.register(self.close)

    def write(self, df: DataFrame, **options) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in WRITING}
        for k, v in WRITING.items():
            conf.set(k, v)
        try:
            df.write.options(**options).parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self.paths.pop(id(t), (None, None))
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # noqa: BLE001 - at exit the JVM may be gone already
            pass


#: A node with more neighbours than this is dealt over many tasks, where there are so many edges; so many of such nodes at most are broadcast.
HUB, HUBS = 1_000_000, 100_000


def _told(edges: DataFrame, stars: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """edges(u, v) joined to stars(u, m), the least neighbour of u, over n edges. The few nodes with very many neighbours are broadcast, so that
    none of them is one task's work; the adaptive plan splits what is left of skew."""
    if n <= HUB:
        return edges.join(stars.select("u", "m"), "u")
    stars = scratch.write(stars)
    hubs = stars.where(F.col("n") > HUB).select("u", "m")
    if not 0 < hubs.limit(HUBS + 1).count() <= HUBS:
        return edges.join(stars.select("u", "m"), "u")
    return edges.join(F.broadcast(hubs), "u").union(edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(stars.select("u", "m"), "u"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Distributed union-find on edges (src, dst): (node, component) for every node that isn't the smallest of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each a join and a pre-aggregated minimum;
    every round is a table in the shared folder. Nodes are of one orderable type; self-loops and repeats are ignored.
    """
    e = scratch.write(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())

    def print_of(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = print_of(e)
    while seen[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = scratch.write(_told(both.where("v > u"), least, seen[0], scratch).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _told(large, low, seen[0], scratch).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        nxt = scratch.write(small.distinct())
        scratch.drop(e, large)
        e, last, seen = nxt, seen, print_of(nxt)
        if last == seen:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
