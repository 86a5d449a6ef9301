"""Change events: coalesced, and applied to the stored tables in micro-batches.

events(seq, ts, root, path, kind). The truth is always read again from the current scan, so events only say where to look; late
or repeated ones do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from searchloom.operators import maintain

KINDS = ("Created", "Modified", "Removed", "RenamedTo", "Overflow", "Retry")
# Names of the systems' events.
NATIVE = {
    "IN_CREATE": "Created", "IN_MODIFY": "Modified", "IN_CLOSE_WRITE": "Modified", "IN_ATTRIB": "Modified", "IN_DELETE": "Removed", "IN_MOVED_FROM": "Removed",
    "IN_MOVED_TO": "RenamedTo", "IN_Q_OVERFLOW": "Overflow", "FILE_ACTION_ADDED": "Created", "FILE_ACTION_MODIFIED": "Modified", "FILE_ACTION_REMOVED": "Removed",
    "FILE_ACTION_RENAMED_OLD_NAME": "Removed", "FILE_ACTION_RENAMED_NEW_NAME": "RenamedTo",
}
# Bits of folder-event flags, in the order in which they count.
FLAGS = ((0x1 | 0x2 | 0x4, "Overflow"), (0x200, "Removed"), (0x800, "RenamedTo"), (0x100, "Created"))
_ITEMS = 0x10000 | 0x20000


def flag_kind(flags: Column) -> Column:
    """A folder event's flags as a kind: dropped or coalesced events are an overflow, what concerns neither file nor folder is null."""
    has = lambda bits: flags.bitwiseAND(F.lit(bits)) != 0
    out = F.when(has(FLAGS[0][0]), FLAGS[0][1]).when(~has(_ITEMS), F.lit(None))
    for bits, kind in FLAGS[1:]:
        out = out.when(has(bits), kind)
    return out.otherwise("Modified")


def native_kind(name: Column) -> Column:
    """A system's event name as a kind; null if it is none of ours."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in NATIVE.items() for x in kv]), name)


def latest(events: DataFrame, *more: str) -> DataFrame:
    """The last kind for each (root, path), and how many events it stands for."""
    return events.groupBy(*more, "root", "path").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"), F.count("*").alias("n"))


def sessions(events: DataFrame, quiet: str = "500 milliseconds") -> DataFrame:
    """Each event with its session's start: any event keeps the one timer running, whichever its root.

    Only the distinct seconds (or finer instants) of events are ordered globally, hour by hour in parallel; an hour's first gap is
    measured against the hour before that has events.
    """
    instants = events.select("ts").distinct().withColumn("hour", F.date_trunc("hour", "ts"))
    ends = instants.groupBy("hour").agg(F.max("ts").alias("end"))
    before = ends.withColumn("before", F.lag("end").over(Window.orderBy("hour"))).drop("end")
    w = Window.partitionBy("hour").orderBy("ts")
    marked = instants.join(before, "hour").withColumn("last", F.coalesce(F.lag("ts").over(w), "before"))
    opens = F.col("last").isNull() | (F.col("ts") > F.col("last") + F.expr(f"interval {quiet}"))
    starts = marked.withColumn("start", F.when(opens, F.col("ts")))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    within = starts.withColumn("own", F.last("start", ignorenulls=True).over(upto))
    heads = starts.groupBy("hour").agg(F.max("start").alias("head"))
    carried = heads.withColumn("carried", F.last("head", ignorenulls=True).over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))).drop("head")
    return events.join(within.join(carried, "hour").select("ts", F.coalesce("own", "carried").alias("session")), "ts")


def coalesced(events: DataFrame, quiet: str = "500 milliseconds") -> DataFrame:
    """(session, root, path, kind, n): what is handed on when a session's timer runs out."""
    return latest(sessions(events, quiet), "session").drop("seq")


def apply_batch(files: DataFrame, batch: DataFrame, scan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files after, files to be extracted again, roots to be reconciled).

    By the current scan(root, path, ..., is_dir): what is gone goes with all below it; a folder that was created or renamed to brings
    its files; a file counts if its size or time changed, or it is retried; an overflow asks for its root as a whole.
    """
    now = latest(batch)
    rescan = now.where("kind = 'Overflow'").select("root").distinct()
    now = now.where("kind <> 'Overflow'")
    on_disk = scan.select("root", "path", "is_dir")
    seen = now.join(on_disk, ["root", "path"], "left")
    gone = seen.where("is_dir is null").select("root", F.col("path").alias("folder"))
    lost = maintain.within(files.select("root", "path"), gone)
    folders = seen.where("is_dir and kind in ('Created', 'RenamedTo')").select("root", F.col("path").alias("folder"))
    found = scan.where("not is_dir")
    under = maintain.within(found.select("root", "path"), folders)
    named = seen.where("not is_dir").select("root", "path", (F.col("kind") == "Retry").alias("forced"))
    todo = found.join(named.unionByName(under.withColumn("forced", F.lit(False))).groupBy("root", "path").agg(F.max("forced").alias("forced")), ["root", "path"])
    old = files.select("root", "path", F.col("size").alias("s0"), F.col("modified_time").alias("m0"))
    fresh = todo.join(old, ["root", "path"], "left").where(F.col("forced") | F.col("s0").isNull() | (F.col("s0") != F.col("size")) | (F.col("m0") != F.col("modified_time")))
    fresh = fresh.select(*files.columns)
    return maintain.upsert(maintain.remove(files, lost), fresh), fresh, rescan


def follow(events: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], every: str = "500 milliseconds") -> StreamingQuery:
    """Streams events into `apply`, one call for each micro-batch of the latest kinds; a restart repeats an unfinished batch."""

    def each(batch: DataFrame, number: int) -> None:
        apply(latest(batch), number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def windowed(events: DataFrame, quiet: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The streaming form by path: sessions of each (root, path), closed once the watermark has passed. Final states agree with the one timer's."""
    kept = events.withWatermark("ts", late)
    return kept.groupBy(F.session_window("ts", quiet), "root", "path").agg(F.max_by("kind", "seq").alias("kind"), F.count("*").alias("n"))

