"""Keeping stored tables current: upserts, removals, reconciliation, problem lists, the registry, backfill.

Tables are DataFrames keyed by (root, path); each operator gives the new table. `store` writes a table as partitions by source with
dynamic overwrite, so that a run replaces the sources it touched and nothing else, all or nothing per source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Why a file's text could not be read. They are stored and never renumbered.
PROBLEMS = {"None": 0, "CannotOpen": 1, "Damaged": 2, "Protected": 3, "TooLarge": 4, "Failed": 5, "ImagesOnly": 6}


def upsert(table: DataFrame, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows replace those with their keys; new ones are added."""
    keys = keys or [k for k in ("root", "path") if k in table.columns]
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def remove(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def under(path: Column, folder: str) -> Column:
    r"""Whether a path lies below a folder, by / or \; trailing separators of the folder don't count. Siblings with its name as a prefix don't."""
    base = folder[:1] + folder[1:].rstrip("/\\")
    return path.startswith(base + "/") | path.startswith(base + "\\")


def remove_under(table: DataFrame, folder: str) -> DataFrame:
    """Without everything below a folder."""
    return table.where(~under(F.col("path"), folder))


def record_problems(problems: DataFrame, rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Insert or replace problem rows(path, size, modified_time, problem, detail), seen now."""
    now = F.unix_timestamp(F.current_timestamp()) if now is None else now
    return upsert(problems, rows.withColumn("seen_at", now), ["path"])


def registry_upsert(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(root, db_path) change where a source is stored; a known source keeps its last_full_scan."""
    old = sources.select("root", F.col("last_full_scan").alias("old"))
    return remove(sources, rows.select("root")).unionByName(rows.join(old, "root", "left").select("root", "db_path", F.coalesce("old", *(["last_full_scan"] if "last_full_scan" in rows.columns else []), F.lit(0)).cast("long").alias("last_full_scan")))


def registry_touch(sources: DataFrame, root: str, when: int) -> DataFrame:
    return sources.withColumn("last_full_scan", F.when(F.col("root") == root, F.lit(when)).otherwise(F.col("last_full_scan")).cast("long"))


def reconcile(files: DataFrame, scan: DataFrame, unreadable: DataFrame | None = None, unavailable: DataFrame | None = None) -> DataFrame:
    """(root, path, action): index new and changed files, remove vanished ones, keep the rest.

    A file is unchanged if size and modified_time agree. Nothing vanishes from an unavailable root, or inside a folder that could not be
    read (unreadable: root, folder). One full join on the key; the folders are few and meet the vanished rows only.
    """
    old, new = files.select("root", "path", F.col("size").alias("s0"), F.col("modified_time").alias("m0")), scan.select("root", "path", F.col("size").alias("s1"), F.col("modified_time").alias("m1"))
    both = old.join(new, ["root", "path"], "full")
    action = F.when(F.col("s0").isNull(), "new").when(F.col("s1").isNull(), "vanished").when((F.col("s0") == F.col("s1")) & (F.col("m0") == F.col("m1")), "unchanged").otherwise("changed")
    out = both.select("root", "path", action.alias("action"))
    shielded = F.lit(False)
    if unreadable is not None:
        folders = unreadable.select("root", "folder")
        safe = within(out.where("action = 'vanished'").select("root", "path"), folders).withColumn("shielded", F.lit(True))
        out = out.join(safe, ["root", "path"], "left")
        shielded = F.coalesce("shielded", F.lit(False))
    if unavailable is not None:
        out = out.join(unavailable.select("root").distinct().withColumn("offline", F.lit(True)), "root", "left")
        shielded = shielded | F.coalesce("offline", F.lit(False))
    return out.select("root", "path", F.when((F.col("action") == "vanished") & shielded, "kept").when(F.col("action") == "vanished", "remove").otherwise(F.col("action")).alias("action"))


def within(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """Of paths(root, path), those that are one of folders(root, folder) or lie below one.

    A path is looked up only at the lengths that folders of a change have, a few small numbers, so the join is by equality and most
    paths aren't repeated at all.
    """
    lengths = [r[0] for r in folders.select(F.length("folder").alias("n")).distinct().orderBy("n").collect()]
    path = F.col("path")
    heads = [F.when((F.length(path) == n) | F.substring(path, n + 1, 1).isin("/", "\\"), F.substring(path, 1, n)) for n in lengths]
    if not heads:
        return paths.select("root", "path").where("false")
    cut = paths.select("root", "path", F.explode(F.array_compact(F.array(*heads))).alias("folder"))
    return cut.join(folders, ["root", "folder"], "left_semi").select("root", "path").distinct()


def retry_outcome(retried: DataFrame, problems: DataFrame, started: int | Column) -> DataFrame:
    """retried(path) -> (path, outcome): fixed if no longer listed, waiting if not seen since the start, else failing."""
    began = F.lit(started) if isinstance(started, int) else started
    listed = problems.select("path", "seen_at")
    return retried.join(listed, "path", "left").select("path", F.when(F.col("seen_at").isNull(), "fixed").when(F.col("seen_at") < began, "waiting").otherwise("failing").alias("outcome"))


def problems_by_reason(problems: DataFrame) -> DataFrame:
    """(problem, n), and all of them in the row of problem null."""
    return problems.where("problem <> 0").rollup("problem").agg(F.count("*").alias("n"))


def longest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths(path) -> (path, root): the longest root that the path begins with, by characters.

    Roots are joined by equality on prefixes of the lengths that roots have, so the plan has no nested loop.
    """
    lengths = [r[0] for r in roots.select(F.length("root").alias("n")).distinct().orderBy("n").collect()]
    heads = paths.select("path", F.explode(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")).alias("root"))
    found = heads.where("root is not null").join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(found, "path", "left").select("path", "root")


def backfill_batch(docs: DataFrame, done: int, until: int, rows: int) -> DataFrame:
    """The next at most `rows` documents of ids in (done, until], in id order."""
    return docs.where((F.col("id") > done) & (F.col("id") <= until)).orderBy("id").limit(rows)


def backfill_remaining(docs: DataFrame, done: int, until: int) -> DataFrame:
    return docs.agg(F.sum(F.when((F.col("id") > done) & (F.col("id") <= until), 1).otherwise(0)).cast("long").alias("remaining"), F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))


def store(table: DataFrame, path: str) -> None:
    """Replaces the sources that the table has rows of."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root").parquet(path)


def run_index(files: DataFrame, scan: DataFrame, extract: Callable[[DataFrame], DataFrame], full: bool = False, threshold: int = 20 * 1024 * 1024, unreadable: DataFrame | None = None, unavailable: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files after the run, extracted rows of what was written). A full run rewrites every file found and removes none; else as reconcile says.

    Heavy files are extracted by tasks of their own, so that one of them holds up no other.
    """
    from searchloom.functions.files import heavy

    todo, after = scan, None
    if not full:
        plan = reconcile(files, scan, unreadable, unavailable)
        todo = scan.join(plan.where("action in ('new', 'changed')"), ["root", "path"], "left_semi")
        # the action of every known path decides whether its old row stays, in the same shuffle for both uses of the plan
        after = files.join(plan.where("action in ('unchanged', 'kept')").select("root", "path"), ["root", "path"], "left_semi").unionByName(todo.select(*files.columns))
    big = heavy(F.col("ext"), F.col("size"), threshold)
    written = extract(todo.where(~big)).unionByName(extract(todo.where(big).repartition("path")))
    return (upsert(files, todo.select(*files.columns)) if full else after), written


def problem_files(problems: DataFrame) -> DataFrame:
    """The listed files by path, for display."""
    return problems.orderBy("path")


def registry_sources(sources: DataFrame) -> DataFrame:
    """All sources by root."""
    return sources.orderBy("root")

