"""Figures of a run: shares of its stages, rates, remaining time, where it is held up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

STAGES = ("read", "parse", "write", "walk")


def stage_shares(timings: DataFrame) -> DataFrame:
    """timings(root, read, parse, write, walk seconds) -> + total, share of each in percent, the largest stage.

    Where the table has them, seconds of counting belong to walk, those of saving to write, and those of upgrading to the total only.
    """
    for part, stage in (("counting", "walk"), ("saving", "write")):
        if part in timings.columns:
            timings = timings.withColumn(stage, F.col(stage) + F.coalesce(part, F.lit(0.0)))
    total = sum((F.col(s) for s in STAGES), F.lit(0.0))
    if "upgrading" in timings.columns:
        total = total + F.coalesce("upgrading", F.lit(0.0))
    out = timings.withColumn("total", total)
    for s in STAGES:
        out = out.withColumn(f"{s}_pct", F.when(F.col("total") > 0, 100.0 * F.col(s) / F.col("total")).otherwise(0.0))
    top = F.array_max(F.array(*[F.struct(F.col(s).alias("v"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(STAGES)]))
    return out.withColumn("dominant", top["s"])


def advice(timings: DataFrame, least: float = 3.0, even: float = 0.4) -> DataFrame:
    """(root, advice): none under `least` seconds, even if no stage has `even` of the time, else the largest stage."""
    s = stage_shares(timings)
    return s.select("root", F.when(F.col("total") < least, "none").when(F.greatest(*[F.col(x) for x in STAGES]) / F.col("total") < even, "even").otherwise(F.col("dominant")).alias("advice"))


def ewma(samples: DataFrame, keep: float = 0.7) -> DataFrame:
    """samples(root, ts, rate) -> (root, rate, mean): each new sample counts 1 - keep, the first one seeds."""
    newest = Window.partitionBy("root").orderBy(F.desc("ts"))
    placed = samples.select("root", F.col("rate").cast("double").alias("rate"), F.row_number().over(newest).alias("age"), F.lead(F.lit(1)).over(newest).isNull().alias("first"))
    weight = F.pow(F.lit(keep), F.col("age") - 1) * F.when(F.col("first"), 1.0).otherwise(1 - keep)
    return placed.groupBy("root").agg(F.sum(weight * F.col("rate")).alias("rate"), F.avg("rate").alias("mean"))


def progress(runs: DataFrame) -> DataFrame:
    """runs(root, visited, total, rate, finished_at) -> one row: visited, total, per mille, longest remaining time, last finished source."""
    return runs.agg(
        F.sum("visited").alias("visited"), F.sum("total").alias("total"),
        F.when(F.sum("total") > 0, F.floor(1000 * F.sum("visited") / F.sum("total"))).otherwise(0).cast("long").alias("permille"),
        F.max(remaining(F.col("visited"), F.col("total"), F.col("rate"))).alias("eta"), F.max_by("root", F.struct("finished_at", "root")).alias("last_finished"),
    )


def remaining(visited: Column, total: Column, rate: Column) -> Column:
    """Seconds left at this rate; null while there is none."""
    return F.when(rate > 0, F.greatest(F.lit(0.0), (total - visited) / rate))


def files_left(total: Column, visited: Column, heavy_found: Column, heavy_done: Column, rate: Column) -> Column:
    """Seconds left of the ordinary files, which alone move at this rate; null below one file a second."""
    heavy = F.greatest(heavy_found - heavy_done, F.lit(0))
    return F.when(rate >= 1, F.greatest(F.greatest(total - visited, F.lit(0)) - heavy, F.lit(0)) / rate)


def heavy_left(work_total: Column, work_done: Column, active_seconds: Column, current_work: Column, current_seconds: Column) -> Column:
    """Seconds left of heavy files by the bytes a second so far; the current file's share counts down but not below nothing."""
    speed = work_done / active_seconds
    rest = F.greatest(work_total - work_done, F.lit(0))
    passed = F.least(current_seconds, F.least(current_work, rest) / speed)
    return F.when((active_seconds > 0) & (work_done > 0), F.greatest(F.lit(0.0), rest / speed - passed))


def observed(rows: DataFrame, observation: Observation) -> DataFrame:
    """The same rows; once they are computed, observation.get has files, failed and bytes of text, at no pass of their own."""
    return rows.observe(observation, F.count("*").alias("files"), F.sum((F.col("problem") != 0).cast("long")).alias("failed"), F.sum(F.octet_length("content")).alias("text_bytes"))
