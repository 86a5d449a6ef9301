"""Operator 3, mixing sources to target weights: pivotal dependent rounding over a distributed reduction tree.

DataFrame and SQL functions only. Each source has a target of words; a document takes floor(r) whole copies, r = target /
source size, and one more with probability frac(r). Those probabilities are rounded dependently: in a block of documents
of one source, a carried document meets the next one, and words move at random from one to the other (so that the
expected copies stay as they are and the words they take stay exactly equal) until one of the two is integral; the other
is carried on. A block ends with one residual document at most; residuals of all blocks form the next, smaller level,
until every source has one block, which a block of plain documents that was kept back joins. What that root carries last
is rounded to the nearer side, and the words that it is off by move between the root's decided documents, largest first,
so that a source misses its target by about half a small document. All randomness is a hash of the document and a seed, so reruns agree.

Defined cases: a null text has size 0 and takes 0; null is a source of its own, last in order; rows that agree in
doc_id, source and text are one unit and share one decision; no rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, columns, unused

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Documents in a block of the reduction tree.
BLOCK = 64
#: Sources are broadcast up to this many (a few MB), and joined by shuffle beyond.
BROADCAST_SOURCES = 50_000
#: Units that are taken (a long and an int each) are broadcast to the texts up to this many and joined by shuffle beyond.
BROADCAST_UNITS = 1_000_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size) -> + target: share of all words by weight, no target above `most` times its source.

    Resharing the excess until none is above is water filling: the sources with the smallest size per weight stop at
    their limit, the others get one level times their weight. Windows run over one row per source.
    """
    order, total = Window.orderBy(F.col("source").isNull(), F.col("source")), Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("all", F.sum("source_size").over(total) * F.lit(float(share)))
    df = df.withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn("wleft", F.sum("w").over(total) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    # the first source, in this order, whose limit is above its share sets the level for itself and all after it
    df = df.withColumn("level", F.when(F.col("cap") >= F.col("left") / F.col("wleft") * F.col("w"), F.col("left") / F.col("wleft")))
    first = F.first("level", ignorenulls=True).over(Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("level", first).select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def uniform(*cols) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


_UNIT = "struct<unit:bigint,p:double,size:bigint>"


def _pivot(block: Column, seed: int) -> Column:
    """array<unit> -> struct(carry, done array<struct<unit, extra>>): one pass of pairwise transfers."""
    start = F.struct(F.lit(None).cast(_UNIT).alias("carry"), F.array().cast("array<struct<size:bigint,unit:bigint,extra:int>>").alias("done"))

    def meet(acc, x):
        a = acc["carry"]
        wa, wb = a["p"] * a["size"], x["p"] * x["size"]
        words = wa + wb
        # the two ends of the line on which a and x together keep their words
        up = F.least(a["size"].cast("double"), words)  # most words a can take
        down = F.greatest(F.lit(0.0), words - x["size"])  # least words a can take
        raise_a = uniform(a["unit"], x["unit"], F.lit(seed)) * (up - down) < (wa - down)
        na = F.when(up - down <= 0, wa).when(raise_a, up).otherwise(down)
        nb = words - na
        pa, pb = na / a["size"], nb / x["size"]
        eps = 1e-12
        a_done = (pa <= eps) | (pa >= 1 - eps)
        one = lambda u, p: F.struct(u["size"].alias("size"), u["unit"].alias("unit"), F.when(p >= 0.5, 1).otherwise(0).alias("extra"))
        carry = F.when(a_done, F.struct(x["unit"].alias("unit"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), pb)).alias("p"), x["size"].alias("size"))).otherwise(F.struct(a["unit"].alias("unit"), pa.alias("p"), a["size"].alias("size")))
        return F.when(a.isNull(), F.struct(F.struct(x["unit"].alias("unit"), x["p"].alias("p"), x["size"].alias("size")).cast(_UNIT).alias("carry"), acc["done"].alias("done"))).otherwise(
            F.struct(carry.cast(_UNIT).alias("carry"), F.concat(acc["done"], F.array(F.when(a_done, one(a, pa)).otherwise(one(x, pb)))).alias("done"))
        )

    return F.aggregate(block, start, meet)


def _settle(r: Column) -> Column:
    """The root's struct(carry, done) -> array<struct<size, unit, extra>>: the carried unit goes to its nearer side, and the
    words it is off by move to decided units of the root block, largest first, as long as that brings the source nearer."""
    last = r["carry"]
    extra = F.when(last["p"] >= 0.5, 1).otherwise(0)
    off = F.when(last.isNull(), F.lit(0.0)).otherwise((extra - last["p"]) * last["size"])
    first = F.when(last.isNull(), F.array().cast("array<struct<size:bigint,unit:bigint,extra:int>>")).otherwise(F.array(F.struct(last["size"].alias("size"), last["unit"].alias("unit"), extra.cast("int").alias("extra"))))
    start = F.struct(off.alias("off"), first.alias("done"))

    def step(acc, x):
        move = F.when(x["extra"] == 1, -x["size"]).otherwise(x["size"])
        turn = F.abs(acc["off"] + move) < F.abs(acc["off"])
        one = F.struct(x["size"].alias("size"), x["unit"].alias("unit"), F.when(turn, 1 - x["extra"]).otherwise(x["extra"]).cast("int").alias("extra"))
        return F.struct((acc["off"] + F.when(turn, move).otherwise(0)).cast("double").alias("off"), F.concat(acc["done"], F.array(one)).alias("done"))

    return F.aggregate(F.reverse(F.array_sort(r["done"])), start, step)["done"]


def round_units(units: DataFrame, scratch: Scratch, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """units(group, unit, p, size), p in (0, 1), unit unique -> (unit, extra 0 or 1), group by group."""
    done, level, kept_back, level_no = [], units, None, 0
    while True:
        counted = level.groupBy("group").agg(F.count("*").alias("n"))
        most, groups = counted.agg(F.max("n"), F.count("*")).first()
        most = most or 0
        root = most <= 2 * block
        if root:
            blocks = (level if kept_back is None else level.union(kept_back)).withColumn("b", F.lit(0).cast("long"))
        else:
            # hash order is random order: a hot group becomes many blocks of about `block` units, which don't depend on each other
            blocks = level.join(F.broadcast(counted) if groups <= BROADCAST_SOURCES else counted, "group").withColumn("b", F.pmod(F.xxhash64("unit", F.lit(seed + level_no)), F.greatest(F.lit(1), F.ceil(F.col("n") / block))))
            if kept_back is None:  # one block of each group waits for the root, where it takes up what the residuals are off by
                kept_back = scratch.write(blocks.where("b = 0").select("group", "unit", "p", "size"))
                blocks = blocks.where("b > 0")
        met = blocks.groupBy("group", "b").agg(_pivot(F.array_sort(F.collect_list(F.struct("size", "unit", "p"))), seed + level_no).alias("r"))
        if root:
            done.append(scratch.write(met.select(F.explode(_settle(F.col("r"))).alias("d"))).select("d.unit", "d.extra"))
            break
        met = scratch.write(met)
        done.append(met.select(F.explode("r.done").alias("d")).select("d.unit", "d.extra"))
        level, level_no = met.where("r.carry is not null").select("group", "r.carry.unit", "r.carry.p", "r.carry.size"), level_no + 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _unit() -> Column:
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), "text_hash")


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs(doc_id, text, source) -> one row per unit: unit, doc_id, source, text_hash, rows, size, source_size, target, copies.

    A unit is all rows with one doc_id, source and text; size is that of one row, and each of its `rows` rows is taken `copies` times.
    """
    scratch = Scratch(docs.sparkSession)
    units = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    units = units.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("rows"))
    units = scratch.write(units.withColumn("unit", _unit()))
    want = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, share, most)
    want = scratch.write(want.coalesce(1))
    rates = units.join(F.broadcast(want) if want.count() <= BROADCAST_SOURCES else want, units["source"].eqNullSafe(want["source"])).drop(want["source"])
    rates = rates.withColumn("r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("whole", F.floor(F.col("r") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("r") - F.col("whole")))
    open_ = rates.where((F.col("p") > 1e-9) & (F.col("size") > 0)).select(F.xxhash64("source", F.col("source").isNull()).alias("group"), "unit", "p", (F.col("size") * F.col("rows")).alias("size"))
    extra = round_units(open_, scratch, seed)
    out = rates.join(extra, "unit", "left").withColumn("copies", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long"))
    return out.select("unit", "doc_id", "source", "text_hash", "rows", "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents that the mix takes, a row for each copy, all columns of `docs`."""
    unit, copies, copy = (unused(docs, n) for n in ("_unit", "_copies", "_copy"))
    plan = Scratch(docs.sparkSession).write(mix(docs, seed).where("copies > 0").select(F.col("unit").alias("unit_taken"), F.col("copies").cast("int").alias(copies)))
    plan = plan.withColumnRenamed("unit_taken", unit)
    keyed = docs.withColumn(unit, F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), F.xxhash64("text")))
    out = keyed.join(F.broadcast(plan) if plan.count() <= BROADCAST_UNITS else plan, unit)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*columns(docs))
