"""Operator 2, benchmark decontamination: a distributed positional inverted index of the training texts.

DataFrame and SQL functions only. The index has one posting (term, doc, pos) for each training token that is a benchmark
term, written to the shared folder next to the terms' frequencies. For each test window (10 consecutive words
of an item, or a shorter item's all) the rarest terms are looked up first: their positions, less the term's offset in the
item, must agree on the diagonal (doc, item, doc position - item position). Diagonals that survive the two rarest lists
are intersected with the lists of all terms of the item; runs of matches as long as a window are its exact occurrences.

Defined cases: null texts have no words; an item without words has no windows; rows of the benchmark are looked up one by one, those with
one item_id count as one item, a null one as an item whose name is null, last in the list; rows that agree in doc_id and text
are scored alike, row by row; empty tables give no matches; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, columns, lower_ascii, unused

#: What separates words: every ASCII character that is no letter or digit. Listed one by one, which Java's matcher looks up in a table.
BREAK = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
WINDOW = 10
#: The benchmark's words, and candidate diagonals, are broadcast up to this many rows (a few MB) and joined by shuffle beyond.
BROADCAST_WORDS, BROADCAST_DIAGONALS = 100_000, 100_000
#: Contaminated documents (a long each) are broadcast up to this many and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: The term that ends every document in the index; its position is the document's number of words.
END = 0


def words(text: Column) -> Column:
    """The words in order, A-Z not yet lower-cased."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: w != "")


@dataclass
class Index:
    postings: DataFrame  # term, doc, pos; doc_id where term is END
    frequency: DataFrame  # term, df: occurrences in the training texts
    items: DataFrame  # item, n (its words), ipos, term
    small: bool  # the items may be broadcast


def build(docs: DataFrame, items: DataFrame, scratch: Scratch) -> Index:
    """docs(doc_id, doc, text), items(item, text) -> the index over all tokens of docs that occur in items, and docs' ends."""
    split = items.select("item", words(F.col("text")).alias("w"))
    split = split.select("item", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "raw")).select("item", "n", "ipos", lower_ascii(F.col("raw")).alias("word"))
    split = scratch.write(split.withColumn("term", F.xxhash64("word")))
    small = split.count() <= BROADCAST_WORDS
    terms = split.select("word", "term").distinct().union(docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(END).cast("long").alias("term")))
    # one scan: a document's words and, last, an empty one for its end
    tokens = docs.select("doc_id", "doc", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit("")))).alias("pos", "raw")).select("doc_id", "doc", "pos", lower_ascii(F.col("raw")).alias("word"))
    postings = tokens.join(F.broadcast(terms) if small else terms, "word")
    postings = scratch.write(postings.select("term", "doc", "pos", F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id")))
    frequency = scratch.write(postings.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("df")))
    return Index(postings, frequency, split, small)


def _anchors(index: Index, window: int) -> DataFrame:
    """item, ipos, term, part, first, second: the windows, as bits of start % 32 for part = start / 32, of which the term is the rarest or second rarest.

    A window of one word has it as both.
    """
    known = index.items.join(index.frequency, "term", "left").select("item", "n", "ipos", "term", F.coalesce("df", F.lit(0)).alias("df"))
    span = F.least(F.lit(window), F.col("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("ipos") - span + 1), F.least(F.col("ipos"), F.col("n") - span))
    each = known.withColumn("start", F.explode(starts))
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("item", "start").orderBy("df", "ipos"))).where("rank <= 2")
    bit = F.expr("shiftleft(1L, start % 32)")
    each = each.select("item", "ipos", "term", F.floor(F.col("start") / 32).alias("part"), F.when(F.col("rank") == 1, bit).otherwise(0).alias("first"), F.when((F.col("rank") == 2) | (span == 1), bit).otherwise(0).alias("second"))
    return each.groupBy("item", "ipos", "term", "part").agg(F.bit_or("first").alias("first"), F.bit_or("second").alias("second"))


def occurrences(index: Index, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(doc, item, first, last): maximal runs of document positions that are occurrences of the item's windows."""
    small = lambda df, yes: F.broadcast(df) if yes else df
    anchors = scratch.write(_anchors(index, window))
    # offset-adjusted lists of the two rarest terms of every window, intersected window by window on each diagonal
    lists = index.postings.join(small(anchors, index.small), "term").select("doc", "item", (F.col("pos") - F.col("ipos")).alias("diag"), "part", "first", "second")
    met = lists.groupBy("doc", "item", "diag", "part").agg(F.bit_or("first").alias("a"), F.bit_or("second").alias("b")).where(F.col("a").bitwiseAND(F.col("b")) != 0)
    found = scratch.write(met.select("doc", "item", "diag").distinct())
    # the lists of all terms, on the diagonals that are left
    around = index.postings.select("doc", "term", "pos").join(small(found, found.count() <= BROADCAST_DIAGONALS), "doc")
    around = around.select("doc", "item", "diag", (F.col("pos") - F.col("diag")).alias("ipos"), "term").where("ipos >= 0")
    hits = around.join(small(index.items.select("item", "ipos", "term", "n"), index.small), ["item", "ipos", "term"]).select("doc", "item", "diag", "ipos", "n").distinct()
    run = F.col("ipos") - F.row_number().over(Window.partitionBy("doc", "item", "diag").orderBy("ipos"))
    runs = hits.withColumn("run", run).groupBy("doc", "item", "diag", "run").agg(F.min("ipos").alias("a"), F.max("ipos").alias("b"), F.min("n").alias("n"))
    return runs.where(F.col("b") - F.col("a") + 1 >= F.least(F.lit(window), F.col("n"))).select("doc", "item", (F.col("diag") + F.col("a")).alias("first"), (F.col("diag") + F.col("b")).alias("last"))


def near(index: Index, slop: int) -> DataFrame:
    """Proximity matches (doc, item, first, last): all distinct terms of an item within its length plus `slop` words.

    From the rarest term of the item: each of its postings asks for the other terms around it; positions of all terms
    come by their lists, bucketed by blocks of that span. From every position up to the posting, the first of each term is taken;
    the narrowest of these windows is the posting's match.
    """
    items = index.items.join(index.frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    distinct = items.groupBy("item", "term", "df").agg(F.min("n").alias("n"))
    need = distinct.groupBy("item").agg(F.count("*").alias("need"), F.min(F.struct("df", "term")).alias("rare"), F.max(F.col("n") + slop).alias("span"))
    seeds = index.postings.join(need.select("item", "need", "span", F.col("rare.term").alias("term")), "term").select("doc", "item", "need", "span", F.col("pos").alias("at"))
    seeds = seeds.withColumn("block", F.explode(F.sequence(F.floor((F.col("at") - F.col("span")) / F.col("span")), F.floor((F.col("at") + F.col("span")) / F.col("span")))))
    lists = index.postings.join(distinct.join(need.select("item", "span"), "item"), "term").select("doc", "item", "term", "pos", F.floor(F.col("pos") / F.col("span")).alias("block"))
    around = seeds.join(lists, ["doc", "item", "block"]).where(F.abs(F.col("pos") - F.col("at")) < F.col("span"))
    of = ["doc", "item", "at", "need", "span"]
    starts = around.where("pos <= at").select(*of, F.col("pos").alias("first")).distinct()
    ends = starts.join(around, of).where((F.col("pos") >= F.col("first")) & (F.col("pos") - F.col("first") < F.col("span"))).groupBy(*of, "first", "term").agg(F.min("pos").alias("pos"))
    seen = ends.groupBy(*of, "first").agg(F.count("*").alias("terms"), F.greatest(F.max("pos"), "at").alias("last"))
    fit = seen.where((F.col("terms") == F.col("need")) & (F.col("last") - F.col("first") < F.col("span")))
    best = fit.groupBy("doc", "item", "at").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("width"), "first", "last")).alias("m"))
    return best.select("doc", "item", "m.first", "m.last").distinct()


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> (doc_id, n_words, n_hit, items array<string> sorted, null last), a row for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select("doc_id", "text").withColumn("doc", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    # a row of the benchmark is an item of its own, whatever its item_id
    rows = benchmark.select(F.xxhash64("item_id", F.col("item_id").isNull(), "text").alias("item"), F.col("item_id").cast("string").alias("name"), "text").dropDuplicates(["item"])
    rows = scratch.write(rows)
    return score(build(keyed, rows.select("item", "text"), scratch), scratch, window, rows.select("item", "name"))


def score(index: Index, scratch: Scratch, window: int, names: DataFrame) -> DataFrame:
    """(doc_id, doc, n_words, n_hit, items) of every indexed row; names(item, name) says what an item is called, which may be null."""
    found = scratch.write(occurrences(index, scratch, window).distinct())
    before = Window.partitionBy("doc").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc", "first", "last").distinct().withColumn("seen", F.coalesce(F.max("last").over(before), F.lit(-1)))
    hit = spans.groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.col("seen")))).alias("n_hit"))
    called = found.select("doc", "item").distinct().join(F.broadcast(names) if index.small else names, "item").select("doc", "name").distinct()
    # in a struct, since lists leave nulls out
    named = called.groupBy("doc").agg(F.array_sort(F.transform(F.collect_list(F.struct("name")), lambda x: x["name"])).alias("items"))
    marked = scratch.write(hit.join(named, "doc"))
    ends = index.postings.where(F.col("term") == END).select("doc_id", "doc", F.col("pos").cast("long").alias("n_words"))
    return ends.join(marked, "doc", "left").select("doc_id", "doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without those that hold an occurrence of a window."""
    scratch = Scratch(docs.sparkSession)
    bad = scratch.write(scan(docs, benchmark, window).where("n_hit > 0").select(F.col("doc").alias("_doc")).distinct())
    name = unused(docs, "_doc")
    keyed = docs.withColumn(name, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    return keyed.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, keyed[name] == bad["_doc"], "left_anti").select(*columns(docs))
