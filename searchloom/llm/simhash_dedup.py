"""Operator 8, SimHash near-dedup: byte-position inverted index with count filtering.

A fingerprint's 8 bytes are its (position, byte) postings. Fingerprints that differ in 2 bits at most share 6 of 8 of
them, the guaranteed minimum. A list of one posting holds 1/256 of all fingerprints, so pairing within it grows with
the square of the corpus; as 6 shared bytes leave 2 of the 4 byte pairs whole, the index keeps the intersections of four
lists at a time instead (6 keys of 4 postings each). Pairs in a list are tallied over all 8 positions, those with at
least 6 are kept, and their bits compared.

A list longer than `list_cap` is not paired at all. Its fingerprints emit the 65 points within one bit of
themselves: two fingerprints differ in at most 2 bits exactly if they share such a point, so joining all that share
a point to the least of them gives the same components, with work in proportion to the fingerprints.

Defined cases: a null or blank text has fingerprint 0, linked like any other; repeated rows and ties are in one component;
a null doc_id is never a component id unless its component has no other; empty table: no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns, components, unused

SHINGLE, SEED = 3, 42
#: Differing bits of fingerprints that make a candidate pair of near copies.
NEAR_BITS = 4
#: Longest list whose pairs are tallied.
LIST_CAP = 64
#: Rows that go are broadcast (as one long each) up to this many and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; white space and case as in the module's contract."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 15):
        to = min(n, at + (1 << 15))
        ones += _ones(np.array([h(whole[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)], np.uint64))
    return _majority(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of 64-bit hashes."""
    return _majority(sum((_ones(hashes[at : at + (1 << 15)]) for at in range(0, len(hashes), 1 << 15)), np.zeros(64, np.int64)), len(hashes))


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp, *more), fp the fingerprint's bits as a long."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], names=["doc_id", "fp", *more])

    return docs.select("doc_id", "text", *more).mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", "fp long", *[f"`{c}` {kinds[c]}" for c in more]]))


def _byte(c: Column, i: int) -> Column:
    return F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))


def _keys(bits: int) -> list[tuple[int, ...]]:
    """Byte positions of the intersected lists: any 8 - bits positions, those that two near fingerprints share at least, hold all of one key."""
    if bits == 2:  # two of the four byte pairs
        return [(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i in range(4) for j in range(i)]
    if bits == 4:  # three of one part, or two of one and one of the next: Turan's triples, of which any four positions hold one
        parts = ((0, 1, 2), (3, 4, 5), (6, 7))
        return [parts[0], parts[1]] + [(x, y, z) for k in range(3) for x in parts[k] for y in parts[k] if x < y for z in parts[(k + 1) % 3]]
    raise ValueError("the index is laid out for 2 or 4 differing bits")


def _postings(fps: DataFrame, bits: int) -> DataFrame:
    """A row for each fingerprint and each key: key is its number and its bytes."""
    join = lambda at: functools.reduce(Column.bitwiseOR, [F.shiftleft(_byte(F.col("fp"), p), 8 * k) for k, p in enumerate(at)])
    keys = [F.struct(F.lit(k).cast("byte").alias("at"), join(at).alias("bytes")) for k, at in enumerate(_keys(bits))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.at", "k.bytes")


def _listed(fps: DataFrame, scratch: Scratch, bits: int) -> DataFrame:
    """The postings of lists of several fingerprints, with the lists' lengths, written."""
    posted = _postings(fps, bits)
    return scratch.write(posted.join(posted.groupBy("at", "bytes").count().where("count > 1"), ["at", "bytes"]))


def _near(pairs: DataFrame, bits: int) -> DataFrame:
    """Pairs tallied over all 8 positions, then compared by their bits."""
    differ = F.col("src").bitwiseXOR(F.col("dst"))
    shared = sum(((_byte(differ, i) == 0).cast("int") for i in range(8)), F.lit(0))
    return pairs.withColumn("shared", shared).where(F.col("shared") >= 8 - bits).where(F.bit_count(differ) <= bits).select("src", "dst")


def _paired(listed: DataFrame, list_cap: int) -> DataFrame:
    lists = listed.where(F.col("count") <= list_cap).groupBy("at", "bytes").agg(F.array_sort(F.collect_list("fp")).alias("l"))
    return lists.select("l", F.posexplode("l").alias("i", "src")).select("src", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("dst"))


def links(fps: DataFrame, scratch: Scratch, list_cap: int = LIST_CAP) -> DataFrame:
    """Distinct fps(fp) -> (src, dst): edges whose components are those of all pairs with 2 or fewer differing bits."""
    listed = _listed(fps, scratch, 2)
    near = _near(_paired(listed, list_cap), 2)
    hot = listed.where(F.col("count") > list_cap).select("fp").distinct()
    points = hot.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1")
    around = points.join(least, "point").where("fp <> dst").select(F.col("fp").alias("src"), "dst")
    return near.union(around)


def candidates(fps: DataFrame, scratch: Scratch, bits: int = NEAR_BITS, list_cap: int = LIST_CAP) -> DataFrame:
    """Distinct fps(fp) -> distinct pairs (src, dst) of at most `bits` differing bits: all but some pairs that meet in lists over the cap only,
    where each meets the least of the list. For callers that check pairs, and complete them exactly."""
    listed = _listed(fps, scratch, bits)
    heads = listed.where(F.col("count") > list_cap).groupBy("at", "bytes").agg(F.min("fp").alias("src"))
    hot = listed.where(F.col("count") > list_cap).join(heads, ["at", "bytes"]).where("src <> fp").select("src", F.col("fp").alias("dst"))
    return _near(_paired(listed, list_cap).union(hot), bits).distinct()


def _labels(prints: DataFrame, scratch: Scratch, list_cap: int) -> DataFrame:
    """prints(doc_id, fp) -> written (fp, root, component_id), a row for each fingerprint."""
    firsts = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fp"), scratch, list_cap), scratch).withColumnRenamed("node", "fp")
    rooted = scratch.write(firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return scratch.write(rooted.join(least, "root").select("fp", "root", "component_id"))


def groups(docs: DataFrame, list_cap: int = LIST_CAP) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp, component_id): the smallest doc_id reachable over links of fingerprints."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(fingerprints(docs))
    return prints.join(_labels(prints, scratch, list_cap), "fp").select("doc_id", "fp", "component_id")


def keep_one(keyed: DataFrame, row: str, own: list[Column], found: DataFrame, scratch: Scratch) -> DataFrame:
    """Of found(root, doc_id, _row), a row for each of keyed, the one row of each root that stays."""
    rooted = scratch.write(found.select("root", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row").alias("place")))
    stays = rooted.groupBy("root").agg(F.min("place").alias("place")).select("place._row")
    goes = scratch.write(rooted.select("place._row").join(stays, "_row", "left_anti").distinct())
    out = keyed.join(F.broadcast(goes) if goes.count() <= BROADCAST_ROWS else goes, keyed[row] == goes["_row"], "left_anti")
    rows, distinct = rooted.agg(F.count("*"), F.countDistinct("place._row")).first()
    if rows != distinct:
        out = out.dropDuplicates([row])
    return out.select(*own)


def dedup(docs: DataFrame, list_cap: int = LIST_CAP, similarity: float | None = None) -> DataFrame:
    """The documents without all but one of each group: the one of smallest doc_id stays, null last, and of rows
    with that doc_id the one of smallest hash over all columns; of equal rows one.

    Groups are linked by fingerprints at 2 or fewer differing bits, or, with a `similarity`, by five-word shingle sets of that Jaccard
    similarity or more. Then the index gives candidates at NEAR_BITS or fewer differing bits, whose sets are compared. Not all near copies are among them: at 0.8
    fingerprints differ in 10 of 64 bits in the mean, which leaves no byte in common in one pair of twelve. So `near_copies` goes
    on to the pairs that the fingerprints' links leave apart, by the shingles themselves, and misses none.
    """
    if similarity is not None:
        from . import near_copies

        if similarity * near_copies.OF != near_copies.NEAR:
            raise ValueError(f"near copies are those of {near_copies.NEAR}/{near_copies.OF} and more")
        return near_copies.dedup(docs, list_cap)
    scratch = Scratch(docs.sparkSession)
    own, row = columns(docs), unused(docs, "_row")
    keyed = docs.withColumn(row, F.xxhash64(*own, *[c.isNull() for c in own]))
    prints = scratch.write(fingerprints(keyed, row).withColumnRenamed(row, "_row"))
    return keep_one(keyed, row, own, prints.join(_labels(prints, scratch, list_cap).select("fp", "root"), "fp"), scratch)
