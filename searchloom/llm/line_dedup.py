"""Operator 4, line dedup: fuzzy lines by MinHash, exact Jaccard verification, distributed union-find.

Distinct non-blank lines (split at newlines) get a one-permutation MinHash of their character shingles: every shingle's hash
falls in one of BANDS * ROWS bins, each keeps its least, and an empty bin borrows from the next one. Lines that agree in all ROWS
bins of a band share a list. Pairs of a list are verified by exact Jaccard of their shingle sets, at SIMILARITY
or more. A list longer than LIST_CAP isn't paired: all its lines are verified against its first; those near it are connected
already, whatever their number, and only the others meet the whole list, block by block, where products of shingle matrices give exact
similarities and a spanning forest is kept. Components are joined by union-find; each keeps its first occurrence,
by doc_id and line, and loses the others.

Defined cases: a null text has no lines; blank lines are always kept and have no duplicates; a line shorter than a shingle is
its own only shingle; rows that agree in doc_id and text are one document; null doc_ids come last; empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, columns, components, unused

SHINGLE, SIMILARITY = 7, 0.8
BANDS, ROWS = 12, 4
LIST_CAP, BLOCK = 64, 512
#: Characters of a block, about.
BLOCK_CHARS = 400_000
#: Ids of lines that share a list are broadcast up to this many (about 16 MB) and joined by shuffle beyond.
BROADCAST_LINES = 500_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(line: str, k: int = SHINGLE) -> set[str]:
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def similarity(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    return h


def shingle_ids(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of all lines' shingles in order, and the number of each one's line."""
    padded = [s if len(s) >= k else s + "\0" * (k - len(s)) for s in lines]
    n = np.fromiter(map(len, padded), np.int64, len(padded))
    cp = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h, length, rest = np.zeros(len(cp) + 1, np.uint64), 0, k
    power, piece = cp, 1  # hashes of runs of `piece` characters, doubled as the bits of k are used up
    while rest:
        if rest & 1:
            n_out = len(cp) - length - piece + 1
            h = h[:n_out] * np.uint64(pow(int(_A), piece, 1 << 64)) + power[length : length + n_out]
            length += piece
        rest >>= 1
        if rest:
            power = power[:-piece] * np.uint64(pow(int(_A), piece, 1 << 64)) + power[piece:]
            piece *= 2
    _mix(h)
    row = np.repeat(np.arange(len(n)), n)[: len(h)]
    left = (np.cumsum(n)[row] - np.arange(len(h))) >= k
    return h[left], row[left]


def band_keys(lines: list[str], k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """uint64 keys, a row for each line and a column for each band; a key tells its band, too."""
    h, row = shingle_ids(lines, k)
    n = lines
    bins = bands * rows
    sig = np.full(len(n) * bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(sig, row * bins + (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64), h)
    sig = sig.reshape(-1, bins)
    empty = sig == np.iinfo(np.uint64).max
    which, step = np.flatnonzero(empty.any(axis=1)), np.uint64(1)
    part, empty = sig[which], empty[which]
    while len(which):  # an empty bin takes what the next has, changed by the distance; lines without empty bins are done
        part = np.where(empty, _mix(np.roll(part, -1, axis=1) + _A * step), part)
        empty &= np.roll(empty, -1, axis=1)
        step += np.uint64(1)
        sig[which] = part
        more = empty.any(axis=1)
        which, part, empty = which[more], part[more], empty[more]
    keys = np.zeros((len(n), bands), np.uint64)
    for i in range(rows):
        keys = _mix(keys * _A + sig[:, i::rows])
    return _mix(keys * _A + np.arange(bands, dtype=np.uint64))


def _blank(line: Column) -> Column:
    return ~line.rlike(r"[^ \t\r\x0b\x0c]")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (lid, line, first struct<doc_id, doc, pos>)."""
    text = F.col("text")
    doc = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("doc")
    rows = docs.where(text.isNotNull()).select("doc_id", doc, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).where(~_blank(F.col("line")))
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc", "pos")
    return rows.groupBy(F.xxhash64("line").alias("lid")).agg(F.min_by("line", at).alias("line"), F.min(at).alias("first"))


def _posted(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 250):  # arrays of so many lines stay in the processor's cache
                b = batch.slice(at, 250)
                keys = band_keys(b.column(1).to_pylist())
                lid = np.repeat(b.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(lid)], names=["key", "lid"])

    return lines.select("lid", "line").mapInArrow(run, "key long, lid long")


def _kinds(ids: np.ndarray) -> np.ndarray:
    """Distinct ids in order."""
    ids = np.sort(ids)
    return ids[np.concatenate(([True], ids[1:] != ids[:-1]))]


def _near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two lines' distinct ids are similar; lines of too different sizes can't be."""
    n = len(x) + len(y)
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # two runs in order are merged
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (n - shared) >= SIMILARITY


def _verified(pairs: DataFrame) -> DataFrame:
    """(src, dst, a, b) -> (src, dst, near): exact Jaccard of the shingles, by their 64-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                b = batch.slice(at, 200)
                xs, ys = b.column(2).to_pylist(), b.column(3).to_pylist()
                place = {s: i for i, s in enumerate(dict.fromkeys([*xs, *ys]))}
                ids, row = shingle_ids(list(place))
                cuts = np.searchsorted(row, np.arange(len(place) + 1)).tolist()
                kinds = [_kinds(ids[i:j]) for i, j in zip(cuts, cuts[1:])]  # noqa: B905
                near = [_near(kinds[place[x]], kinds[place[y]]) for x, y in zip(xs, ys, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.bool_())], names=["src", "dst", "near"])

    return pairs.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long, near boolean")


def _block_links(pairs: DataFrame) -> DataFrame:
    """Pairs of blocks (one, two: arrays of lid, line) -> forest edges (src, dst)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .embedding_dedup import _forest

        for b in batches:
            for one, two in zip(b.column(0), b.column(1), strict=True):
                one, two = one.as_py(), two.as_py()
                ids, row = shingle_ids([r["line"] for r in (*one, *two)])
                kinds, ids = np.unique(ids, return_inverse=True)
                both, sizes = np.zeros((len(one), len(two)), np.float32), np.zeros(len(one) + len(two), np.float32)
                for at in range(0, len(kinds), 4096):  # some kinds of shingles at a time, so that the matrix stays small
                    own = (ids >= at) & (ids < at + 4096)
                    m = np.zeros((len(sizes), min(4096, len(kinds) - at)), np.float32)
                    m[row[own], ids[own] - at] = 1
                    both += m[: len(one)] @ m[len(one) :].T
                    sizes += m.sum(axis=1)
                na, nb = sizes[: len(one)], sizes[len(one) :]
                link = both >= SIMILARITY * (na[:, None] + nb[None, :] - both) - 1e-3
                la, lb = (np.array([r["lid"] for r in side], np.int64) for side in (one, two))
                link &= la[:, None] != lb[None, :]
                if link.any():
                    src, dst = _forest(link, la, lb)
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return pairs.mapInArrow(run, "src long, dst long")


def links(lines: DataFrame, scratch: Scratch, list_cap: int = LIST_CAP) -> DataFrame:
    """Distinct lines(lid, line) -> edges (src, dst) whose components are those of all verified pairs that share a list."""
    # one shuffle of the postings: a list's length is counted where it lies, and lists of one line go
    listed = scratch.write(_posted(lines).withColumn("count", F.count("*").over(Window.partitionBy("key"))).where("count > 1"))
    shared = listed.select("lid").distinct()
    few = scratch.write(shared)
    text = scratch.write(lines.select("lid", "line").join(F.broadcast(few) if few.count() <= BROADCAST_LINES else few, "lid", "left_semi"))
    lists = listed.where(F.col("count") <= list_cap).groupBy("key").agg(F.array_sort(F.collect_list("lid")).alias("l"))
    pairs = lists.select("l", F.posexplode("l").alias("i", "src")).select("src", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("dst")).distinct()
    long_ = listed.where(F.col("count") > list_cap)
    heads = long_.groupBy("key").agg(F.min("lid").alias("head"))
    spokes = long_.join(heads, ["key"]).where("lid <> head")
    # every pair once, whichever lists it is of
    asked = pairs.union(spokes.select(F.col("head").alias("src"), F.col("lid").alias("dst"))).distinct()
    asked = asked.join(text.select(F.col("lid").alias("dst"), F.col("line").alias("b")), "dst").join(text.select(F.col("lid").alias("src"), F.col("line").alias("a")), "src")
    checked = scratch.write(_verified(asked))
    edges = checked.where("near").select("src", "dst")
    far = spokes.join(checked.where("not near").select(F.col("src").alias("head"), F.col("dst").alias("lid")), ["head", "lid"], "left_semi")
    odd = scratch.write(far.select("key", "lid").distinct())
    if odd.isEmpty():
        return edges
    whole = long_.join(odd.select("key").distinct(), ["key"], "left_semi").join(text, "lid")
    chars = F.sum(F.length("line")).over(Window.partitionBy("key"))
    sized = whole.select("key", "lid", "line", F.ceil(F.greatest(F.col("count") / BLOCK, chars / BLOCK_CHARS)).alias("blocks"))
    pack = lambda df, name: df.groupBy("key", F.pmod(F.shiftright("lid", 9), "blocks").alias(name + "_no")).agg(F.collect_list(F.struct("lid", "line")).alias(name))
    every = pack(sized, "two")
    ones = pack(sized.join(odd, ["key", "lid"], "left_semi"), "one")
    # the adaptive plan splits the blocks of a key with very many of them over tasks
    return edges.union(_block_links(ones.join(every, ["key"]).select("one", "two")))


def kept_lines(docs: DataFrame, list_cap: int = LIST_CAP) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, doc, pos): the non-blank line occurrences that stay, one for each component."""
    scratch = Scratch(docs.sparkSession)
    lines = scratch.write(distinct_lines(docs))
    roots = components(links(lines, scratch, list_cap), scratch).withColumnRenamed("node", "lid")
    firsts = lines.select("lid", "first").join(roots, "lid", "left").groupBy(F.coalesce("component", "lid").alias("root")).agg(F.min("first").alias("f"))
    return firsts.select("f.doc_id", "f.doc", "f.pos")


def _lines_of(docs: DataFrame) -> DataFrame:
    blank = F.filter(F.split("text", "\n", -1), _blank)
    return docs.select("doc_id", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("doc"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.size(blank)).cast("long").alias("n_blank"))


def report(docs: DataFrame, list_cap: int = LIST_CAP) -> DataFrame:
    """docs -> (doc_id, n_lines, n_blank, n_kept, n_removed, kept array<int>): per document, kept are the numbers of non-blank lines that stay."""
    kept = kept_lines(docs, list_cap).groupBy("doc").agg(F.array_sort(F.collect_list("pos")).alias("kept"))
    out = _lines_of(docs).join(kept, "doc", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    n = F.size("kept").cast("long")
    return out.select("doc_id", "n_lines", "n_blank", n.alias("n_kept"), (F.col("n_lines") - F.col("n_blank") - n).alias("n_removed"), "kept")


def dedup(docs: DataFrame, list_cap: int = LIST_CAP) -> DataFrame:
    """All columns of docs, the texts without removed lines."""
    doc, kept = unused(docs, "_doc"), unused(docs, "_kept")
    keyed = docs.withColumn(doc, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    stay = kept_lines(docs, list_cap).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("pos").alias(kept))
    text = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: F.coalesce(F.array_contains(kept, i), F.lit(False)) | _blank(x)), "\n").alias("text")
    joined = keyed.join(stay, doc, "left")
    return joined.select(*[text if c == "text" else own for c, own in zip(docs.columns, columns(docs), strict=True)])
