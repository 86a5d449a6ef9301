"""The stored index: postings by source and term, kept current in generations.

A write never changes a file. It adds a partition `gen=n` to three tables: `postings(root, bucket, first, last, terms, docs, data)`, partitioned by source and by a hash
bucket of the term's first letters and sorted by term, so that a word or prefix reads one bucket of each source and skips row groups by the terms'
range. A row has the packed lists of up to LISTS neighbouring terms in one block of texts that were read together, so rows are far fewer than words; `gone(root, path)`, the documents that the write replaced or removed in older generations; and `sources(root, n_docs, words)`, by how much the
sources' statistics changed. A generation counts once its last table is complete, so a write is seen as a whole or not at all. A search reads the lists of
its words in all generations, without postings of documents that a later generation lists as gone. `compact` rewrites what is
left as one generation and deletes the others. One writer at a time; readers keep the generations they opened.

Each document also has a row of no term in bucket -1, with its path, its length and its number, by which rows know their block's documents: a hash of source and path,
checked to be of one path only in its generation and source. The index lists its documents in one place, and a text is split once.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions.analysis import folded, once, pieces, to_split
from searchloom.operators.match import Phrase, bm25, idf

BUCKETS, LISTED = 16, -1
#: Sources up to this many have their statistics broadcast; beyond, they are joined by shuffle.
SOURCES = 10_000
#: Bytes of text in a block.
BLOCK = 8_000_000
#: Lists in a row at most.
LISTS = 512
TABLES = {
    "postings": "path string, length int, doc long, first string, last string, terms string, block long, docs array<bigint>, data binary, gen int, root string, bucket int",
    "gone": "root string, path string, length int, gen int",
    "sources": "root string, n_docs long, words long, gen int",
}


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(BUCKETS)).cast("int")


def bucket_of(word: str) -> int:
    """The bucket of a word, worked out on the driver."""
    h = xxhash.xxh64_intdigest(word[:2].encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % BUCKETS


def postings_of(docs: DataFrame, exact: bool, seed: int = 0) -> DataFrame:
    """docs(root, path, name, content) -> a row for each document, and for each word of a source and block of documents."""
    texts = docs.select("root", "path", F.xxhash64(F.lit(seed), "root", "path").alias("doc"), *to_split(F.col("name"), exact), *to_split(F.col("content"), exact))
    texts = texts.toDF("root", "path", "doc", "name", "name_split", "content", "content_split")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(np.asarray(pc.binary_length(batch.column(5)), dtype=np.int64))
            at = 0
            while at < len(batch):  # whole documents of about BLOCK bytes
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK)))
                yield from _inverted(batch.slice(at, end - at), exact)
                at = end

    return _bucketed(texts.mapInArrow(run, _SCHEMA))


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.when(F.col("first").isNull(), LISTED).otherwise(_bucket(F.col("first"))))


def _inverted(b: pa.RecordBatch, exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a block of documents: words get numbers, and one stable sort by source, bucket, term and column brings their places together."""
    n, doc = len(b), b.column(2).to_numpy()
    numbers, codes, sizes = defaultdict(int), array("i"), []
    numbers.default_factory = numbers.__len__
    for col in (3, 5):
        for text, split in zip(b.column(col).to_pylist(), b.column(col + 1).to_pylist(), strict=True):
            before = len(codes)
            codes.extend(map(numbers.__getitem__, pieces(text, split)))
            sizes.append(len(codes) - before)
    words = [w if w.isascii() else folded(w, exact) for w in numbers]
    known = sorted({*words} - {""})
    heads = {h: bucket_of(h) for h in {t[:2] for t in known}}
    bucket = np.array([heads[t[:2]] for t in known], dtype=np.int64)
    by = np.argsort(bucket, kind="stable")
    known, bucket = [known[k] for k in by], bucket[by]
    rank = {t: k for k, t in enumerate(known)}
    word = np.array([rank.get(w, -1) for w in words] or [-1])[np.frombuffer(codes, dtype=np.int32)] if codes else np.zeros(0, np.int64)
    text = np.repeat(np.arange(2 * n), sizes)[word >= 0]
    word = word[word >= 0]
    sizes = np.bincount(text, minlength=2 * n)
    roots: dict[str | None, int] = {}
    root = np.array([roots.setdefault(r, len(roots)) for r in b.column(0).to_pylist()])
    yield _rows(n, root=b.column(0), path=b.column(1), length=pa.array((sizes[:n] + sizes[n:]).astype(np.int32)), doc=b.column(2))
    if not len(word):
        return
    pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = (root[text % n] * len(known) + word) * 2 + (text >= n)
    order = np.argsort(key, kind="stable")
    key, own, pos = key[order], (text % n)[order], pos[order]
    new = np.diff(key, prepend=-1) != 0
    lists, pairs = np.flatnonzero(new), np.flatnonzero(new | (np.diff(own, prepend=-1) != 0))
    key, own, counts = key[lists], own[pairs], np.diff(np.append(pairs, len(pos)))
    cols, term, of = key % 2, key // 2 % len(known), key // 2 // len(known)
    at = np.append(np.searchsorted(pairs, lists), len(pairs))
    group = of * BUCKETS + bucket[term]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    inside = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    cuts = np.append(np.flatnonzero(inside % LISTS == 0), len(group))
    members = [np.flatnonzero(root == r) for r in range(len(roots))]
    place = np.zeros(n, np.int64)
    for m in members:
        place[m] = np.arange(len(m))
    tables = [doc[m] for m in members]
    names, made = list(roots), []
    pairs = np.append(pairs, len(pos))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        p, q = at[i], at[j]
        terms = [known[k] for k in term[i:j].tolist()]
        made.append((names[of[i]], terms, tables[of[i]], _packed(np.diff(at[i : j + 1]), cols[i:j], place[own[p:q]], counts[p:q], pos[pairs[p] : pairs[q]])))
    yield _lists(made)


def _lists(made: list[tuple]) -> pa.RecordBatch:
    """Rows of (source, terms in order, numbers of the block's documents, packed lists)."""
    blocks = {id(d): np.int64(np.uint64(xxhash.xxh64_intdigest(d.tobytes())).view(np.int64)) for _, _, d, _ in made}
    return _rows(
        len(made), root=pa.array([r for r, *_ in made], pa.string()), first=pa.array([t[0] for _, t, *_ in made], pa.string()), last=pa.array([t[-1] for _, t, *_ in made], pa.string()), terms=pa.array([" ".join(t) for _, t, *_ in made], pa.string()),
        block=pa.array([blocks[id(d)] for _, _, d, _ in made], pa.int64()), docs=pa.array([d for _, _, d, _ in made], pa.list_(pa.int64())), data=pa.array([x for *_, x in made], pa.binary()),
    )


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers, each in as few bytes a number as its largest takes."""
    out = []
    for a in arrays:
        kind = np.min_scalar_type(int(a.max(initial=0)))
        out += [np.array([kind.itemsize, len(a)], "<i4").tobytes(), a.astype(kind).tobytes()]
    return b"".join(out)


def _unpacked(data: bytes) -> list[np.ndarray]:
    """Of each list how many documents it has, and its column; of each of its documents the place in the block, and how often; positions."""
    out, at = [], 0
    while at < len(data):
        width, n = np.frombuffer(data, "<i4", 2, at)
        out.append(np.frombuffer(data, f"<u{width}", n, at + 8).astype(np.int64))
        at += 8 + int(width) * int(n)
    return out


def _found(word: str, prefix: bool):
    """Rows of lists -> (root, gen, col, doc, at) of one word, or of all that begin with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                root, gen, terms, docs, data = (c[k].as_py() for c in b.columns)
                terms = terms.split(" ")
                i = bisect_left(terms, word)
                j = i
                while j < len(terms) and (terms[j].startswith(word) if prefix else terms[j] == word):
                    j += 1
                if i < j:
                    each, cols, place, counts, pos = _unpacked(data)
                    at, ends = np.append(0, np.cumsum(each)), np.append(0, np.cumsum(counts))
                    p, q = at[i], at[j]
                    n = int(q - p)
                    lists = pa.ListArray.from_arrays(pa.array((ends[p : q + 1] - ends[p]).astype(np.int32)), pa.array(pos[ends[p] : ends[q]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array([root] * n, pa.string()), pa.array([gen] * n, pa.int32()), pa.array(np.repeat(cols[i:j], each[i:j]).astype(np.int32)), pa.array(np.array(docs, np.int64)[place[p:q]]), lists], names=["root", "gen", "col", "doc", "at"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lists (root, terms, docs, data, dead) without the documents that are dead."""
    for b in batches:
        made = []
        for k in range(len(b)):
            root, terms, docs, data, dead = (c[k].as_py() for c in b.columns)
            terms, docs = terms.split(" "), np.array(docs, np.int64)
            if dead:
                each, cols, place, counts, pos = _unpacked(data)
                stays = ~np.isin(docs, np.array(dead, np.int64))
                kept, moved = stays[place], np.cumsum(stays) - 1
                left = np.bincount(np.repeat(np.arange(len(each)), each)[kept], minlength=len(each))
                if not kept.any():
                    continue
                data = _packed(left[left > 0], cols[left > 0], moved[place[kept]], counts[kept], pos[np.repeat(kept, counts)])
                terms, docs = [t for t, n in zip(terms, left, strict=True) if n], docs[stays]
            made.append((root, terms, docs, data))
        if made:
            yield _lists(made)


_KINDS = {"root": pa.string(), "path": pa.string(), "length": pa.int32(), "doc": pa.int64(), "first": pa.string(), "last": pa.string(), "terms": pa.string(), "block": pa.int64(), "docs": pa.list_(pa.int64()), "data": pa.binary()}
_SCHEMA = "root string, path string, length int, doc long, first string, last string, terms string, block long, docs array<bigint>, data binary"


def _rows(n: int, **own: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([own.get(c, pa.nulls(n, kind)) for c, kind in _KINDS.items()], names=list(_KINDS))


@dataclass
class StoredIndex:
    spark: SparkSession
    path: str
    exact: bool
    generations: list[int]
    few: bool = True
    _open: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def build(docs: DataFrame, path: str, exact: bool = False) -> StoredIndex:
        """A new index of docs(root, path, name, content), in place of what the folder held."""
        index = StoredIndex(docs.sparkSession, path.rstrip("/"), exact, [])
        index._delete(index.path)
        index._write(docs, None)
        return index

    @staticmethod
    def open(spark: SparkSession, path: str, exact: bool = False) -> StoredIndex:
        index = StoredIndex(spark, path.rstrip("/"), exact, [])
        index.generations = index._committed()
        return index

    # -- files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _committed(self) -> list[int]:
        """Generations whose last table is complete; those before the newest base are no longer read."""
        found = {}
        for name in ("sources", "base"):
            fs, p = self._fs(f"{self.path}/{name}/gen=*/_SUCCESS")
            found[name] = {int(s.getPath().getParent().getName()[4:]) for s in fs.globStatus(p) or []}
        start = max(found["base"] & found["sources"], default=0)
        return sorted(g for g in found["sources"] if g >= start)

    def _table(self, name: str) -> DataFrame:
        """A table of the generations in use, listed once."""
        key = (name, *self.generations)
        if key not in self._open:
            if self.generations:
                self._open[key] = self.spark.read.schema(TABLES[name]).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/gen={g}" for g in self.generations])
            else:
                self._open[key] = self.spark.createDataFrame([], TABLES[name])
        return self._open[key]

    @property
    def postings(self) -> DataFrame:
        return self._table("postings")

    def _live(self, postings: DataFrame) -> DataFrame:
        """Without postings of documents that a later generation replaced or removed."""
        if len(self.generations) < 2:
            return postings
        last = self._table("gone").groupBy("root", "path").agg(F.max("gen").alias("until"))
        return postings.join(last, ["root", "path"], "left").where(F.col("until").isNull() | (F.col("gen") >= F.col("until"))).drop("until")

    def _listed(self) -> DataFrame:
        return self.postings.where(F.col("bucket") == LISTED).select("root", "path", "length", "doc", "gen")

    def documents(self) -> DataFrame:
        """(root, path, length) of all indexed documents."""
        return self._live(self._listed()).select("root", "path", "length")

    def sources(self) -> DataFrame:
        """(root, n_docs, mean) of every source. Up to SOURCES of them are read once and kept on the driver."""
        key = ("means", *self.generations)
        if key not in self._open:
            s = self._table("sources").groupBy("root").agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("words"))
            s = s.where("n_docs > 0").select("root", "n_docs", (F.col("words") / F.col("n_docs")).alias("mean"))
            few = s.limit(SOURCES + 1).collect()
            self.few = len(few) <= SOURCES
            self._open[key] = F.broadcast(self.spark.createDataFrame(few, s.schema)) if self.few else s
        return self._open[key]

    def _small(self, by_source: DataFrame) -> DataFrame:
        """A table of a row per source, broadcast if there are few sources."""
        return F.broadcast(by_source) if self.few else by_source

    # -- writes

    def _write(self, docs: DataFrame | None, keys: DataFrame | None, base: bool = False, rows: DataFrame | None = None) -> None:
        """One generation: documents indexed anew, and keys(root, path) of what is gone besides."""
        gen = max(self.generations, default=-1) + 1
        self._drop(gen)  # what a failed write left
        old = self.documents()
        for seed in range(4):
            own = rows
            if own is None:
                own = postings_of(docs, self.exact, seed) if docs is not None else self.postings.where("false").drop("gen")
            # partitions of a bucket are cut to size by the adaptive plan, so hot buckets become many files
            own.hint("rebalance", F.col("root"), F.col("bucket")).sortWithinPartitions("root", "bucket", "first").write.partitionBy("root", "bucket").parquet(f"{self.path}/postings/gen={gen}")
            added = self.spark.read.schema(TABLES["postings"].replace("gen int, ", "")).parquet(f"{self.path}/postings/gen={gen}").where(F.col("bucket") == LISTED)
            if not added.groupBy("root", "doc").agg(F.min("path").alias("a"), F.max("path").alias("b")).where("a <> b").head(1):
                break
            self._drop(gen)  # two documents of one number: others are given
        else:
            raise RuntimeError("documents without numbers of their own")
        fresh = added.select("root", "path")
        gone = old.join((fresh if keys is None else fresh.union(keys.select("root", "path"))).distinct(), ["root", "path"], "left_semi")
        (old.where("false") if base else gone).select("root", "path", "length").write.parquet(f"{self.path}/gone/gen={gen}")
        lost = self.spark.read.schema(TABLES["gone"].replace(", gen int", "")).parquet(f"{self.path}/gone/gen={gen}")
        change = added.select("root", F.lit(1).alias("n"), "length").union(lost.select("root", F.lit(-1), -F.col("length")))
        if base:
            self.spark.range(1).coalesce(1).write.parquet(f"{self.path}/base/gen={gen}")
        change.groupBy("root").agg(F.sum("n").cast("long").alias("n_docs"), F.sum("length").cast("long").alias("words")).write.parquet(f"{self.path}/sources/gen={gen}")
        self.generations = self._committed()

    def _drop(self, gen: int) -> None:
        for name in ("sources", "base", "gone", "postings"):
            self._delete(f"{self.path}/{name}/gen={gen}")

    def upsert(self, docs: DataFrame, keys: DataFrame | None = None) -> None:
        """Indexes documents in place of those with their keys, and removes keys(root, path), in one generation."""
        self._write(docs, keys)

    def remove(self, keys: DataFrame) -> None:
        self._write(None, keys)

    def remove_under(self, root: str, folder: str) -> int:
        """Removes all documents below a folder; how many they were."""
        from searchloom.operators.maintain import under

        keys = self.documents().where((F.col("root") == root) & under(F.col("path"), folder))
        self._write(None, keys)
        return self.spark.read.parquet(f"{self.path}/gone/gen={self.generations[-1]}").count()

    def compact(self) -> None:
        """One generation of all that is left; the older ones are deleted once it is complete."""
        before = list(self.generations)
        listed = self._live(self._listed())
        lists = self.postings.where(F.col("bucket") != LISTED)
        if len(before) > 1:
            dead = self._listed().join(listed.select("root", "path", "gen"), ["root", "path", "gen"], "left_anti").select("root", "gen", "doc")
            blocks = lists.select("root", "gen", "block", "docs").dropDuplicates(["root", "gen", "block"]).select("root", "gen", "block", F.explode("docs").alias("doc"))
            dead = blocks.join(dead, ["root", "gen", "doc"]).groupBy("root", "gen", "block").agg(F.collect_list("doc").alias("dead"))
            lists = _bucketed(lists.join(dead, ["root", "gen", "block"], "left").select("root", "terms", "docs", "data", "dead").mapInArrow(_without, _SCHEMA))
        self._write(None, None, True, lists.drop("gen").unionByName(listed.drop("gen").withColumn("bucket", F.lit(LISTED)), True))
        for g in before:
            self._drop(g)
        self.generations = self._committed()

    def backfill(self, docs: DataFrame, done: int, until: int, rows: int = 200) -> int:
        """Indexes the next documents of ids in (done, until] that aren't yet; the last id, or `until` when none is left.

        An index of another analyzer is brought up to date so beside the one in use; a step that failed is simply repeated.
        """
        from searchloom.operators.maintain import backfill_batch

        batch = backfill_batch(docs, done, until, rows)
        last = batch.agg(F.max("id")).first()[0]
        if last is None:
            return until
        own = docs.where((F.col("id") > done) & (F.col("id") <= last))
        self._write(own.join(self.documents(), ["root", "path"], "left_anti") if self.generations else own, None)
        return last

    # -- searches

    def _list(self, word: str, prefix: bool) -> DataFrame:
        own = (F.col("last") >= word) & (F.col("first") <= (word + chr(0x10FFFF) if prefix else word))
        if len(word) >= 2 or not prefix:
            own = own & (F.col("bucket") == bucket_of(word))
        return self.postings.where(own & (F.col("bucket") != LISTED)).select("root", "gen", "terms", "docs", "data").mapInArrow(_found(word, prefix), "root string, gen int, col int, doc long, at array<int>")

    def occurrences(self, p: Phrase) -> DataFrame:
        """(root, path, in_name, in_content, length) of documents with the phrase: a document's places of all words meet in one row, shifted and intersected."""
        if not p.words:
            return self._listed().where("false").select("root", "path", F.lit(0).cast("long").alias("in_name"), F.lit(0).cast("long").alias("in_content"), "length")
        back = lambda k: F.transform("at", lambda x: x - k)
        lists = [self._list(w, p.prefix and k == len(p.words) - 1).select("root", "gen", "col", "doc", F.lit(k).alias("k"), back(k).alias("at")) for k, w in enumerate(p.words)]
        if len(lists) == 1:
            counts = [F.coalesce(F.sum(F.when(F.col("col") == col, F.size("at"))), F.lit(0)) for col in (0, 1)]
        else:
            places = lambda col, k: F.flatten(F.collect_list(F.when((F.col("col") == col) & (F.col("k") == k), F.col("at"))))
            counts = [F.size(reduce(F.array_intersect, [places(col, k) for k in range(len(lists))])) for col in (0, 1)]
        out = reduce(DataFrame.union, lists).groupBy("root", "gen", "doc").agg(counts[0].cast("long").alias("in_name"), counts[1].cast("long").alias("in_content")).where("in_name + in_content > 0")
        out = self._live(out.join(self._listed(), ["root", "gen", "doc"]))
        return out.groupBy("root", "path").agg(*[F.first(c).alias(c) for c in ("in_name", "in_content", "length")])

    def score(self, phrases: list[Phrase]) -> DataFrame:
        """(root, path, relevance_score) of documents with all phrases. A list is read once: its documents and their number share one shuffle."""
        out, sources = None, self.sources()
        for k, p in enumerate(phrases):
            own = once(self.occurrences(p), [F.col(c) for c in ("root", "path", "in_name", "in_content", "length")])
            df = own.groupBy("root").agg(F.count("*").alias(f"df{k}"))
            own = own.select("root", "path", F.col("in_name").alias(f"n{k}"), F.col("in_content").alias(f"c{k}"), *(["length"] if k == 0 else []))
            own = own.join(self._small(df), "root")
            out = own if out is None else out.join(own, ["root", "path"])
        ks = range(len(phrases))
        score = bm25([F.col(f"n{k}") for k in ks], [F.col(f"c{k}") for k in ks], [idf(F.col("n_docs"), F.col(f"df{k}")) for k in ks], F.col("length"), F.col("mean"))
        return out.join(sources, "root").select("root", "path", score.alias("relevance_score"))
