"""Operator 6, token-ID output: ids of whole texts in ascending doc_id order, in blocks of an adaptive context-mixing range coder.

Texts are range-partitioned and sorted by doc_id (the one shuffle), tokenized, and packed into segments of whole documents
(about SEGMENT ids, two coder blocks). A segment's row has its place (shard, seq), its documents' ids and lengths, and `frames`, the coded
blocks (see range_coder) with a checksum each. Segments are written as Parquet by Spark, so that the folder may be in any
store; a lost task rewrites its own file. Reading decodes a segment's blocks side by side and fails on damage.

Ids must be below 65,536. Words are encoded with the tokenizers library's model once and kept in a bounded table (see word_ids), as
byte-level BPE never merges across the words of its own pre-tokenizer; texts with a special token's string, or with characters
for which two versions of Unicode may split differently, go through the library whole.

Defined cases: a null text is empty and has the end id alone; null doc_ids come first; repeated doc_ids keep their rows, in
any order among themselves; an empty table gives no segments.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import range_coder, word_ids
from .common import Scratch, trim

#: Ids in a segment, at least, unless its shard ends.
SEGMENT = 2 * range_coder.BLOCK
#: Words whose ids a worker keeps, in two tables: the newer takes over what it meets of the older.
CACHE = 300_000
#: Segments are few; their starts are broadcast up to this many and joined by shuffle beyond.
BROADCAST_SEGMENTS = 50_000
#: Bytes of texts that are cut into words at once, unless one text has more.
CHUNK = 1 << 19


class Encoder:
    """texts -> ids, as the tokenizers library encodes them without special tokens added."""

    def __init__(self, path: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        # parts of the tokenizer, not its whole file as Python objects
        pre = json.loads(self.lib.pre_tokenizer.__getstate__()) if self.lib.pre_tokenizer else {}
        self.by_word = self.lib.normalizer is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and pattern == word_ids.PATTERN
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Words are kept for a task: a worker that goes on to another operator holds none."""
        self.known, self.older = {}, {}
        trim()

    def _library(self, text: str) -> np.ndarray:
        ids = self.lib.encode(text, add_special_tokens=False).ids
        if ids and max(ids) >= 1 << 16:
            raise ValueError("ids of 16 bits only")
        return np.array(ids, np.uint16)

    def _by_words(self, raw: bytes, own: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of plain texts: the bytes between the offsets, of these classes."""
        at = word_ids.cut(raw, own, offsets)
        size, parts, counts = np.diff(at, append=len(own)), [], [np.zeros(1, np.int64)]
        for k in range(0, len(at), word_ids.PIECE):
            if not self.known or len(self.known) > CACHE // 2 or self.known.used > 16 * CACHE:  # words that aren't met again go with the table before
                self.older, self.known = self.known, word_ids.Words(self.lib.model.tokenize, CACHE // 2, self.known or None)
                if self.older:
                    self.older.older = None
            ids, n = self.known.ids(self.known.look(raw, at[k : k + word_ids.PIECE], size[k : k + word_ids.PIECE]))
            parts.append(ids)
            counts.append(n)
        ends = np.cumsum(np.concatenate(counts))[np.searchsorted(at, offsets)].tolist()
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column, 16-bit integers; null is empty."""
        texts = texts.fill_null("").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
            raw = bytes(memoryview(data)[offsets[a] : offsets[b]]) if data else b""
            yield from self._chunk(raw, offsets[a : b + 1] - offsets[a])
            a = b

    def _chunk(self, raw: bytes, offsets: np.ndarray) -> list[np.ndarray]:
        if not self.by_word:
            return [self._library(raw[a:b].decode()) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        own = word_ids.classes(raw + bytes(word_ids.PAD), len(raw))
        whole = np.zeros(len(offsets), bool)  # texts for the library
        whole[np.searchsorted(offsets, np.flatnonzero(own == word_ids.NOT_PLAIN), "right") - 1] = True
        whole[:-1] |= np.array([0x80 <= (raw[a] if a < len(raw) else 0) < 0xC0 for a in offsets[:-1].tolist()], bool)  # half a character
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                whole[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(s, at + 1)
        if not whole.any():
            return self._by_words(raw + bytes(word_ids.PAD), own, offsets)
        rows = [(raw[a:b], w) for a, b, w in zip(offsets.tolist(), offsets[1:].tolist(), whole.tolist())]
        plain = [r for r, w in rows if not w]
        rest = iter(self._chunk(b"".join(plain), np.cumsum([0, *map(len, plain)])))
        return [self._library(r.decode()) if w else next(rest) for r, w in rows]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of 16-bit integers."""
        return [ids.tobytes() for ids in self.column(pa.array(texts, pa.string()))]


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process, for all its tasks."""
    return Encoder(path, pattern)


def segments(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> (shard, seq, n_ids, doc_ids, lengths, frames)."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # texts break ties, so that rows without an id, or of one id, are no single range
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = docs.select("doc_id", "text").repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("frames", pa.binary())])
    end = np.array([end_id], np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard, seq = encoder(tokenizer, pattern), TaskContext.get().partitionId(), 0
        ids, lengths, parts, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            whole = np.concatenate(parts)
            parts.clear()
            frames = range_coder.encode(whole)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((shard, seq, total, ids, lengths, frames), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, part in zip(batch.column(0).to_pylist(), encode.column(batch.column(1)), strict=True):
                ids.append(doc_id)
                lengths.append(len(part) + 1)
                parts += (part, end)
                total += lengths[-1]
                if total >= SEGMENT:
                    yield flush()
                    seq, ids, lengths, parts, total = seq + 1, [], [], [], 0
        if ids:
            yield flush()
        parts.clear()
        encode.forget()

    return ordered.mapInArrow(run, "shard int, seq int, n_ids long, doc_ids array<long>, lengths array<long>, frames binary")


def read(segs: DataFrame) -> DataFrame:
    """Segments -> (shard, seq, doc_id, at, n_tokens, ids_crc32): a row for each document, from its decoded ids; at counts in its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = range_coder.decode(row["frames"])
                if len(ids) != row["n_ids"] or sum(row["lengths"]) != len(ids):
                    raise ValueError("a segment's ids don't match its documents")
                n = np.array(row["lengths"], np.int64)
                at = np.cumsum(n) - n
                crc = [zlib.crc32(ids[a : a + k].astype("<u4")) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                m = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * m, pa.int32()), pa.array([row["seq"]] * m, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(at), pa.array(n), pa.array(crc, pa.int64())],
                    names=["shard", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )
        trim()

    return segs.select("shard", "seq", "n_ids", "doc_ids", "lengths", "frames").mapInArrow(run, "shard int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")


def digests(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0) -> DataFrame:
    """Writes the documents' ids, reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    scratch = Scratch(docs.sparkSession)
    segs = scratch.write(segments(docs, tokenizer, pattern, end_id))
    # ids before a shard, from a row for each shard, and before a segment within its shard
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = segs.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", before(Window.orderBy("shard")).alias("base"))
    within = segs.select("shard", "seq", before(Window.partitionBy("shard").orderBy("seq")).alias("own"))
    starts = within.join(shards, "shard").select("shard", "seq", (F.col("base") + F.col("own")).alias("base"))
    if segs.count() <= BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)
    return read(segs).join(starts, ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
