"""Operator 7, suffix-array dedup: bucket-pointer refinement over the bytes of all texts.

A full suffix array orders every position; only the order of 50-byte prefixes matters here, and only where two documents
meet. So buckets are kept at anchors: of the q-grams that start in a 50-byte string the one of least hash. Equal strings
have equal anchors, at about one byte in 16. A q-gram's bucket has an identifier (its hash), and each anchor carries the identifiers of the
buckets at four other offsets, 15 and 30 bytes later and earlier, which with its own cover the 80 bytes that hold every
50-byte string with this anchor.

1. Anchors fall into buckets by their q-gram.
2. Rounds refine them: a round sorts a bucket's members by the bucket identifiers at one of the offsets (`refine`), and the refined numbers are what the
   next round starts from. Only buckets that are still open, with members of several documents, go on. After four rounds members agree in
   all 80 bytes: all but the smallest document are covered there, and need no more work.
3. Of what is left, those whose bucket is open after one round (15 bytes later, or 15 earlier: any 50-byte string with this anchor holds one or
   the other) refine to single 50-byte strings on that side. A string's identifier joins those of the buckets at its offsets 0, 15
   and 30, and is compared across anchors.

Each map task does the rounds among its own documents first, so a passage that a third of all documents share reaches
its bucket once for each task's batch, not once for each document. All decisions rest on 96 bits or more of identifiers.

Defined cases: null texts are empty; texts shorter than 50 bytes lose nothing; rows with one doc_id don't cover each other, and
rows that also agree in text are reported alike; null doc_ids count as larger than all others; empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, trim

LENGTH, Q = 50, 20
_W = LENGTH - Q + 1
#: A string has at least so many bytes before its anchor's q-gram, or else after it.
_SIDE = (LENGTH - Q) // 2
#: Windows of a text that are worked on at once, and anchors that a map task gathers before it sends them on.
PIECE, FLUSH = 1 << 17, 200_000
#: Bytes that an anchor takes on its way to its bucket (a text has one at about every 16 bytes), and bytes of a bucket, about.
ANCHOR_BYTES, BUCKET_BYTES = 38, 32 << 20
NO_ID = (1 << 63) - 1
_U = np.uint64


class Hashes:
    """Identifiers of q-grams: polynomial hashes from prefix sums modulo 2^64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        base = int(rng.integers(1 << 62, 1 << 63)) | 5
        n = PIECE + 4 * LENGTH + 64
        self.up = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(n, _U(base & (1 << 64) - 1)))))
        self.down = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(n, _U(pow(base, -1, 1 << 64))))))

    def grams(self, buf: bytes) -> np.ndarray:
        """The identifier of the q-gram at each position of a piece."""
        x = self.table[np.frombuffer(buf, np.uint8)]
        x *= self.up[: len(x)]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        return mix((sums[Q:] - sums[:-Q]) * self.down[: len(sums) - Q])


def mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    return h


def anchors(text: bytes, ids: Hashes) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, first window, last window, identifiers at 0, +SIDE, +2 SIDE, -SIDE, -2 SIDE) of a text, piece by piece.

    Where the text doesn't reach so far, the identifier at one SIDE is 0, that at two is of its outermost q-gram, with the distance.
    """
    n = len(text)
    for s in range(0, n - LENGTH + 1, PIECE):
        e = min(n - LENGTH + 1, s + PIECE)
        x0, x1 = max(0, s - _W), min(n, e + _W + LENGTH)
        grams = ids.grams(text[x0:x1])
        own = grams[s - x0 : e - x0 + _W - 1]
        low = (own & ~_U(0xFFFFFF)) | np.arange(len(own), dtype=np.uint64)
        reach = 1
        while reach * 2 <= _W:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if rest := _W - reach:
            low = np.minimum(low[:-rest], low[rest:])
        where = (low & _U(0xFFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1))
        last = np.concatenate((first[1:] - 1, [e - s - 1]))
        a = where[first] + s
        out = [own[where[first]].astype(np.uint32)]
        for way, room in ((1, n - Q - a), (-1, a)):
            near = np.where(room >= _SIDE, grams[np.clip(a + way * _SIDE - x0, 0, len(grams) - 1)] | _U(1), _U(0))
            reached = np.minimum(room, 2 * _SIDE)
            far = grams[a + way * reached - x0] + reached.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
            out += [near.astype(np.uint32), (mix(far) >> _U(16)).astype(np.uint32)]
        # a q-gram's bucket is the low half of its hash: anchors have small hashes, which shows in the high half
        yield a, first + s, last + s, *out


_COLUMNS = (("gram", "<u4"), ("right", "<u4"), ("right2", "<u4"), ("left", "<u4"), ("left2", "<u4"), ("doc", "<i8"), ("crc", "<u4"), ("a", "<u4"), ("lo", "u1"), ("hi", "u1"))
_HITS = (("doc", "<i8"), ("crc", "<u4"), ("lo", "<u4"), ("hi", "<u4"))
#: Offsets whose bucket identifiers the rounds sort by.
ROUNDS = ("right", "right2", "left", "left2")


def _pack(columns: dict, kinds) -> bytes:
    return b"".join(np.ascontiguousarray(columns[k].astype(t)).tobytes() for k, t in kinds)


def _unpack(blobs: list[bytes], kinds) -> dict:
    width, parts = sum(np.dtype(t).itemsize for _, t in kinds), {k: [] for k, _ in kinds}
    for b in blobs:
        n, at = len(b) // width, 0
        for k, t in kinds:
            parts[k].append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(parts[k]) if parts[k] else np.zeros(0, t) for k, t in kinds}


def refine(bucket: np.ndarray, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: members of a bucket, sorted by identifiers at an offset, fall into buckets of their own.

    (number of each row's new bucket, whether it is still open, with members of several documents).
    """
    if not len(bucket):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((ids, bucket))
    b, i, d = bucket[order], ids[order], doc[order]
    starts = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (i[1:] != i[:-1]))))
    size = np.diff(np.concatenate((starts, [len(b)])))
    several = np.maximum.reduceat(d, starts) != np.minimum.reduceat(d, starts)
    number, open_ = np.zeros(len(b), np.int64), np.zeros(len(b), bool)
    number[order], open_[order] = np.repeat(np.arange(len(starts)), size), np.repeat(several, size)
    return number, open_


def _covered(c: dict) -> np.ndarray:
    """Rows whose 80 bytes a smaller document has, too: all rounds, each on the buckets that the one before left open."""
    rows = np.arange(len(c["gram"]))
    number, open_ = refine(c["gram"], np.zeros(len(rows), np.uint8), c["doc"])
    for side in ROUNDS:
        rows, number = rows[open_], number[open_]
        number, open_ = refine(number, c[side][rows], c["doc"][rows])
    rows, number = rows[open_], number[open_]
    out = np.zeros(len(c["gram"]), bool)
    if len(rows):
        least = np.full(int(number.max()) + 1, NO_ID, np.int64)
        np.minimum.at(least, number, c["doc"][rows])
        out[rows] = c["doc"][rows] > least[number]
    return out


def _send(parts: list, buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Settles equal blocks within the gathered documents; what is open goes to the buckets, covered windows along with them."""
    c = {k: np.concatenate([p[i] for p in parts]) for i, (k, _) in enumerate(_COLUMNS)}
    covered = _covered(c)
    rows = []
    if covered.any():
        a = c["a"][covered].astype(np.int64)
        rows.append((turn % buckets, 1, _pack({"doc": c["doc"][covered], "crc": c["crc"][covered], "lo": a - c["lo"][covered], "hi": a - c["hi"][covered] + LENGTH}, _HITS)))
    c = {k: v[~covered] for k, v in c.items()}
    bucket = (c["gram"].astype(np.uint64) * _U(buckets) >> _U(32)).astype(np.int64)
    order = np.lexsort((c["a"], c["doc"], bucket))
    c, bucket = {k: v[order] for k, v in c.items()}, bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    rows += [(b, 0, _pack({k: v[cuts[b] : cuts[b + 1]] for k, v in c.items()}, _COLUMNS)) for b in range(buckets) if cuts[b] < cuts[b + 1]]
    for at in range(0, len(rows), 64):
        b, k, blob = zip(*rows[at : at + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int8()), pa.array(blob, pa.binary())], names=["bucket", "kind", "blob"])


def _gather(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Hashes(1)
        from pyspark import TaskContext

        parts, total, turn = [], 0, 7919 * TaskContext.get().partitionId()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                t = text.as_py()
                if len(t) < LENGTH:
                    continue
                crc = zlib.crc32(t)
                for a, lo, hi, *at in anchors(t, ids):
                    parts.append((*at, np.full(len(a), key.as_py(), np.int64), np.full(len(a), crc, np.uint32), a.astype(np.uint32), (a - lo).astype(np.uint8), (a - hi).astype(np.uint8)))
                    total += len(a)
                    if total >= FLUSH:
                        yield from _send(parts, buckets, turn)
                        parts, total, turn = [], 0, turn + 1
        if parts:
            yield from _send(parts, buckets, turn)
        parts.clear()
        trim()

    return docs.select("key", "bytes").mapInArrow(run, "bucket int, kind byte, blob binary")


_FOUND = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("crc", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _shared(c: dict, side: str) -> np.ndarray:
    """Rows whose bucket is still open after a round by this side's identifiers."""
    return refine(c["gram"], c[side], c["doc"])[1] & (c[side] != 0)


def _refine(gathered: DataFrame) -> DataFrame:
    """Buckets -> kind 1: covered bytes [lo, hi); kind 0: windows lo..hi that are to be compared one by one."""

    def run(table: pa.Table) -> pa.Table:
        kind, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        hits = _unpack([b for k, b in zip(kind, blobs, strict=True) if k == 1], _HITS)
        c = _unpack([b for k, b in zip(kind, blobs, strict=True) if k == 0], _COLUMNS)
        del blobs, table
        out = [(1, hits["doc"], hits["crc"], hits["lo"], hits["hi"])]
        if len(c["gram"]):
            a, covered = c["a"].astype(np.int64), _covered(c)
            out.append((1, c["doc"][covered], c["crc"][covered], (a - c["lo"])[covered], (a - c["hi"])[covered] + LENGTH))
            # of equal members the smallest document is left; it asks if another shares its bucket after one round
            c = {k: v[~covered] for k, v in c.items()}
            first, last = c["a"].astype(np.int64) - c["lo"], c["a"].astype(np.int64) - c["hi"]
            middle = c["a"].astype(np.int64) - _SIDE
            on_left, on_right = _shared(c, "left"), _shared(c, "right")
            first = np.where(on_left, first, np.maximum(first, middle))
            last = np.where(on_right, last, np.minimum(last, middle))
            asks = np.flatnonzero((on_left | on_right) & (first <= last))
            out.append((0, c["doc"][asks], c["crc"][asks], first[asks], last[asks]))
        del c, hits
        trim()
        return pa.Table.from_arrays([pa.array(np.concatenate([np.full(len(x[1]), x[0], np.int8) for x in out])), *[pa.array(np.concatenate([x[i].astype(np.int64) for x in out])) for i in (1, 2, 3, 4)]], schema=_FOUND)

    return gathered.groupBy("bucket").applyInArrow(run, "kind byte, key long, crc long, lo long, hi long")


def _strings(asked: DataFrame) -> DataFrame:
    """(key, crc, bytes, spans of windows) -> (h, h2, key, crc, at), a row for each window: its identifier, of the buckets at its offsets 0, SIDE and 2 SIDE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Hashes(2)
        for b in batches:
            for key, crc, text, spans in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                t, spans = text.as_py(), spans.values
                lo, hi = spans.field(0).to_numpy(), spans.field(1).to_numpy()
                n = hi - lo + 1
                p = np.unique(np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()))
                for s in range(int(p[0]), int(p[-1]) + 1, PIECE):
                    own = p[np.searchsorted(p, s) : np.searchsorted(p, s + PIECE)]
                    if not len(own):
                        continue
                    buf = t[s : s + PIECE + LENGTH]
                    at = own - s
                    b0, b1, b2 = (ids.grams(buf)[at + k] for k in (0, _SIDE, 2 * _SIDE))
                    h, h2 = mix(b0 * _U(3) + (b1 << _U(17) | b1 >> _U(47)) + b2 * _U(0x9E3779B97F4A7C15)), mix(b0 + b1 * _U(0xD6E8FEB86659FD93) + (b2 << _U(29) | b2 >> _U(35)))
                    m = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array((h2 >> _U(32)).astype(np.uint32).view(np.int32)), pa.array(np.full(m, key.as_py())), pa.array(np.full(m, crc.as_py())), pa.array(own)], names=["h", "h2", "key", "crc", "at"]
                    )

    return asked.select("key", "crc", "bytes", "spans").mapInArrow(run, "h long, h2 int, key long, crc long, at long")


def _keyed(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), data.alias("bytes"))


def covered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs(doc_id, text) -> (key, crc, spans array<struct<lo, hi>>): the bytes to be removed of a document, in pieces that may overlap."""
    keyed = _keyed(docs)
    # buckets of a size that a task can hold, however much text there is
    size = keyed.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(4 * max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-size * ANCHOR_BYTES // (16 * BUCKET_BYTES)))
    # a task for each bucket or so, however large the parts are that the map tasks send at once
    found = scratch.write(_refine(_gather(keyed, buckets).repartition(buckets, "bucket")))
    spans = lambda df: df.groupBy("key", "crc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    asks = spans(found.where("kind = 0"))
    texts = keyed.withColumn("crc", F.crc32("bytes"))
    # rows that agree in doc_id and text have one answer
    strings = _strings(texts.join(asks, ["key", "crc"]).select("key", "crc", "bytes", "spans"))
    least = F.min("key").over(Window.partitionBy("h", "h2"))
    late = strings.withColumn("least", least).where("key > least").select("key", "crc", F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi"))
    late = scratch.write(late)
    return spans(found.where("kind = 1").select("key", "crc", "lo", "hi").union(late))


def _merge(spans: pa.Scalar, n: int) -> list[tuple[int, int]]:
    if not spans.is_valid or not len(spans.values):
        return []
    lo, hi = spans.values.field(0).to_numpy(), np.minimum(spans.values.field(1).to_numpy(), n)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    starts = np.flatnonzero(new)
    ends = np.concatenate((starts[1:] - 1, [len(lo) - 1]))
    return list(zip(lo[starts].tolist(), hi[ends].tolist(), strict=True))


def remove(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept binary)."""
    scratch = Scratch(docs.sparkSession)
    texts = _keyed(docs).withColumn("crc", F.crc32("bytes"))
    joined = texts.join(covered(docs, scratch), ["key", "crc"], "left").select("doc_id", "bytes", "spans")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                t = text.as_py()
                cut = _merge(spans, len(t))
                ends = [0, *[h for _, h in cut]]
                starts = [*[s for s, _ in cut], len(t)]
                rows.append((len(t), sum(h - s for s, h in cut), len(cut), b"".join(t[x:y] for x, y in zip(ends, starts, strict=True))))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
