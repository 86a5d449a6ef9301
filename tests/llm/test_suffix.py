import hashlib
import random

import numpy as np
from searchloom.llm import suffix_dedup as sx
from searchloom.llm.queries import op7_suffixes
from pyspark.sql import functions as F

from .helpers import SF, docs_df


def brute(docs, length=50):
    """docs of (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept)."""
    first = {}
    key = lambda i: (i is None, i or 0)
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s not in first or key(i) < first[s]:
                first[s] = key(i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def test_whole_query(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((i, n, r, s, hashlib.sha256(k).hexdigest()) for i, n, r, s, k in brute(docs))
    got = sorted(tuple(r) for r in op7_suffixes(spark, SF).collect())
    assert got == want and any(r for _, _, r, _, _ in want)


def test_planted_overlaps_small_pieces_and_flushes(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    shared = [word(rng.randint(40, 130)) for _ in range(6)]
    docs = [(i * 3 % 61, word(rng.randint(0, 90)) + rng.choice(shared) + word(rng.randint(0, 40)) + rng.choice(shared)[: rng.randint(30, 90)]) for i in range(61)]
    docs += [(70, "ab" * 400), (71, "ab" * 90 + shared[0]), (72, shared[0][:49])]
    df = docs_df(spark, [(i, t, "s") for i, t in docs]).repartition(5)
    got = sorted(tuple(r) for r in sx.remove(df).collect())
    assert [(a, b, c, d, bytes(e)) for a, b, c, d, e in got] == sorted(brute(docs))


def test_pieces_of_a_long_text():
    rng = random.Random(2)
    t = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    whole = list(sx.anchors(t, sx.Hashes(1)))
    old, sx.PIECE = sx.PIECE, 300
    try:
        parts = list(sx.anchors(t, sx.Hashes(1)))
    finally:
        sx.PIECE = old
    at = lambda ps: {(int(a), w, *map(int, ids)) for p in ps for a, lo, hi, *ids in zip(*p) for w in range(lo, hi + 1)}  # noqa: E731, B905
    assert len(parts) > 5 and at(whole) == at(parts) and {x[1] for x in at(whole)} == set(range(len(t) - 49))


def test_rounds_one_by_one():
    """After each round, members of a bucket agree in what its identifiers stand for, and no others do; open ones have several documents."""
    rng = random.Random(8)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randint(60, 110))) for _ in range(6)]
    texts = [(rng.choice(base)[rng.randint(0, 20) :] + rng.choice(base)[: rng.randint(20, 90)]).encode() for _ in range(80)]
    rows = []
    for d, t in enumerate(texts):
        if len(t) >= 50:
            for p in sx.anchors(t, sx.Hashes(1)):
                rows += [(d, t, int(a), *map(int, ids)) for a, _, _, *ids in zip(*p)]  # noqa: B905
    doc = np.array([r[0] for r in rows])
    number, open_ = sx.refine(np.array([r[3] for r in rows], np.uint32), np.zeros(len(rows), np.uint8), doc)
    sides = lambda t, a: [t[a + 15 : a + 35] if a + 35 <= len(t) else None, (t[max(0, min(a + 30, len(t) - 20)) :][:20], min(len(t) - 20 - a, 30)), t[a - 15 : a + 5] if a >= 15 else None, (t[max(0, a - 30) :][:20], min(a, 30))]
    known = [(t[a : a + 20],) for _, t, a, *_ in rows]
    for k in range(-1, 4):
        if k >= 0:
            number, open_ = sx.refine(number, np.array([r[4 + k] for r in rows], np.uint32), doc)
            known = [(*old, sides(t, a)[k]) for old, (_, t, a, *_) in zip(known, rows, strict=True)]
        groups = {}
        for n, what, d, o in zip(number.tolist(), known, doc.tolist(), open_.tolist(), strict=True):
            groups.setdefault(n, set()).add((what, o))
            groups.setdefault(("docs", n), set()).add(d)
        buckets = [n for n in groups if not isinstance(n, tuple)]
        assert len(buckets) == len(set(known)) and all(len(groups[n]) == 1 for n in buckets)
        assert all(next(iter(groups[n]))[1] == (len(groups["docs", n]) > 1) for n in buckets)


def test_awkward_rows(spark):
    a = "the quick brown fox jumps over the lazy dog again and again, says a"
    docs = [(1, None), (2, ""), (3, a), (3, a), (3, a + "!"), (None, a), (None, a + a), (5, a[:49]), (6, "x" + a + "y" + a)]
    df = docs_df(spark, [(i, t, "s") for i, t in docs]).withColumn("key", F.lit(1))
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r[0], *r[1:4], bytes(r[4])) for r in sx.remove(df).collect()), key=order)
    assert got == sorted(brute(docs), key=order)
    assert sx.remove(df.limit(0)).count() == 0
    assert sx.remove(df.where("doc_id <= 2")).count() == 2
