import random

import corpus_pipeline as cp
import pytest
from searchloom.llm import near_copies as nc

from .helpers import SF, docs_df, roots


def shingles(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def stays(rows):
    """Ids of the first document of each component of Jaccard >= 0.8; rows of (doc_id, text) by doc_id."""
    sets, links = [shingles(t) for _, t in rows], []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both * 5 >= 4 * (len(a) + len(b) - both):
                links.append((i, j))
    root = roots(len(rows), links)
    return [r[0] for k, r in enumerate(rows) if root[k] == k]


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_stage_drops_near_copies_not_only_exact_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((d.doc_id, d.text) for d in docs.select("doc_id", "text").collect())
    want, got = stays(rows), sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, sf).collect())
    assert got == want and len(want) < len({frozenset(shingles(t)) for _, t in rows})


@pytest.mark.parametrize("cap", [0, 2, 5, 64])
def test_long_lists_and_borderline_pairs(spark, monkeypatch, cap):
    monkeypatch.setattr(nc, "BLOCK", 7)
    rng, rows = random.Random(4), []
    common = " ".join(f"c{i}" for i in range(30))
    for base in range(6):
        words = [f"w{base}x{i}" for i in range(60)]
        for _ in range(12):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(w) + " " + common if base % 2 else " ".join(w)))
    rows += [(len(rows) + i, f"u{i} " + common) for i in range(3)]
    # 9 shingles and 8 of them, 0.889; 5 and 4, exactly 0.8; 4 and 3, 0.75
    rows += [(len(rows) + i, " ".join(f"{s}{k}" for k in range(n))) for i, (s, n) in enumerate((("p", 13), ("p", 12), ("q", 9), ("q", 8), ("r", 8), ("r", 7)))]
    got = sorted(r.doc_id for r in nc.dedup(docs_df(spark, [(i, t, "s") for i, t in rows]), list_cap=cap).collect())
    assert got == stays(rows)


def test_fingerprints_link_first_and_prefixes_complete(spark, monkeypatch):
    """The stage's links come from the byte-position index, as far as that finds them, and only pairs left apart are completed."""
    import numpy as np
    from searchloom.llm import simhash_dedup as sd

    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    of = {}
    for r in docs.select("text").collect():
        ids = nc.shingle_ids(r.text)
        of[nc.xxhash.xxh64_intdigest(ids.tobytes())] = (set(ids.tolist()), sum(1 << b for b in range(64) if 2 * int((ids >> np.uint64(b) & np.uint64(1)).sum()) > len(ids)))
    want = set()
    for a, (s, x) in of.items():
        for b, (t, y) in of.items():
            if a < b and (x ^ y).bit_count() <= 4 and 5 * len(s & t) >= 4 * len(s | t):
                want.add((a, b))
    seen, verify = [], nc._verify
    monkeypatch.setattr(nc, "_verify", lambda asked, *more: (seen.append({tuple(sorted(v % (1 << 64) for v in r)) for r in asked.collect()}), verify(asked, *more))[1])
    cp.drop_near_copies(spark, docs, SF).count()
    by_index, completed = seen
    assert want and want <= by_index and not want & completed
    for bits in (2, 4):
        assert all(any(set(k) <= set(p) for k in sd._keys(bits)) for p in __import__("itertools").combinations(range(8), 8 - bits))


def test_awkward_rows(spark):
    df = docs_df(spark, [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one two", "a"), (4, "one two", "a"), (None, "One TWO", "a"), (5, "a b c d e", "b"), (6, "a b c d e f", "b"), (None, None, None)])
    out = nc.dedup(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 4, 5, 6]
    assert nc.dedup(df.limit(0)).count() == 0
