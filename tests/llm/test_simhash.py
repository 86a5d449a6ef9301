import random

import xxhash

from searchloom.llm import simhash_dedup as sd
from searchloom.llm.common import Scratch, components
from searchloom.llm.queries import op8_simhash

from .helpers import SF, docs_df, roots


def brute(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_whole_query(spark):
    docs = sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    fps = [brute(t) for _, t in docs]
    n = len(docs)
    want = roots(n, [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    got = {r.doc_id: r for r in op8_simhash(spark, SF).collect()}
    for k, (i, _) in enumerate(docs):
        assert got[i].fingerprint == f"{fps[k]:016x}" and got[i].component_id == docs[want[k]][0]


def test_lists_over_the_cap_give_the_same_components(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:12]:
        for _ in range(25):
            x = f
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2])
    for cap in (0, 3, 1000):
        s = Scratch(spark)
        got = {r.node: r.component for r in components(sd.links(df, s, list_cap=cap), s).collect()}
        assert [got.get(x, x) for x in fps] == [fps[k] for k in want]


def test_awkward_rows(spark):
    long = "w" * 100_000 + " a b c" * 20_000
    df = docs_df(spark, [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one two", "a"), (4, "one two", "a"), (None, "One TWO", "a"), (5, long, "b"), (None, None, None)])
    got = sd.groups(df).collect()
    assert len(got) == 8
    by = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in got)
    assert by == [(-1, 1), (-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5)]
    assert sd.groups(df.limit(0)).count() == 0
    assert sd.fingerprint(long) == brute(long)
    assert sd.dedup(df).columns == df.columns and sorted(r.doc_id for r in sd.dedup(df).collect()) == [1, 4, 5]


def test_components_with_hubs(spark, monkeypatch):
    """Stars, chains and rings, with nodes over and under the bound from which neighbours are dealt."""
    from searchloom.llm import common

    from .helpers import roots

    rng = random.Random(6)
    links = [(0, i) for i in range(1, 120)] + [(500 + i, 501 + i) for i in range(40)] + [(119, 700 + i) for i in range(60)] + [(rng.randrange(900, 1000), rng.randrange(900, 1000)) for _ in range(60)]
    want = {k: r for k, r in enumerate(roots(1000, links)) if r != k}
    edges = spark.createDataFrame(links, "src long, dst long")
    for hub, hubs in ((10, 1000), (10, 2), (10_000, 10)):
        monkeypatch.setattr(common, "HUB", hub)
        monkeypatch.setattr(common, "HUBS", hubs)
        assert {r.node: r.component for r in common.components(edges, common.Scratch(spark)).collect()} == want
