import random
import re

from searchloom.llm import decontaminate as dc
from searchloom.llm.common import Scratch
from searchloom.llm.queries import op2_decontaminate
from pyspark.sql import functions as F

from .helpers import SF, docs_df

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, s in items:
            iw = words(s)
            n = min(10, len(iw))
            wins = {tuple(iw[a : a + n]) for a in range(len(iw) - n + 1)} if n else set()
            for a in range(len(w) - n + 1 if n else 0):
                if tuple(w[a : a + n]) in wins:
                    hit.update(range(a, a + n))
                    found.add(str(k))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_whole_query_on_planted_rows(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(b.item_id, b.text) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in op2_decontaminate(spark, SF).collect())
    want = sorted((i, n, h, len(f)) for i, n, h, f in brute(docs, items))
    assert got == want and any(h for _, _, h, _ in want)


def test_awkward_rows(spark):
    items = [(1, "a b c"), (2, "x"), (3, None), (4, "..."), (5, " ".join("abcdefghijklm")), (6, "x"), (7, "é É a a a a a a a a a a a a")]
    docs = [(1, "A b C d, x"), (2, None), (3, ""), (4, "z A B C D E F G H I J K L M N"), (4, "x"), (5, "a b a b c a b c " + "q " * 30_000 + "x"), (None, "é É a a a a a a a a a a a a a"), (6, "É é a a a a a a a a a a a"), (6, "É é a a a a a a a a a a a")]
    df = docs_df(spark, [(i, t, "s") for i, t in docs])
    bench = spark.createDataFrame([*items], "item_id long, text string").withColumn("doc", F.lit(3))
    got = sorted(((r.doc_id or 0), r.n_words, r.n_hit, list(r["items"])) for r in dc.scan(df, bench).collect())
    assert got == sorted(((i or 0), n, h, f) for i, n, h, f in brute(docs, items))
    assert dc.scan(df.limit(0), bench).count() == 0
    assert [r.n_hit for r in dc.scan(df, bench.limit(0)).collect()] == [0] * len(docs)
    kept = dc.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, h, _ in brute(docs, items) if not h)


def test_rows_that_share_an_item_id_and_null_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(12)) for c in "abc")
    # the first row's words occur nowhere in the documents, so they are rarest
    items = [(1, one), (1, two), (1, two), (None, three), (None, "only " + three), (2, "c0 c1")]
    docs = [(1, "q " + two + " q"), (2, "q " + three), (3, "q q"), (4, two + " " + three)]
    df, bench = docs_df(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_hit, list(r["items"])) for r in dc.scan(df, bench).collect())
    assert got == [(1, 12, ["1"]), (2, 12, ["2", None]), (3, 0, []), (4, 24, ["1", "2", None])]
    assert [r.doc_id for r in dc.clean(df, bench).collect()] == [3]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha q beta"), (2, "beta q q q alpha"), (3, "alpha " + "q " * 9 + "beta"), (4, "alpha")], "doc long, text string").withColumn("doc_id", F.col("doc"))
    items = spark.createDataFrame([("i", "alpha beta")], "item string, text string")
    index = dc.build(docs, items, Scratch(spark))
    assert sorted((r.doc, r["first"], r["last"]) for r in dc.near(index, 3).collect()) == [(1, 0, 2), (2, 0, 4)]


def test_proximity_of_three_and_more_terms_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["beta q alpha q q beta gamma", *(" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "q", "r"], k=25)) for _ in range(30))]
    items = {"three": "alpha beta gamma", "four": "delta beta alpha gamma"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").withColumn("doc_id", F.col("doc"))
    index = dc.build(docs, spark.createDataFrame(list(items.items()), "item string, text string"), Scratch(spark))
    df = {r.word: 0 for r in index.items.collect()}
    term = {r.word: r.term for r in index.items.collect()}
    for w in df:
        df[w] = sum(t.split().count(w) for t in texts)
    want = set()
    for name, s in items.items():
        need, span = set(s.split()), len(s.split()) + 3
        rare = min(need, key=lambda w: (df[w], term[w]))
        for d, t in enumerate(texts):
            w = t.split()
            for at in (i for i, x in enumerate(w) if x == rare):
                fits = [(b - a, a, b) for a in range(at + 1) for b in range(at, len(w)) if b - a < span and need <= set(w[a : b + 1])]
                if fits:
                    want.add((d, name, *min(fits)[1:]))
    got = dc.near(index, 3).collect()
    assert {(r.doc, r["item"], r["first"], r["last"]) for r in got} == want and len(got) == len(want)
    assert (0, "three", 2, 6) in want
