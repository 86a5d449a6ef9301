import re
from collections import defaultdict

import pytest

from searchloom.llm import mixing
from searchloom.llm.queries import op3_mix
from pyspark.sql import functions as F

from .helpers import SF, docs_df


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in list(open_):
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_words(spark):
    rows = {r.doc_id: r for r in op3_mix(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    per = defaultdict(int)
    taken = defaultdict(int)
    for d in docs:
        per[d.source] += size[d.doc_id]
        taken[d.source] += rows[d.doc_id].taken
    target = brute_targets(per)
    for d in docs:
        r = rows[d.doc_id]
        assert r.size == size[d.doc_id] and r.source_size == per[d.source] and r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[d.source])
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(1, 0.5 * max(size[d.doc_id] for d in docs if d.source == s))


def test_many_units_in_one_source(spark):
    df = docs_df(spark, [(i, "w " * (i % 50 + 1), "a" if i % 3 else "b") for i in range(3000)])
    out = mixing.mix(df).collect()
    again = {(r.doc_id, r.copies) for r in mixing.mix(df.repartition(3)).collect()}
    assert again == {(r.doc_id, r.copies) for r in out} and len(out) == 3000
    for s in "ab":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 25


def test_rounding_keeps_expectations(spark):
    df = docs_df(spark, [(i, "w " * 10, "a") for i in range(400)]).withColumn("unit", F.col("doc_id"))
    total = 0
    for seed in range(3):
        units = df.select(F.lit(1).cast("long").alias("group"), "unit", F.lit(0.25).alias("p"), F.lit(10).cast("long").alias("size"))
        from searchloom.llm.common import Scratch

        total += mixing.round_units(units, Scratch(spark), seed).agg(F.sum("extra")).first()[0]
    assert total == 300


def test_awkward_rows(spark):
    df = docs_df(spark, [(1, None, "a"), (2, "", None), (3, "x y", None), (3, "x y", None), (None, "z " * 9, "a"), (4, " \t\n", "b")])
    got = mixing.mix(df).collect()
    assert sum(r["rows"] for r in got) == 6
    assert all(r.copies * r.size <= 2 * r.size for r in got)
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
