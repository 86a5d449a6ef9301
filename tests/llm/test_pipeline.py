import re

import corpus_pipeline as cp
from searchloom.llm import toxicity
from searchloom.llm.common import Scratch

from .helpers import SF, docs_df
from .test_decontaminate import brute as hits
from .test_mixing import brute_targets
from .test_near_copies import stays
from .test_tokens import brute as tokens


def test_stages_against_brute_force(spark):
    docs, s, columns = spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark), None
    items = [(b.item_id, b.text) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for (name, stage), kind in zip(cp.STAGES, ("tox", "sim", "dec", "mix", "ids"), strict=True):
        rows = docs.collect()
        columns = columns or docs.columns
        out = s.write(stage(spark, docs, SF))
        got = out.collect()
        ids = sorted(r.doc_id for r in got)
        if kind == "tox":
            model = toxicity.learn(toxicity.training(docs, spark.read.parquet(f"{SF}/labels.parquet")))
            assert ids == sorted(r.doc_id for r in rows if model.score(model.features(r.text)) < 0.7) and len(ids) > 0.7 * len(rows)
        if kind == "sim":
            assert ids == stays(sorted((r.doc_id, r.text) for r in rows))
        if kind == "dec":
            assert ids == sorted(i for i, _, h, _ in hits([(r.doc_id, r.text) for r in rows], items) if not h)
        if kind == "mix":
            size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            per = {}
            for r in rows:
                per[r.source] = per.get(r.source, 0) + size(r)
            for src, t in brute_targets(per).items():
                assert abs(sum(size(r) for r in got if r.source == src) - t) <= 0.5 * max(size(r) for r in rows if r.source == src)
            assert max(map(ids.count, ids)) <= 2
        if kind == "ids":
            assert sorted(tuple(r) for r in got) == sorted(tokens([(r.doc_id, r.text) for r in rows]))
        else:
            assert out.columns == columns
        docs = out


def test_awkward_rows(spark):
    docs = docs_df(spark, [(1, None, None), (1, None, None), (None, "", "a"), (2, "a b c d e", "a"), (2, "f g h i j", "b")])
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(cp.STAGES) - 1 or out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
