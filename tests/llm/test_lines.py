import random

from searchloom.llm import line_dedup as ld
from searchloom.llm.queries import op4_lines

from .helpers import SF, docs_df, roots


def brute(docs):
    """docs of (doc_id, text): numbers of the non-blank lines that stay, per document."""
    occ = [(i is None, i or 0, p, line) for i, t in docs for p, line in enumerate((t or "").split("\n")) if line.strip(" \t\r\x0b\x0c")]
    occ.sort(key=lambda o: o[:3])
    lines = list(dict.fromkeys(o[3] for o in occ))
    sets = [ld.shingles(x) for x in lines]
    want = roots(len(lines), [(a, b) for a in range(len(lines)) for b in range(a) if sets[a] & sets[b] and ld.similarity(sets[a], sets[b]) >= 0.8])
    root, first = dict(zip(lines, want, strict=True)), {}
    for n, i, p, line in occ:
        first.setdefault(root[line], (None if n else i, p))
    kept = {}
    for i, p in first.values():
        kept.setdefault(i, []).append(p)
    return {k: sorted(v) for k, v in kept.items()}


def test_whole_query_against_brute_force(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.kept for r in ld.report(df).collect()}
    assert sum(got[i] == want.get(i, []) for i in got) >= 0.99 * len(got)
    assert op4_lines(spark, SF).count() == len(docs)


def test_long_lists_lose_no_component(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(160)) for _ in range(3)]
    docs = []
    for i in range(400):
        s = list(base[i % 3])
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(160)] = rng.choice("xyz")
        docs.append((i, "".join(s) + "\n" + str(i) * 3))
    want = brute(docs)
    df = docs_df(spark, [(i, t, "s") for i, t in docs])
    for cap in (3, 64):
        got = {r.doc_id: r.kept for r in ld.report(df, list_cap=cap).collect()}
        assert got == {i: want.get(i, []) for i, _ in docs}


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, " \t\n\n"), (4, "ab"), (5, "ab\nab\ncd"), (5, "ab\nab\ncd"), (None, "ab\nnew line here"), (6, "q" * 200_000 + "\n" + "z " * 90_000), (7, "q" * 200_000)]
    df = docs_df(spark, [(i, t, "s") for i, t in docs])
    rows = ld.report(df).collect()
    assert len(rows) == len(docs)
    got = {r.doc_id: (r.n_lines, r.n_blank, r.n_kept, r.n_removed) for r in rows}
    assert got == {1: (0, 0, 0, 0), 2: (1, 1, 0, 0), 3: (3, 3, 0, 0), 4: (1, 0, 1, 0), 5: (3, 0, 1, 2), None: (2, 0, 1, 1), 6: (2, 0, 2, 0), 7: (1, 0, 0, 1)}
    out = ld.dedup(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.where("doc_id in (3, 5)").collect()} == {3: " \t\n\n", 5: "cd"}
    assert ld.report(df.limit(0)).count() == 0
