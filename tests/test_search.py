import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from searchloom.operators import maintain, snippet
from searchloom.operators.index import StoredIndex
from searchloom.operators.match import Phrase, phrase
from searchloom.plans import search as S
from searchloom.plans.query import SearchQuery as Q
from searchloom.plans.query import parse

SCHEMA = "root string, path string, name string, ext string, size long, modified_time long, content string"


def files(spark, rows):
    out = []
    for path, content, size, when in rows:
        name = path.replace("\\", "/").rsplit("/", 1)[-1]
        root = path[:2] if path[1:2] == ":" else "/" + path.split("/")[1]
        out.append((root, path, name, "." + name.rsplit(".", 1)[1] if "." in name[1:] else "", size, when, content))
    return spark.createDataFrame(out, SCHEMA)


def paths(docs, q):
    return [r.path for r in S.search(docs, q).collect()]


def test_browse_and_names(spark):
    d = files(spark, [("/d/Practicum1.docx", "", 100, 1000), ("/d/report.pdf", "", 200, 2000), ("/d/sub/practicum2.txt", "", 50, 3000), ("/d/notes.txt", "", 10, 4000)])
    assert set(paths(d, Q("practicum"))) == {"/d/Practicum1.docx", "/d/sub/practicum2.txt"}
    assert paths(d, Q(sort_field="size", descending=True))[0::3] == ["/d/report.pdf", "/d/notes.txt"]
    assert len(paths(d, Q(limit=1, offset=1))) == 1
    assert S.count(d, Q("", limit=1)).collect()[0].n == 4
    new = maintain.upsert(d, files(spark, [("/d/notes.txt", "", 999, 5000)]))
    assert new.count() == 4 and new.where("size = 999").count() == 1


def test_operators(spark):
    d = files(spark, [("D:\\Work\\report.docx", "quarterly report draft", 1, 1), ("D:\\Work\\final.docx", "quarterly report final version", 1, 1), ("D:\\Work\\report.pdf", "quarterly report", 1, 1), ("D:\\Personal\\report.docx", "quarterly report", 1, 1)])
    n = lambda q: len(paths(d, Q(q)))
    assert [n("quarterly -draft"), n("quarterly ext:pdf"), n("quarterly path:d:\\work"), n('"report final"'), n("ext:pdf"), n("-draft")] == [3, 1, 3, 1, 1, 3]
    assert n("quarterly -draft -final") == 4 and n("quarterly -quart -final") == 3 and n("!!!") == 0 and n("quarterly -!!!") == 4
    assert len(paths(d, Q("quarterly -draft -final", exclude_any=True))) == 2


def test_forms_and_exact_words(spark):
    d = files(spark, [("/d/a.txt", "«Михайлов Евгений» подписал ещё один договор", 1, 1), ("/d/b.txt", "Михайлова Евгения и Михайленко Евгения", 1, 1), ("/d/c.txt", "МИХАЙЛОВ - заглавными буквами", 1, 1)])
    exact = lambda q: sorted(p[3] for p in paths(d, Q(q, exact_words=True)))
    assert exact("Михайлов") == ["a", "c"] and exact("евгения михайлова") == ["b"] and len(exact("еще")) == len(exact("ЕЩЁ")) == 1 and exact("Михайл") == []
    assert {"/d/a.txt", "/d/b.txt"} <= set(paths(d, Q("Михайлов")))
    assert "[Михайлов]" in S.snippet_of(d, "/d/a.txt", Q("Михайлов", exact_words=True)) and "[" not in S.snippet_of(d, "/d/b.txt", Q("Михайлов", exact_words=True))
    assert "[договор]" in S.snippet_of(d, "/d/a.txt", Q("договоры"))
    assert S.snippet_of(d, "/d/none", Q("x")) == "" and S.snippet_of(d, "/d/a.txt", Q("-x")) == ""
    e = files(spark, [("/d/instructions.txt", "Инструкция к практикуму номер один", 1, 1), ("/d/unrelated.txt", "just some unrelated english text", 1, 1)])
    assert paths(e, Q("практикума")) == ["/d/instructions.txt"] and paths(e, Q("unrelated")) == ["/d/unrelated.txt"]
    page = S.search(e, Q("практикума", with_snippets=True)).collect()
    assert page[0].snippet == "Инструкция к [практикуму] номер один"


def test_filters(spark):
    d = files(spark, [(f"/d/{n}", "отчёт", 1, w) for n, w in (("отчёт.docx", 1000), ("Отчёт.DOC", 5000), ("отчёт.xlsx", 9000), ("отчёт.pdf", 20000))])
    n = lambda **a: len(paths(d, Q(**a)))
    assert n(pattern="отчёт", exact_words=True) == 4 and n(pattern="отчёт", exact_words=True, extensions=(".doc", ".docx")) == 2
    assert n(modified_since=9000) == 2 and n(pattern="отчёт ext:pdf", extensions=(".xlsx", ".pdf")) == 1 and n(pattern="отчёт ext:docx", extensions=(".xlsx", ".pdf")) == 0
    assert n(extensions=(".pdf", ".xlsx")) == 2 and n(pattern="отчет", modified_since=4000) == 3


def test_sources_merge_in_order(spark):
    d = files(spark, [("C:/alpha.txt", "", 1, 1), ("C:/charlie.txt", "", 1, 1), ("D:/bravo.txt", "", 1, 1), ("D:/delta.txt", "", 1, 1)])
    assert [p[3:] for p in paths(d, Q(sort_field="name"))] == ["alpha.txt", "bravo.txt", "charlie.txt", "delta.txt"]
    assert [p[3:] for p in paths(d, Q(sort_field="name", limit=2, offset=1))] == ["bravo.txt", "charlie.txt"]
    assert len(paths(d, Q(roots=("C:",)))) == 2


def _random_docs(seed, n=120):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "be", "cafe"]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", ". ", ": ", ", ", "\n", "-"]) for _ in range(rng.randint(0, k)))
    return [(i, f"{rng.choice(words)}_{i}", text(40)) for i in range(n)]


def _fts(docs):
    c = sqlite3.connect(":memory:")
    try:
        c.execute("create virtual table t using fts5(name, content)")
    except sqlite3.OperationalError:
        pytest.skip("sqlite3 without FTS5")
    c.executemany("insert into t(rowid, name, content) values (?, ?, ?)", docs)
    return c


QUERIES = ["alpha", '"alpha beta"', "be gamma", '"gamma" "delta"', "alpha -beta", "alph_1", "alpha -beta -gamma"]


def _match(raw):
    p = parse(raw)
    term = lambda t: '"' + t.text.replace('"', '""') + '"' + ("" if t.phrase else "*")
    return " AND ".join(map(term, p.wanted)), " AND ".join(map(term, p.unwanted))


def test_scores_equal_fts5(spark, tmp_path):
    docs = _random_docs(1)
    c = _fts(docs)
    d = spark.createDataFrame([("/r", str(i), n, "", 1, 1, t) for i, n, t in docs], SCHEMA)
    StoredIndex.build(d, str(tmp_path / "i"))
    index = StoredIndex.open(spark, str(tmp_path / "i"))
    for raw in QUERIES:
        good, bad = _match(raw)
        sql = "select rowid, bm25(t, 10.0, 1.0) from t where t match ?" + (" and rowid not in (select rowid from t where t match ?)" if bad else "")
        want = {i: s for i, s in c.execute(sql, [good, bad] if bad else [good])}
        got = {int(r.path): r.relevance_score for r in S.matches(d, Q(raw)).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in got), raw
        page = lambda rows: [(r.path, round(r.relevance_score, 6)) for r in rows.collect()]
        assert page(S.search_stored(index, d, Q(raw, limit=20, offset=3))) == page(S.search(d, Q(raw, limit=20, offset=3))), raw
        if not bad:
            stored = {int(r.path): r.relevance_score for r in index.score([phrase(t, False) for t in parse(raw).wanted]).collect()}
            assert stored.keys() == want.keys() and all(stored[i] == pytest.approx(want[i], abs=1e-6) for i in stored), raw


def test_excerpts_equal_fts5():
    docs = _random_docs(2, 400)
    c = _fts(docs)
    n = 0
    for raw in QUERIES[:4] + ['"beta" alphab']:
        ps = [phrase(t, False) for t in parse(raw).wanted]
        for i, s in c.execute("select rowid, snippet(t, 1, '[', ']', '...', 12) from t where t match ?", [_match(raw)[0]]):
            assert snippet.forms(docs[i][2], ps) == s, (raw, docs[i])
            n += 1
    assert n > 300


def test_exact_excerpts():
    one = [Phrase(("hit",))]
    text = " ".join(f"w{i}" for i in range(30))
    assert snippet.exact(text, one) == " ".join(f"w{i}" for i in range(17)) + "..."
    long = " ".join([*(f"a{i}" for i in range(9)), "HIT", *(f"b{i}" for i in range(20))])
    assert snippet.exact(long, one) == "...a4 a5 a6 a7 a8 [HIT] " + " ".join(f"b{i}" for i in range(12)) + "..."
    assert snippet.exact("x hit y", one) == "x [hit] y" and snippet.exact("", one) == ""


def test_plan_reads_what_it_needs(spark, tmp_path):
    d = files(spark, [(f"/d/f{i}.txt", "x y", i, i) for i in range(50)])
    d.write.parquet(str(tmp_path / "d"))
    plan = S.search(spark.read.parquet(str(tmp_path / "d")), Q(sort_field="modified", modified_since=40))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(modified_time,40)" in plan and "TakeOrderedAndProject" in plan


def test_a_search_scans_and_splits_once(spark, tmp_path):
    d = files(spark, [(f"/d/f{i}.txt", "of the x" if i % 3 else "y", i, i) for i in range(50)])
    d.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for q in ('"of the"', "x -y", "of the", "ext:txt x"):
        found = S.search(docs, Q(q))
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
        assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1
        assert plan.count("split(") == 4  # the name and the content, each in the branch for ASCII and the one for other texts
    plan = S.count(docs, Q("x ext:txt"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_index_kept_current(spark, tmp_path):
    """Upserts, removals, whole folders, compaction and failed writes against an index of the final documents."""
    rng = random.Random(3)
    rows = lambda ids, salt: [("/r" + str(i % 2), f"/r{i % 2}/{'a' if i % 3 else 'b'}/{i}", f"{i}.txt", ".txt", 1, 1, " ".join(random.Random(i * 7 + salt).choices(["alpha", "beta", "gamma", "alphabet"], k=6))) for i in ids]
    state = {r[1]: r for r in rows(range(40), 0)}
    make = lambda r: spark.createDataFrame(list(r), SCHEMA)
    index = StoredIndex.build(make(state.values()), str(tmp_path / "i"))
    for step in range(3):
        new = rows(rng.sample(range(60), 12), step + 1)
        gone = rng.sample(sorted(state), 5)
        keys = spark.createDataFrame([(state[p][0], p) for p in gone if p not in {r[1] for r in new}], "root string, path string")
        index.upsert(make(new), keys)
        for p in gone:
            state.pop(p, None)
        state |= {r[1]: r for r in new}
        if step == 1:
            n = index.remove_under("/r1", "/r1/b/")
            under = [p for p in state if p.startswith("/r1/b/")]
            assert n == len(under)
            for p in under:
                state.pop(p)
        if step == 2:
            (tmp_path / "i" / "postings" / "gen=9").mkdir()  # a write that never came to its end
            before = len(index.generations)
            index.compact()
            assert before > 3 and len(index.generations) == 1
        whole = StoredIndex.build(make(state.values()), str(tmp_path / f"w{step}"))
        again = StoredIndex.open(spark, str(tmp_path / "i"))
        for ix in (index, again):
            for p in (Phrase(("alpha",), True), Phrase(("beta", "gamma"))):
                tell = lambda x, p=p: sorted((r.path, round(r.relevance_score, 9)) for r in x.score([p]).collect())
                assert tell(ix) == tell(whole)
            assert sorted(map(tuple, ix.sources().collect())) == sorted(map(tuple, whole.sources().collect()))
            assert sorted(map(tuple, ix.documents().collect())) == sorted(map(tuple, whole.documents().collect()))
    index.remove(make(state.values()).select("root", "path"))
    assert index.documents().count() == 0 and index.sources().count() == 0


def test_index_rows_and_words(spark, tmp_path, monkeypatch):
    """Words of whole texts as the analyzers split them, in rows far fewer than words; documents that share a number get others; compaction keeps no list of what is gone."""
    import unicodedata

    from searchloom.functions import analysis
    from searchloom.operators import index as ix

    common = [c for c in map(chr, range(0x10000)) if not re.match("[^" + analysis.COMMON + "]", c)]
    assert len(common) > 1500 and all(bool(analysis.pieces(c, False)) == (unicodedata.category(c)[0] in "LNM" or unicodedata.category(c) == "Co") for c in common)
    odd = ["", "_a_b", "É\u0301te\u0301 \u0301 x", "Ёлки ёлками и читали", "ΣΑΣ İstanbul", "日本 語", "a\U0001f600b ½ ²", "ǅ ß ﬁ", "\u0483 x\u0483y", "tab\tnew\nline\x1cq", "\ud7ff\ue000z", *(f"a{c}B" for c in common if c > "\x7f")]
    rng = random.Random(5)
    lines = [" ".join(rng.choice(odd) for _ in range(8)) for _ in range(40)] + odd + [None] + [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(60)]
    d = spark.createDataFrame([("/a" if k % 3 else None if k % 2 else "/b", str(k), f"N_{k}.txt", t) for k, t in enumerate(lines)], "root string, path string, name string, content string").coalesce(2).cache()
    for exact in (False, True):
        w = [(r.path, r.n, r.c) for r in d.select("path", analysis.analyze(F.col("name"), exact).alias("n"), analysis.analyze(F.col("content"), exact).alias("c")).collect()]
        want = {(p, i, k, t) for p, *cols in w for i, ts in enumerate(cols) for k, t in enumerate(ts)}
        rows = ix.postings_of(d, exact).collect()
        path = {r.doc: r.path for r in rows if r.first is None}
        got = set()
        for r in rows:
            if r.first is not None:
                each, cols, place, counts, pos = map(list, ix._unpacked(r.data))
                for t, n, c in zip(r.terms.split(" "), each, cols, strict=True):
                    for _ in range(n):
                        got |= {(path[r.docs[place[0]]], c, p, t) for p in pos[: counts[0]]}
                        pos, place, counts = pos[counts[0] :], place[1:], counts[1:]
        assert got == want and len(path) == len(lines) and {r.path: r.length for r in rows if r.first is None} == {p: len(n) + len(c) for p, n, c in w}
        assert len(rows) < len(path) + len(want) / 10
    real = ix.postings_of
    monkeypatch.setattr(ix, "postings_of", lambda docs, exact, seed=0: real(docs, exact, seed) if seed else real(docs, exact).withColumn("doc", F.when(F.col("doc").isNotNull(), F.lit(7).cast("long"))))
    index = StoredIndex.build(d.where("root = '/a'"), str(tmp_path / "i"))
    assert index.documents().count() == index.postings.where("first is null").select("doc").distinct().count() > 80
    index.remove(d.where("root = '/a' and path % 2 = 0").select("root", "path"))
    index.compact()
    assert index.postings.where("first is not null").select(F.explode("docs")).distinct().join(index.postings.where("first is null").selectExpr("doc as col"), "col", "left_anti").count() == 0
    assert sorted(r.path for r in index.occurrences(Phrase(("w1",), True)).collect()) == sorted(p for p, n, c in w if int(p) % 2 and int(p) % 3 and any(t.startswith("w1") for t in n + c))
    assert index.occurrences(Phrase(())).count() == 0


def test_bucket_of_a_word(spark):
    from searchloom.operators import index as ix

    words = ["a", "alpha", "ёлка", "日本", "7", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", ix._bucket(F.col("w"))).collect()
    assert all(ix.bucket_of(r[0]) == r[1] for r in got)


def test_registered_queries_equal_their_sql(spark):
    import duckdb

    from searchloom import catalogue

    sf, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "conversations", "events", "orders", "nation", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    tidy = lambda v: round(v, 5) if isinstance(v, float) else v
    for name, sql in catalogue.oracle_sql().items():
        df = catalogue.queries()[name](spark, sf)
        cols = sorted(df.columns)
        r = c.execute(sql)
        at = [[x[0] for x in r.description].index(k) for k in cols]
        key = lambda x: tuple(map(str, x))
        want = sorted((tuple(tidy(row[k]) for k in at) for row in r.fetchall()), key=key)
        got = sorted((tuple(tidy(row[k]) for k in cols) for row in df.collect()), key=key)
        assert got == want, name
    for name in ("snippet_exact", "snippet_forms"):
        assert catalogue.queries()[name](spark, sf).select(F.count("*")).first()[0] > 0
