import datetime as dt
import os

from pyspark.sql import functions as F

from searchloom.operators import maintain as m
from searchloom.operators import metrics
from searchloom.sources import filetree
from searchloom.streaming import changes

FILES = "root string, path string, name string, ext string, size long, modified_time long"


def table(spark, rows):
    return spark.createDataFrame([("/d", p, p.rsplit("/", 1)[-1], ".txt", s, t) for p, s, t in rows], FILES)


def test_remove_under(spark):
    rows = ["/d/A/x.txt", "/d/A/sub/y.txt", "/d/AB/z.txt", "/d/A.txt", "/d/A 2/q.txt", "D:\\Архив\\w.txt", "D:\\Архив\\2020\\v.txt", "D:\\Архив старый\\u.txt"]
    t = table(spark, [(p, 1, 1) for p in rows])
    n = lambda df: df.count()
    assert n(m.remove_under(t, "/d/A")) == 6 and n(m.remove_under(t, "D:\\Архив\\")) == 6 and n(m.remove_under(t, "/none")) == 8 and n(m.remove_under(t, "/")) == 8


def test_reconcile(spark):
    old = table(spark, [("/d/a", 1, 1), ("/d/b", 1, 1), ("/d/same", 1, 1), ("/d/locked/x", 1, 1), ("/d/lockedout/x", 1, 1)])
    scan = table(spark, [("/d/a", 2, 1), ("/d/c", 1, 1), ("/d/same", 1, 1)])
    locked = spark.createDataFrame([("/d", "/d/locked")], "root string, folder string")
    got = {r.path: r.action for r in m.reconcile(old, scan, locked).collect()}
    assert got == {"/d/a": "changed", "/d/b": "remove", "/d/same": "unchanged", "/d/c": "new", "/d/locked/x": "kept", "/d/lockedout/x": "remove"}
    off = spark.createDataFrame([("/d",)], "root string")
    assert "remove" not in {r.action for r in m.reconcile(old, scan, None, off).collect()}
    after, written = m.run_index(old, scan, lambda df: df.withColumn("content", F.lit("t")), unreadable=locked)
    assert sorted(r.path for r in after.collect()) == ["/d/a", "/d/c", "/d/locked/x", "/d/same"] and sorted(r.path for r in written.collect()) == ["/d/a", "/d/c"]
    assert m.run_index(after, scan, lambda df: df, unreadable=locked)[1].count() == 0
    full, all_ = m.run_index(old, scan, lambda df: df, full=True)
    assert full.count() == 6 and all_.count() == 3


def test_registry_problems_and_roots(spark):
    s = spark.createDataFrame([("/a", "a.db", 5), ("/b", "b.db", 6)], "root string, db_path string, last_full_scan long")
    got = {r.root: (r.db_path, r.last_full_scan) for r in m.registry_upsert(s, spark.createDataFrame([("/a", "x.db", 99), ("/c", "c.db", 7)], s.schema)).collect()}
    assert got == {"/a": ("x.db", 5), "/b": ("b.db", 6), "/c": ("c.db", 7)}
    assert {r.root: r.last_full_scan for r in m.registry_touch(s, "/a", 50).collect()} == {"/a": 50, "/b": 6}
    p = spark.createDataFrame([("/x", 1, 1, 2, "", 100), ("/y", 1, 1, 3, "", 200)], "path string, size long, modified_time long, problem int, detail string, seen_at long")
    retried = spark.createDataFrame([("/x",), ("/y",), ("/z",)], "path string")
    assert {r.path: r.outcome for r in m.retry_outcome(retried, p, 150).collect()} == {"/x": "waiting", "/y": "failing", "/z": "fixed"}
    assert {(r.problem, r.n) for r in m.problems_by_reason(p).collect()} == {(2, 1), (3, 1), (None, 2)}
    new = m.record_problems(p, p.where("path = '/x'").drop("seen_at"), F.lit(300).cast("long"))
    assert new.count() == 2 and new.where("seen_at = 300").count() == 1
    roots = spark.createDataFrame([("/d",), ("/d/sub",)], "root string")
    got = {r.path: r.root for r in m.longest_root(spark.createDataFrame([("/d/x",), ("/d/subway",), ("/e",)], "path string"), roots).collect()}
    assert got == {"/d/x": "/d", "/d/subway": "/d/sub", "/e": None}


def test_backfill(spark):
    d = spark.range(1, 26)
    done, seen = 0, []
    while d.where(f"id > {done} and id <= 25").count():
        batch = [r.id for r in m.backfill_batch(d, done, 25, 10).collect()]
        seen += batch
        done = max(batch)
    assert seen == list(range(1, 26)) and tuple(m.backfill_remaining(d, 10, 25).first()) == (15, 25)


def test_metrics(spark):
    t = spark.createDataFrame([("a", 8.0, 1.0, 1.0, 0.0), ("b", 1.0, 0.5, 0.2, 0.1), ("c", 3.0, 3.0, 3.0, 3.0)], "root string, read double, parse double, write double, walk double")
    assert {r.root: r.advice for r in metrics.advice(t).collect()} == {"a": "read", "b": "none", "c": "even"}
    s = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 0.0)], "root string, ts int, rate double")
    assert abs(metrics.ewma(s).first().rate - 0.7 * 13.0) < 1e-9
    runs = spark.createDataFrame([("a", 50, 100, 10.0, 1), ("b", 10, 100, 0.0, 5)], "root string, visited long, total long, rate double, finished_at long")
    r = metrics.progress(runs).first()
    assert (r.visited, r.total, r.permille, r.eta, r.last_finished) == (60, 200, 300, 5.0, "b")


def test_file_tree(spark, tmp_path):
    for name, text in {"alpha.txt": "hello", "beta.log": "12345", "sub/gamma.txt": "xyz", "skip.tmp": "", "node_modules/ignored.js": "", "sub/~$own.docx": "", "sub/deep/er/x.md": "é"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    os.symlink(tmp_path / "alpha.txt", tmp_path / "link.txt")
    rows = filetree.scan(spark, str(tmp_path), ["*.TMP", "node_modules"]).collect()
    assert sorted((r.name, r.ext, r.size) for r in rows) == [("alpha.txt", ".txt", 5), ("beta.log", ".log", 5), ("gamma.txt", ".txt", 3), ("x.md", ".md", 2)]
    assert all(r.modified_time == int(os.stat(r.path).st_mtime // 1) and not r.unreadable for r in rows)
    assert filetree.stat_file(str(tmp_path / "alpha.txt"), str(tmp_path))[4] == 5
    assert filetree.stat_file(str(tmp_path / "none"), str(tmp_path)) is None and filetree.stat_file(str(tmp_path / "skip.tmp"), str(tmp_path), ["*.tmp"]) is None
    assert filetree.available(str(tmp_path)) and not filetree.available(str(tmp_path / "none"))
    own = filetree.binary_files(spark, str(tmp_path), ["*.tmp", "node_modules"]).collect()
    assert {"alpha.txt", "gamma.txt", "x.md"} <= {r.name for r in own} and "skip.tmp" not in {r.name for r in own} and all(r.size == len(r.content) for r in own)
    assert filetree.volumes(spark).columns == ["root", "label", "type", "total_bytes", "free_bytes"]


def _events(spark, rows):
    t0 = dt.datetime(2024, 1, 1, 10, 59, 59)
    return spark.createDataFrame([(i, t0 + dt.timedelta(milliseconds=ms), "/d", p, k) for i, (ms, p, k) in enumerate(rows)], "seq long, ts timestamp, root string, path string, kind string")


def test_sessions(spark):
    e = _events(spark, [(0, "a", "Created"), (400, "a", "Modified"), (800, "b", "Created"), (1250, "a", "Removed"), (5000, "a", "Created"), (9_000_000, "c", "Created")])
    got = sorted((r.session.hour, r.path, r.kind, r.n) for r in changes.coalesced(e).collect())
    assert got == [(10, "a", "Removed", 3), (10, "b", "Created", 1), (11, "a", "Created", 1), (13, "c", "Created", 1)]
    kinds = spark.createDataFrame([("IN_MOVED_TO",), ("FILE_ACTION_ADDED",), ("x",)], "k string").select(changes.native_kind(F.col("k"))).collect()
    assert [r[0] for r in kinds] == ["RenamedTo", "Created", None]


def test_apply(spark):
    files = table(spark, [("/d/a", 1, 1), ("/d/gone", 1, 1), ("/d/gone/x", 1, 1), ("/d/gone2", 1, 1), ("/d/same", 1, 1), ("/d/retry", 1, 1)])
    scan = table(spark, [("/d/a", 2, 2), ("/d/new/x", 1, 1), ("/d/same", 1, 1), ("/d/retry", 1, 1), ("/d/gone2", 1, 1), ("/d/mod/y", 1, 1)]).withColumn("is_dir", F.lit(False))
    scan = scan.union(table(spark, [("/d/new", 0, 0), ("/d/mod", 0, 0)]).withColumn("is_dir", F.lit(True)))
    batch = _events(spark, [(0, "/d/a", "Modified"), (1, "/d/gone", "Removed"), (2, "/d/new", "Created"), (3, "/d/same", "Modified"), (4, "/d/retry", "Retry"), (5, "/d/mod", "Modified"), (6, "", "Overflow")])
    after, fresh, rescan = changes.apply_batch(files, batch, scan)
    assert sorted(r.path for r in fresh.collect()) == ["/d/a", "/d/new/x", "/d/retry"]
    assert sorted(r.path for r in after.collect()) == ["/d/a", "/d/gone2", "/d/new/x", "/d/retry", "/d/same"] and [r.root for r in rescan.collect()] == ["/d"]


def test_stream(spark, tmp_path):
    e = _events(spark, [(0, "a", "Created"), (1, "a", "Removed"), (2, "b", "Created")])
    e.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = changes.follow(stream, str(tmp_path / "cp"), lambda df, n: seen.extend((r.path, r.kind) for r in df.collect()), "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [("a", "Removed"), ("b", "Created")]
    w = changes.windowed(stream).writeStream.format("memory").queryName("win").outputMode("append").start()
    w.processAllAvailable()
    w.stop()
    assert w.exception() is None


def test_store_replaces_touched_sources_only(spark, tmp_path):
    at = str(tmp_path / "t")
    m.store(spark.createDataFrame([("r1", "/a"), ("r2", "/b")], "root string, path string"), at)
    m.store(spark.createDataFrame([("r1", "/c")], "root string, path string"), at)
    assert sorted((r.root, r.path) for r in spark.read.parquet(at).collect()) == [("r1", "/c"), ("r2", "/b")]
