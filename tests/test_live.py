import threading

from pyspark.sql import Observation
from pyspark.sql import functions as F

from searchloom.operators import metrics
from searchloom.plans.query import SearchQuery
from searchloom.plans.session import LatestSearch
from searchloom.sources.watch import FileChanges, _Watcher


def test_latest_search_wins(spark):
    docs = spark.createDataFrame([("/r", f"/r/{i}", f"{w}.txt", ".txt", 1, 1, w) for i, w in enumerate(("alpha", "beta", "gamma"))], "root string, path string, name string, ext string, size long, modified_time long, content string")
    got, done = [], threading.Event()
    s = LatestSearch(spark, docs, debounce=0.05)
    for w in ("alpha", "beta", "gamma"):
        s.submit(SearchQuery(w), lambda q, rows: (got.append((q.pattern, [r.path for r in rows])), done.set()))
    assert done.wait(60) and got == [("gamma", ["/r/2"])]
    assert s.excerpts(SearchQuery("beta"), docs.where("path = '/r/1'")).first().snippet == "[beta]"
    s.cancel()


def test_changes_of_a_tree(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1")
    w = _Watcher({"path": str(tmp_path)})
    rows, at = w.read(w.initialOffset())
    assert [r[4] for r in rows] == ["Overflow"]
    (tmp_path / "a.txt").write_text("22")
    (tmp_path / "b.txt").write_text("1")
    rows, nxt = w.read(at)
    first = [(r[4], r[3][-5:]) for r in rows]
    assert first == [("Created", "b.txt"), ("Modified", "a.txt")] and [(r[4], r[3][-5:]) for r in w.readBetweenOffsets(at, nxt)] == first
    w.commit(nxt)
    (tmp_path / "b.txt").unlink()
    assert [(r[4], r[3][-5:]) for r in w.read(nxt)[0]] == [("Removed", "b.txt")]
    spark.dataSource.register(FileChanges)
    q = spark.readStream.format("filechanges").load(str(tmp_path)).writeStream.format("memory").queryName("seen").start()
    for _ in range(100):
        if spark.table("seen").count() or q.exception():
            break
        q.awaitTermination(0.2)
    q.stop()
    assert [r.kind for r in spark.table("seen").collect()] == ["Overflow"]


def test_observed(spark):
    o = Observation("run")
    metrics.observed(spark.createDataFrame([(0, "abc"), (2, "")], "problem int, content string"), o).select(F.count("*")).collect()
    assert o.get == {"files": 2, "failed": 1, "text_bytes": 3}
