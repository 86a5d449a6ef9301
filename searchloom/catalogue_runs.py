"""Registered queries of the stored index, extraction, scans, runs and change events, and their SQL.

Files and indexes that a query needs are written to the shared folder (spark.checkpoint.dir; a temporary one only where Spark itself is
local) and deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom import catalogue as C
from searchloom.functions import files
from searchloom.operators import maintain, metrics, snippet
from searchloom.operators.index import StoredIndex
from searchloom.operators.match import Phrase, phrase
from searchloom.plans import runs
from searchloom.plans import search as S
from searchloom.plans.query import SearchQuery as Q
from searchloom.plans.query import parse
from searchloom.plans.session import LatestSearch
from searchloom.sources import extract, filetree, office, pdf, samples
from searchloom.streaming import changes


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = f"{(base or tempfile.gettempdir()).rstrip('/')}/searchloom-{uuid.uuid4().hex}"
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()

    def gone() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001 - at exit the JVM may be gone already
            shutil.rmtree(at.removeprefix("file:"), ignore_errors=True)

    atexit.register(gone)
    return at


_BUILT: dict[tuple, StoredIndex] = {}


def stored(spark: SparkSession, sf: str, exact: bool = False) -> StoredIndex:
    """The index of the documents, built once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf, exact)
    if key not in _BUILT:
        _BUILT[key] = StoredIndex.build(C.corpus(spark, sf), workspace(spark), exact)
    return _BUILT[key]


def _stored_page(q: Q):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        from pyspark.sql import Window

        found = S.search_stored(stored(spark, sf, q.exact_words), C.corpus(spark, sf), q)
        rn = F.row_number().over(Window.orderBy(*S.order(q, not parse(q.pattern).wanted)))
        return found.select((rn + q.offset).alias("rn"), "root", "path", F.round("relevance_score", 6).alias("score"))

    return run


def _fts_join(spark, sf):
    """Postings of a word joined to the files they belong to."""
    return stored(spark, sf).occurrences(Phrase(("erst",))).select("root", "path").join(C.corpus(spark, sf).select("root", "path", "doc_id", "size"), ["root", "path"])


_NEW = f"""{C._SNAPSHOTS}, now AS (SELECT n.root, n.path, n.name, o.content FROM new n JOIN docs o ON o.root = n.root AND o.name = n.name AND o.modified_time = n.modified_time WHERE NOT (starts_with(n.path, '/src1/moved/')))"""


def _maintained(spark, sf):
    """The index of one state of the documents brought to another: what is new or changed is indexed, what vanished goes, then a folder, then it is compacted."""
    old, new = C._snapshots(spark, sf)
    index = StoredIndex.build(old, workspace(spark))
    plan = maintain.reconcile(old, new)
    index.upsert(new.join(plan.where("action in ('new', 'changed')"), ["root", "path"], "left_semi"), plan.where("action = 'remove'").select("root", "path"))
    index.remove_under("/src1", "/src1/moved")
    kept = index.documents().groupBy("root").agg(F.count("*").alias("n"), F.sum("length").alias("words"))
    kept = kept.join(index.sources(), "root")
    kept = spark.createDataFrame(kept.collect(), kept.schema)  # a row for each source, before the files it comes from are compacted
    index.compact()
    after = index.sources().select("root", F.col("mean").alias("m2"))
    hits = index.score([Phrase(("erst",))]).groupBy("root").agg(F.count("*").alias("hits"), F.round(F.min("relevance_score"), 6).alias("best"))
    return kept.join(after, "root").join(hits, "root", "left").select("root", "n", "words", "n_docs", F.round("mean", 6).alias("mean"), F.round("m2", 6).alias("mean_compacted"), F.coalesce("hits", F.lit(0)).alias("hits"), "best")


def _backfilled(spark, sf):
    """An exact index made step by step beside the one in use."""
    docs = C.corpus(spark, sf).withColumn("id", F.col("doc_id"))
    left = maintain.backfill_remaining(docs, -1, 10**12).first()
    index, done, step = StoredIndex.open(spark, workspace(spark), exact=True), -1, max(200, left["remaining"] // 3 + 1)
    while done < left["last_id"]:
        done = index.backfill(docs, done, left["last_id"], step)
    return index.documents().withColumn("length", F.col("length").cast("long"))


# -- extraction: files made of every row, and their texts


def _made(rows: DataFrame, make, kind: str) -> DataFrame:
    """rows(key, text, number, note) -> files of this kind, one for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.slice(at, 64)
                data = [make(*(c[k].as_py() for c in part.columns[1:])) for k in range(len(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["path", "content"])

    made = rows.select("key", "text", "number", "note").mapInArrow(run, "path string, content binary")
    return made.select(F.lit("/made").alias("root"), "path", F.col("path").alias("name"), F.lit(kind).alias("ext"), F.length("content").cast("long").alias("size"), F.lit(0).cast("long").alias("modified_time"), "content")


def _documents(spark, sf) -> DataFrame:
    return C._read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("number"), "lang", F.col("lang").alias("note"))


def _texts(rows: DataFrame) -> DataFrame:
    """Long texts as digests."""
    return extract.extract_rows(rows).select("path", F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"), "problem")


def _texts_sql(text: str, base: str, empty: int = 0) -> str:
    return f"SELECT path, length(t) AS chars, md5(t) AS digest, CAST({empty} AS INTEGER) AS problem FROM (SELECT path, {text} AS t FROM ({base}))"


_DOCUMENTS = "SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text, doc_id AS number, lang AS note FROM documents"
_ITEMS = "SELECT CAST(item_id AS VARCHAR) AS path, coalesce(text, '') AS text, item_id AS number, '' AS note FROM benchmark"
_ASCII = "regexp_replace({}, '[^ -~]+', ' ', 'g')"


def _ascii(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.regexp_replace("text", "[^ -~]+", " "))


def _items(spark, sf) -> DataFrame:
    return _ascii(C._read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col("item_id").alias("number"), F.lit("").alias("note")))


def _locked(text: str, number: int, note: str) -> bytes:
    """An encrypted file, of each of five handlers in turn, without a password; every seventh has one."""
    return samples.encrypted(2 + number % 5, b"secret" if number % 7 == 3 else b"", plain=samples.shown(text))


# -- files on disk


def _tree(spark, sf) -> str:
    """A folder for each region with a text file for each nation, and what a scan leaves out or reports."""
    at = workspace(spark).removeprefix("file:") + "/tree"
    for n in C._read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():
        folder = f"{at}/r{n['n_regionkey']}/deep/er"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{n['n_name']}.txt", "w", encoding="utf-8") as f:
            f.write(f"{n['n_name']} number {n['n_nationkey']} té\n")
        os.utime(f.name, (1_700_000_000 + n["n_nationkey"],) * 2)
    for name, data in {"r0/skip.TMP": b"x", "r1/node_modules/i.js": b"x", "r2/~$own.docx": b"x", "broken.docx": b"z" * 50, "locked.xlsx": bytes.fromhex("D0CF11E0A1B11AE1") + b"x", "none.pdf": b"no pdf", "large.log": b"y" * 3000, "page.pdf": samples.pdf("a page"), "odd.exe": b"MZ", ".dot": b""}.items():
        os.makedirs(os.path.dirname(f"{at}/{name}"), exist_ok=True)
        with open(f"{at}/{name}", "wb") as f:
            f.write(data)
        os.utime(f.name, (1_700_000_000,) * 2)
    os.symlink(f"{at}/page.pdf", f"{at}/link.pdf")
    return at


_MASKS = ["*.tmp", "node_modules"]
_NATIONS = "SELECT 'r' || n_regionkey || '/deep/er/' || n_name || '.txt' AS path, n_name || '.txt' AS name, '.txt' AS ext, CAST(strlen(n_name || ' number ' || n_nationkey || ' té') + 1 AS BIGINT) AS size, CAST(1700000000 + n_nationkey AS BIGINT) AS modified_time, n_name || ' number ' || n_nationkey || ' té' || chr(10) AS content FROM nation"
_ODD = "(VALUES ('broken.docx', '.docx', 50, '', 2), ('locked.xlsx', '.xlsx', 9, '', 3), ('none.pdf', '.pdf', 6, '', 2), ('large.log', '.log', 3000, '', 4), ('odd.exe', '.exe', 2, '', 0), ('.dot', '', 0, '', 0)) o(path, ext, size, content, problem)"


def _scan(spark, sf):
    at = _tree(spark, sf)
    return filetree.scan(spark, at, _MASKS).where("name <> 'page.pdf'").select(F.substr(F.col("path"), F.lit(len(at) + 2)).alias("path"), "name", "ext", "size", "modified_time", "unreadable")


def _lookup(spark, sf):
    at = _tree(spark, sf)
    rows = []
    for name in ("broken.docx", "r0/skip.TMP", "r1/node_modules/i.js", "nowhere.txt", "r0", "link.pdf"):
        row = filetree.stat_file(f"{at}/{name}", at, _MASKS)
        rows.append((name, row is not None, row[4] if row else None))
    rows += [("root", filetree.available(at), None), ("no root", filetree.available(at + "/nowhere"), None)]
    return spark.createDataFrame(rows, "name string, found boolean, size long")


def _read_files(spark, sf):
    at = _tree(spark, sf)
    own = filetree.binary_files(spark, at, _MASKS).where("name not in ('page.pdf', 'link.pdf')")
    return extract.extract_files(own, max_bytes=2000).select(F.substr(F.col("path"), F.lit(len(at) + 2)).alias("path"), "ext", "size", "content", "problem")


def _mounts(spark, sf):
    at = workspace(spark).removeprefix("file:")
    os.makedirs(at, exist_ok=True)
    with open(f"{at}/mounts", "w") as f:
        f.write("/dev/a / ext4 rw 0 0\nserver:/x /proc nfs4 rw 0 0\n/dev/b /sys vfat ro 0 0\nproc /proc proc rw 0 0\n/dev/c /no\\040where ext4 rw 0 0\n")
    return filetree.volumes(spark, f"{at}/mounts").select("root", "label", "type", (F.col("total_bytes") >= F.col("free_bytes")).alias("sized"))


# -- runs


def _runs(spark, sf):
    """Two runs over two sources: all files, then those that changed; one folder is deleted, one can't be read, one source is offline."""
    at = _tree(spark, sf)

    def scan(root: str):
        if not filetree.available(root):
            return None, None
        rows = filetree.scan(spark, root, _MASKS)
        return rows.where("not unreadable"), rows.where("unreadable").select("root", F.col("path").alias("folder"))

    def read(rows: DataFrame) -> DataFrame:
        texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        return extract.extract_files(rows.join(texts, "path").select("root", "path", "name", "ext", "size", "modified_time", "content"))

    sources = spark.createDataFrame([(f"{at}/r{k}", f"r{k}", 0) for k in (0, 1, 2, 9)], "root string, db_path string, last_full_scan long")
    runner = runs.Runner(spark, StoredIndex.open(spark, at + "-index"), scan, read, threshold=20)
    runner.run(sources, now=1)
    shutil.rmtree(f"{at}/r1/deep")
    for name in os.listdir(f"{at}/r2/deep/er"):
        with open(f"{at}/r2/deep/er/{name}", "a") as f:
            f.write("more words")
        os.utime(f.name, (1_800_000_000,) * 2)
    after = runner.run(sources, now=2)
    docs = runner.index.documents().groupBy("root").agg(F.count("*").alias("files"), F.sum("length").alias("words"))
    status = runner.status
    return after.join(docs, "root", "left").select("db_path", "last_full_scan", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("words", F.lit(0)).alias("words"), F.lit(status.written).alias("written"), F.lit(status.removed).alias("removed"), F.lit(status.phase).alias("phase"))


_RUNS = """WITH k AS (SELECT * FROM (VALUES (0), (1), (2), (9)) k(k)), n AS (SELECT n_regionkey AS r, count(*) AS c, sum(len(regexp_extract_all(n_name || '.txt' || ' ' || n_name || ' number ' || n_nationkey || ' te', '[A-Za-z0-9]+'))) AS w FROM nation GROUP BY 1)
SELECT 'r' || k AS db_path, CAST(2 AS BIGINT) AS last_full_scan, coalesce(CASE WHEN k IN (0, 2) THEN c END, 0) AS files, CAST(coalesce(CASE WHEN k = 0 THEN w WHEN k = 2 THEN w + 2 * c END, 0) AS BIGINT) AS words,
 CAST((SELECT c FROM n WHERE r = 2) AS INTEGER) AS written, CAST((SELECT c FROM n WHERE r = 1) AS INTEGER) AS removed, 'done' AS phase FROM k LEFT JOIN n ON r = k"""


def _controls(spark, sf):
    """A run that is paused, resumed, and cancelled after its first source; the rest is as it was."""
    docs = C.corpus(spark, sf)
    seen = []

    def scan(root: str):
        seen.append(root)
        if len(seen) == 1:
            runner.pause()
            threading.Timer(0.3, runner.resume).start()
        if len(seen) == 2:
            runner.cancel()
        return docs.where(F.col("root") == root), None

    runner = runs.Runner(spark, StoredIndex.open(spark, workspace(spark)), scan, lambda rows: rows.join(docs.select("root", "path", "content"), ["root", "path"]).withColumn("problem", F.lit(0)))
    sources = docs.select("root").distinct().select("root", F.lit("x").alias("db_path"), F.lit(0).cast("long").alias("last_full_scan"))
    after = runner.run(sources, now=5)
    n = runner.index.documents().groupBy("root").agg(F.count("*").alias("n"))
    return after.join(n, "root", "left").select("root", "last_full_scan", F.coalesce("n", F.lit(0)).alias("n"), F.lit(runner.status.phase).alias("phase"))


# -- change events


def _batch(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files as indexed, as they are, and events of every other one of both, with an overflow and retries."""
    old, new = C._snapshots(spark, sf)
    even = lambda d, kind: d.where("doc_id % 2 = 0").select("root", "path", F.lit(kind).alias("kind"))
    events = even(old, "Modified").union(even(new, "Created")).union(old.where("doc_id % 10 = 1").select("root", "path", F.lit("Retry"))).union(spark.createDataFrame([("/src2", "", "Overflow"), ("/src2", "", "Overflow")], "root string, path string, kind string"))
    events = events.withColumn("seq", F.monotonically_increasing_id()).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    cols = ["root", "path", "name", "ext", "size", "modified_time"]
    return old.select(*cols), new.select(*cols).withColumn("is_dir", F.lit(False)), events


def _applied(which: int, *cols: str):
    def run(spark, sf):
        known, scan, events = _batch(spark, sf)
        return changes.apply_batch(known, events, scan)[which].select(*cols)

    return run


_STATES = f"WITH {C._DOCS}, new AS (SELECT doc_id, root, CASE WHEN size % 7 = 0 THEN root || '/moved/' || name ELSE path END AS path, CASE WHEN size % 11 = 0 THEN size + 1 ELSE size END AS size FROM docs)"
_APPLIED = f"{_STATES} SELECT root, path, size FROM new WHERE doc_id % 2 = 0 UNION ALL SELECT root, path, size FROM docs WHERE doc_id % 2 = 1 AND NOT (doc_id % 10 = 1 AND size % 7 = 0) AND NOT (doc_id % 10 = 1 AND size % 11 = 0) UNION ALL SELECT n.root, n.path, n.size FROM new n JOIN docs d USING (doc_id) WHERE doc_id % 10 = 1 AND d.size % 11 = 0 AND d.size % 7 <> 0"
_FRESH = f"{_STATES} SELECT n.root, n.path FROM new n JOIN docs d USING (doc_id) WHERE (doc_id % 2 = 0 AND (n.path <> d.path OR n.size <> d.size)) OR (doc_id % 10 = 1 AND n.path = d.path)"


def _pending(spark, sf):
    """Events that arrive while a batch is written join those that wait: the latest of each path counts once."""
    e = C._events(spark, sf)
    return changes.latest(changes.latest(e.where("seq % 3 = 0")).select("seq", "root", "path", "kind").union(e.where("seq % 3 <> 0").select("seq", "root", "path", "kind"))).select("root", "path", "kind")


_NATIVE = sorted(changes.NATIVE)


def _native(spark, sf):
    names = F.element_at(F.array(*map(F.lit, [*_NATIVE, "IN_OPEN"])), (F.col("event_id") % (len(_NATIVE) + 1) + 1).cast("int"))
    return C._read(spark, sf, "events").groupBy(changes.native_kind(names).alias("kind")).agg(F.count("*").alias("n"))


_BITS = (0x1, 0x2, 0x4, 0x100, 0x200, 0x800, 0x1000, 0x10000, 0x20000)


def _flags(spark, sf):
    e = C._read(spark, sf, "events").select("event_id", sum((F.when(F.shiftrightunsigned("event_id", k).bitwiseAND(F.lit(1)) == 1, bit).otherwise(0) for k, bit in enumerate(_BITS)), F.lit(0)).alias("flags"))
    return e.groupBy(changes.flag_kind(F.col("flags")).alias("kind")).agg(F.count("*").alias("n"))


_FLAGS = """WITH e AS (SELECT event_id AS i FROM events), k AS (SELECT CASE WHEN i & 7 <> 0 THEN 'Overflow' WHEN i & 384 = 0 THEN NULL WHEN i & 16 <> 0 THEN 'Removed' WHEN i & 32 <> 0 THEN 'RenamedTo' WHEN i & 8 <> 0 THEN 'Created' ELSE 'Modified' END AS kind FROM e) SELECT kind, count(*) AS n FROM k GROUP BY kind"""


# -- figures, lists, formats


def _progress(spark, sf):
    e = C._read(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("root")).agg(F.count("*").alias("visited"), (F.count("*") + F.max("user_id")).alias("total"), F.round(F.avg("value"), 2).alias("rate"), F.max("event_id").alias("finished_at"))
    return metrics.progress(e).select("visited", "total", "permille", F.round("eta", 6).alias("eta"), "last_finished")


def _remaining(spark, sf):
    o = C._read(spark, sf, "orders")
    n, v = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 2)
    return o.select(
        "o_orderkey", F.round(metrics.files_left(n, v, F.col("o_custkey"), F.floor(F.col("o_custkey") / 3), F.col("o_custkey") / 100), 4).alias("files_left"),
        F.round(metrics.heavy_left(n * 1000, v * 1000, F.col("o_custkey") / 10, n * 10, F.lit(2.0)), 4).alias("heavy_left"), files.size_text(F.col("o_orderkey") * 1000).alias("size"),
        files.duration_text(F.col("o_orderkey")).alias("clock"), files.count_text(F.col("o_orderkey"), "файл", "файла", "файлов").alias("told"),
    )


_REMAINING = """WITH o AS (SELECT o_orderkey AS n, o_orderkey // 2 AS v, o_custkey AS c FROM orders)
SELECT n AS o_orderkey, round(CASE WHEN c / 100 >= 1 THEN greatest(n - v - (c - c // 3), 0) / (c / 100) END, 4) AS files_left,
 round(CASE WHEN c > 0 AND v > 0 THEN greatest(0, (n - v) * 1000 / (v * 1000 / (c / 10)) - least(2.0, least(n * 10, (n - v) * 1000) / (v * 1000 / (c / 10)))) END, 4) AS heavy_left,
 CASE WHEN n * 1000 < 1024 THEN (n * 1000) || ' B' WHEN n * 1000 < 1048576 THEN format('{:,.1f}', n * 1000 / 1024) || ' KB' WHEN n * 1000 < 1073741824 THEN format('{:,.1f}', n * 1000 / 1048576) || ' MB' ELSE format('{:,.2f}', n * 1000 / 1073741824) || ' GB' END AS size,
 CASE WHEN n >= 3600 THEN printf('%d:%02d:%02d', n // 3600, n // 60 % 60, n % 60) ELSE printf('%d:%02d', n // 60, n % 60) END AS clock,
 n || ' ' || CASE WHEN n % 100 BETWEEN 11 AND 14 THEN 'файлов' WHEN n % 10 = 1 THEN 'файл' WHEN n % 10 BETWEEN 2 AND 4 THEN 'файла' ELSE 'файлов' END AS told FROM o"""


def _problem_list(spark, sf):
    """Problems recorded, some again with another reason, and listed by path."""
    d = C.corpus(spark, sf).select("path", "size", "modified_time", (F.col("size") % 5).cast("int").alias("problem"), F.lit("").alias("detail"))
    first = maintain.record_problems(d.where("problem <> 0").withColumn("seen_at", F.lit(1).cast("long")).where("false"), d.where("problem <> 0"), F.lit(1).cast("long"))
    again = maintain.record_problems(first, d.where("size % 3 = 0").withColumn("problem", F.lit(5)), F.lit(2).cast("long"))
    return maintain.problem_files(again).select("path", "problem", "seen_at")


def _registry_list(spark, sf):
    s = C.corpus(spark, sf).groupBy("root").agg(F.lit("x.db").alias("db_path"), F.max("modified_time").alias("last_full_scan"))
    return maintain.registry_sources(maintain.registry_touch(s, "/src1", 77)).select("root", "last_full_scan")


def _transaction(spark, sf):
    """A table by sources, of which one is replaced as a whole."""
    at, d = workspace(spark), C.corpus(spark, sf).select("path", "size", "root")
    maintain.store(d, at)
    maintain.store(d.where("root = '/src1'").withColumn("size", F.col("size") + 1), at)
    return spark.read.parquet(at).groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def _counts(spark, sf):
    return maintain.backfill_remaining(C.corpus(spark, sf).withColumn("id", F.col("doc_id")), 10, 10**12)


def _presets(spark, sf):
    now = F.lit("2024-03-10 15:30:00").cast("timestamp")
    return C.corpus(spark, sf).select(*[F.sum((F.col("modified_time") >= files.since_preset(p, now)).cast("long")).alias("n_" + p) for p in files.DATE_PRESETS])


def _latest(spark, sf):
    """Two searches in quick succession: only the second one's rows arrive."""
    got, done = [], threading.Event()
    latest = LatestSearch(spark, C.corpus(spark, sf), debounce=0.2)

    def deliver(q: Q, rows: list) -> None:
        got.extend((q.pattern, r["path"]) for r in rows)
        done.set()

    latest.submit(Q('"of the"', sort_field="name", limit=5), deliver)
    latest.submit(Q('"erst"', sort_field="name", limit=5), deliver)
    done.wait(600)
    return spark.createDataFrame(got, "pattern string, path string")


def _visible(spark, sf):
    """Excerpts of the rows in view, by the session's own method."""
    d = C.corpus(spark, sf)
    shown = S.search(d, Q('"erst"', sort_field="name", limit=20))
    found = LatestSearch(spark, d).excerpts(Q('"erst"'), shown)
    return found.select("path", F.col("snippet").contains("[").alias("marked"))


# -- rows whose results are written out

_PARSED = [
    ("practicum report", 2, 0, 0, "", ""), ('"quarterly report"', 1, 0, 1, "", ""), ('report -draft -"old version"', 1, 2, 1, "", ""), ("report ext:docx", 1, 0, 0, ".docx", ""), ("ext:.PDF", 0, 0, 0, ".pdf", ""),
    ('ext:"xlsx"', 0, 0, 0, ".xlsx", ""), ("path:D:\\Work\\ report", 1, 0, 0, "", "D:\\Work\\"), ('path:"D:\\My Files\\" report', 1, 0, 0, "", "D:\\My Files\\"), ("ext:docx ext:pdf", 0, 0, 0, ".docx", ""),
    ('"практикум номер 1" -черновик ext:docx path:D:\\Work\\', 1, 1, 1, ".docx", "D:\\Work\\"), ("", 0, 0, 0, "", ""), ("report - draft", 2, 0, 0, "", ""), ('"" report', 1, 0, 0, "", ""), ("-ext:pdf", 0, 1, 0, "", ""),
    ("--x", 0, 1, 0, "", ""), ('a"b"', 1, 0, 0, "", ""), ('"open end', 1, 0, 1, "", ""), ("-a -b", 0, 2, 0, "", ""), ("!!!", 1, 0, 0, "", ""),
]

_W30, _TAIL = " ".join(f"w{i}" for i in range(30)), " ".join(f"b{i}" for i in range(20))
_EXCERPTS = [
    (True, "hit", "x hit y", "x [hit] y"), (True, "hit", "", ""), (True, "hit", _W30, " ".join(f"w{i}" for i in range(17)) + "..."), (True, "hit", " ".join(f"a{i}" for i in range(9)) + " HIT " + _TAIL, "...a4 a5 a6 a7 a8 [HIT] " + " ".join(f"b{i}" for i in range(12)) + "..."),
    (False, "практикума", "Инструкция к практикуму номер один", "Инструкция к [практикуму] номер один"), (False, "договоры", "подписал ещё один договор", "подписал ещё один [договор]"), (False, '"alpha beta"', "gamma alpha beta delta", "gamma [alpha beta] delta"), (False, "alph", "an alphabet", "an [alphabet]"),
]

_PIECES = [
    ("entities", office.unescape, "&lt;&gt;&quot;&apos;&amp;&#65;&#x42;&nope;", "<>\"'&AB&nope;"), ("runs", lambda x: office.runs(x, "w"), '<w:tblPr w:val="dxa"/><w:p><w:t>First</w:t></w:p><w:t xml:space="preserve"> b</w:t><w:tab/><w:t>x</w:t><w:br/><w:t/>', "First\n b\tx\n"),
    ("drawn runs", lambda x: office.runs(x, "a"), "<a:p><a:t>Sales</a:t></a:p>", "Sales\n"), ("shared strings", lambda x: "|".join(office.shared_strings(x)), "<sst><si><t>Apple</t></si><si><r><t>Ба</t></r><r><t>нан</t></r></si><si/></sst>", "Apple|Банан|"),
    ("cells", lambda x: office.cells(x, ["Apple"]), '<c t="s"><v>0</v></c><c t="inlineStr"><is><t>note</t></is></c><c><v>582030</v></c><c t="d"><v>2024-01-02</v></c><c t="b"><v>1</v></c><c t="e"><v>#DIV/0!</v></c><c t="str"><f>2</f><v>x</v></c><c t="s"><v>9</v></c>', "Apple note 582030 2024-01-02 x "),
    ("pdf escapes", lambda x: pdf.extract(samples.document([(x.encode(), "")]))[0], "BT (a\\(b\\)\\101\\\n!) Tj <4869> Tj ET", "a(b)A!Hi"), ("pdf kerning", lambda x: pdf.extract(samples.document([(x.encode(), "")]))[0], "BT [(Hello) -500 (World) 20 (s)] TJ ET", "Hello Worlds"),
    ("pdf image only", lambda x: str(pdf.extract(samples.document([], x))), "30 0 obj\n<< /Subtype /Image /Length 10 >>\nstream\n(IMG) Tj x\nendstream\nendobj\n", "('', True)"),
    ("pdf map", lambda x: pdf.extract(samples.document([(b"BT /F1 9 Tf <0102> Tj ET", "")], f"20 0 obj\n<< /Type /Font /ToUnicode 21 0 R >>\nendobj\n21 0 obj\n<< /Length {len(x)} >>\nstream\n{x}\nendstream\nendobj\n", "/F1 20 0 R"))[0], "begincmap 2 beginbfchar <01> <0410> <02> <0411> endbfchar endcmap", "АБ"),
    ("pdf range", lambda x: pdf.extract(samples.document([(b"BT /F1 9 Tf <00030004> Tj ET", "")], f"20 0 obj\n<< /Type /Font /ToUnicode 21 0 R >>\nendobj\n21 0 obj\n<< /Length {len(x)} >>\nstream\n{x}\nendstream\nendobj\n", "/F1 20 0 R"))[0], "begincmap 1 beginbfrange <0003> <0005> <0412> endbfrange endcmap", "ВГ"),
    ("unpacked limit", lambda x: str(extract.extract(samples.docx(x), ".docx", max_unpacked=64)[1]), "text", "4"),
]


def _quoted(v) -> str:
    return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" if isinstance(v, str) else str(v)


def _values(rows: list, names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) v({names})"


def _parse_queries(spark, sf):
    rows = [(q, len(p.wanted), len(p.unwanted), sum(t.phrase for t in p.tokens), p.ext or "", p.path or "") for q, *_ in _PARSED for p in [parse(q)]]
    return spark.createDataFrame(rows, "raw string, wanted int, unwanted int, phrases int, ext string, path string")


def _excerpts(spark, sf):
    rows = spark.createDataFrame([(i, e, q, t) for i, (e, q, t, _) in enumerate(_EXCERPTS)], "i int, exact boolean, query string, content string")
    out = None
    for i, (exact, q, _, _) in enumerate(_EXCERPTS):
        own = snippet.add(rows.where(F.col("i") == i), [phrase(t, exact) for t in parse(q).wanted], exact).select("i", "snippet")
        out = own if out is None else out.union(own)
    return out


def _pieces(spark, sf):
    return spark.createDataFrame([(name, f(raw)) for name, f, raw, _ in _PIECES], "name string, text string")


_PHRASES = {
    "stored_term": Q('"erst"'), "stored_phrase": Q('"of the"'), "stored_prefix": Q("ere"), "stored_filters": Q("the ext:txt path:/en/ -erst", extensions=(".TXT", ".md"), modified_since=1_700_500_000, sort_field="name"),
    "stored_exact": Q("erst", exact_words=True),
}
_STORED_SQL = {"stored_term": "term_bm25", "stored_phrase": "phrase_match", "stored_prefix": "prefix_term", "stored_filters": "all_filters", "stored_exact": "exact_mode"}

_QUERIES: dict[str, tuple] = {
    "fts_files_join": (_fts_join, C._OTHERS["fts_files_join"][1]),
    "index_maintained": (_maintained, f"""WITH {_NEW}, w AS (SELECT root, path, {C._toks('name')} AS nw, {C._toks('content')} AS cw FROM now), t AS (SELECT root, {C._occ('nw', ('erst',), False)} AS n0, {C._occ('cw', ('erst',), False)} AS c0, len(nw) + len(cw) AS len_ FROM w),
st AS (SELECT root AS r, count(*) AS n, sum(len_) AS words, avg(len_) AS mean, sum(CASE WHEN n0 + c0 > 0 THEN 1 ELSE 0 END) AS df0 FROM t GROUP BY root), h AS (SELECT root, 0.0e0 - greatest(ln((n - df0 + 0.5) / (df0 + 0.5)), 1e-6) * (10.0 * n0 + c0) * 2.2 / (10.0 * n0 + c0 + 1.2 * (0.25 + 0.75 * len_ / mean)) AS score FROM t JOIN st ON root = r WHERE n0 + c0 > 0)
SELECT r AS root, n, CAST(words AS BIGINT) AS words, n AS n_docs, round(mean, 6) AS mean, round(mean, 6) AS mean_compacted, CAST(df0 AS BIGINT) AS hits, (SELECT round(min(score), 6) FROM h WHERE h.root = r) AS best FROM st"""),
    "exact_backfill": (_backfilled, f"WITH {C._DOCS} SELECT root, path, CAST(len({C._toks('name')}) + len({C._toks('content')}) AS BIGINT) AS length FROM docs"),
    "extract_docx": (lambda s, sf: _texts(_made(_documents(s, sf), lambda t, n, _: samples.docx(t), ".docx")), _texts_sql("text || chr(10)", _DOCUMENTS)),
    "extract_xlsx": (lambda s, sf: _texts(_made(_documents(s, sf), samples.xlsx, ".xlsx")), _texts_sql("'Rows' || chr(10) || CASE WHEN text = '' THEN '' ELSE text || ' ' END || number || ' ' || CASE WHEN coalesce(note, '') = '' THEN '' ELSE note || ' ' END", _DOCUMENTS)),
    "extract_pdf": (lambda s, sf: _texts(_made(_ascii(_documents(s, sf)), lambda t, n, _: samples.pdf(t), ".pdf")), _texts_sql(f"CASE WHEN trim(u) = '' THEN '' ELSE u END", f"SELECT path, {_ASCII.format('text')} AS u FROM ({_DOCUMENTS})")),
    "extract_encrypted_pdf": (lambda s, sf: _texts(_made(_items(s, sf), _locked, ".pdf")), f"SELECT path, length(t) AS chars, md5(t) AS digest, CAST(CASE WHEN number % 7 = 3 THEN 3 ELSE 0 END AS INTEGER) AS problem FROM (SELECT path, number, CASE WHEN number % 7 = 3 THEN '' ELSE {_ASCII.format('text')} END AS t FROM ({_ITEMS}))"),
    "scan_tree": (_scan, f"SELECT path, name, ext, size, modified_time, false AS unreadable FROM ({_NATIONS}) UNION ALL SELECT path, path, ext, CAST(size AS BIGINT), CAST(1700000000 AS BIGINT), false FROM {_ODD}"),
    "scan_lookup": (_lookup, "SELECT * FROM (VALUES ('broken.docx', true, 50), ('r0/skip.TMP', false, NULL), ('r1/node_modules/i.js', false, NULL), ('nowhere.txt', false, NULL), ('r0', false, NULL), ('link.pdf', false, NULL), ('root', true, NULL), ('no root', false, NULL)) v(name, found, size)"),
    "read_files": (_read_files, f"SELECT path, ext, size, content, CAST(0 AS INTEGER) AS problem FROM ({_NATIONS}) UNION ALL SELECT path, ext, CAST(size AS BIGINT), content, CAST(problem AS INTEGER) FROM {_ODD} WHERE path <> '.dot'"),
    "volumes": (_mounts, "SELECT * FROM (VALUES ('/', '/dev/a', 'Local', true), ('/proc', 'server:/x', 'Network', true), ('/sys', '/dev/b', 'Removable', true)) v(root, label, type, sized)"),
    "run_sources": (_runs, _RUNS),
    "run_controls": (_controls, f"WITH {C._DOCS}, r AS (SELECT root, count(*) AS n, row_number() OVER (ORDER BY root) AS k FROM docs GROUP BY root) SELECT root, CAST(CASE WHEN k = 1 THEN 5 ELSE 0 END AS BIGINT) AS last_full_scan, CASE WHEN k = 1 THEN n ELSE 0 END AS n, 'cancelled' AS phase FROM r"),
    "apply_events": (_applied(0, "root", "path", "size"), _APPLIED),
    "apply_events_fresh": (_applied(1, "root", "path"), _FRESH),
    "apply_events_rescan": (_applied(2, "root"), "SELECT '/src2' AS root"),
    "events_pending": (_pending, f"WITH {C._EVENTS} SELECT root, path, max_by(kind, seq) AS kind FROM ev GROUP BY root, path"),
    "event_kind_map": (_native, "WITH e AS (SELECT list_extract([" + ", ".join(f"'{changes.NATIVE[x]}'" for x in _NATIVE) + f", NULL], CAST(event_id % {len(_NATIVE) + 1} + 1 AS INTEGER)) AS kind FROM events) SELECT kind, count(*) AS n FROM e GROUP BY kind"),
    "event_flags": (_flags, _FLAGS),
    "run_progress": (_progress, "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS root, count(*) AS visited, count(*) + max(user_id) AS total, round(avg(value), 2) AS rate, max(event_id) AS f FROM events GROUP BY user_id) SELECT CAST(sum(visited) AS BIGINT) AS visited, CAST(sum(total) AS BIGINT) AS total, CAST(floor(1000 * sum(visited) / sum(total)) AS BIGINT) AS permille, round(max(CASE WHEN rate > 0 THEN greatest(0, (total - visited) / rate) END), 6) AS eta, max_by(root, f) AS last_finished FROM e"),
    "remaining_and_formats": (_remaining, _REMAINING),
    "problem_list": (_problem_list, f"WITH {C._DOCS} SELECT path, CAST(CASE WHEN size % 3 = 0 THEN 5 ELSE size % 5 END AS INTEGER) AS problem, CAST(CASE WHEN size % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS seen_at FROM docs WHERE size % 5 <> 0 OR size % 3 = 0"),
    "registry_list": (_registry_list, f"WITH {C._DOCS} SELECT root, CASE WHEN root = '/src1' THEN 77 ELSE max(modified_time) END AS last_full_scan FROM docs GROUP BY root"),
    "batch_transaction": (_transaction, f"WITH {C._DOCS} SELECT root, count(*) AS n, CAST(sum(size + CASE WHEN root = '/src1' THEN 1 ELSE 0 END) AS BIGINT) AS size FROM docs GROUP BY root"),
    "count_and_last_id": (_counts, "SELECT count(*) FILTER (doc_id > 10) AS remaining, max(doc_id) AS last_id FROM documents"),
    "date_presets": (_presets, f"WITH {C._DOCS}, t AS (SELECT modified_time AS m, 1710084600 AS now FROM docs) SELECT count(*) AS n_any, count(*) FILTER (m >= now // 86400 * 86400) AS n_today, count(*) FILTER (m >= now - 7 * 86400) AS n_7days, count(*) FILTER (m >= now - 30 * 86400) AS n_30days, count(*) FILTER (m >= now - 365 * 86400) AS n_year FROM t"),
    "latest_search": (_latest, f"{C._hits_sql(C._DOCS, [C.W('erst', False)])} SELECT '\"erst\"' AS pattern, path FROM (SELECT path, row_number() OVER (ORDER BY {C._NOCASE}, path, root) AS rn FROM hits) WHERE rn <= 5"),
    "visible_excerpts": (_visible, f"{C._hits_sql(C._DOCS, [C.W('erst', False)])} SELECT path, true AS marked FROM (SELECT path, row_number() OVER (ORDER BY {C._NOCASE}, path, root) AS rn FROM hits) WHERE rn <= 20"),
    "parse_queries": (_parse_queries, _values(_PARSED, "raw, wanted, unwanted, phrases, ext, path")),
    "excerpt_rows": (_excerpts, _values([(i, e[3]) for i, e in enumerate(_EXCERPTS)], "i, snippet")),
    "extract_pieces": (_pieces, _values([(name, text) for name, _, _, text in _PIECES], "name, text")),
}


def queries() -> dict:
    return {name: _stored_page(q) for name, q in _PHRASES.items()} | {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict:
    return {name: C._SEARCHES[other][2] for name, other in _STORED_SQL.items()} | {name: sql for name, (_, sql) in _QUERIES.items()}
