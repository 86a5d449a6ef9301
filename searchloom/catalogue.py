"""The registered queries of the engine, over whole tables, and their SQL.

The driver's tables stand in for a corpus: a document's source is its root, its language a folder, and `documents.text` its content;
pages are .html files under their urls; conversations are a file for each turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from searchloom.functions import analysis, files, ordering, stemmer
from searchloom.operators import maintain, metrics
from searchloom.plans import search as S
from searchloom.plans.query import SearchQuery, parse
from searchloom.streaming import changes

Q = SearchQuery
EXTS = (".txt", ".md", ".PDF", ".docx", ".log")


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    d = _read(spark, sf, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (F.col("doc_id") % 5 + 1).cast("int"))
    d = d.select("doc_id", F.concat(F.lit("/"), "source").alias("root"), "lang", ext.alias("ext"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), ext).alias("name"), F.col("n_chars").alias("size"), (F.lit(1_700_000_000) + F.col("doc_id") * 3600).alias("modified_time"), F.col("text").alias("content"))
    return d.withColumn("path", F.concat_ws("/", "root", "lang", "name"))


def page_corpus(spark: SparkSession, sf: str) -> DataFrame:
    p = _read(spark, sf, "pages")
    return p.select(F.lit("/web").alias("root"), F.col("url").alias("path"), files.base_name(F.col("url")).alias("name"), F.lit(".html").alias("ext"), F.length("html").cast("long").alias("size"), F.col("page_id").alias("modified_time"), F.col("html").alias("content"))


def talk_corpus(spark: SparkSession, sf: str) -> DataFrame:
    c = _read(spark, sf, "conversations")
    name = F.concat(F.col("turn").cast("string"), F.lit("-"), F.col("role"), F.lit(".txt"))
    return c.select(F.lit("/conv").alias("root"), F.concat(F.lit("/conv/"), F.col("conv_id").cast("string"), F.lit("/"), name).alias("path"), name.alias("name"), F.lit(".txt").alias("ext"), F.length("text").cast("long").alias("size"), F.col("turn").cast("long").alias("modified_time"), F.col("text").alias("content"))


_DOCS = """docs AS (SELECT doc_id, '/' || source AS root, lang, ext, 'Doc ' || doc_id || ext AS name, n_chars AS size, 1700000000 + doc_id * 3600 AS modified_time, text AS content,
 '/' || source || '/' || lang || '/Doc ' || doc_id || ext AS path FROM (SELECT *, list_extract(['.txt', '.md', '.PDF', '.docx', '.log'], CAST(doc_id % 5 + 1 AS INTEGER)) AS ext FROM documents))"""
_PAGES = """docs AS (SELECT '/web' AS root, url AS path, regexp_extract(url, '[^/]*$') AS name, '.html' AS ext, length(html) AS size, page_id AS modified_time, html AS content FROM pages)"""
_TALKS = """docs AS (SELECT '/conv' AS root, '/conv/' || conv_id || '/' || turn || '-' || role || '.txt' AS path, turn || '-' || role || '.txt' AS name, '.txt' AS ext, length(text) AS size, turn AS modified_time, text AS content FROM conversations)"""
_NOCASE = "translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _toks(c: str) -> str:
    a, b = analysis.fold_table()
    return f"regexp_extract_all(translate(lower({c}), '{a}', '{b}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def _occ(t: str, phrase: tuple[str, ...], prefix: bool) -> str:
    test = lambda x, w, last: f"starts_with({x}, '{w}')" if prefix and last else f"{x} = '{w}'"
    n = len(phrase)
    if n == 1:
        return f"len(list_filter({t}, lambda x: {test('x', phrase[0], True)}))"
    each = " AND ".join(test(f"{t}[i + {k}]", w, k == n - 1) for k, w in enumerate(phrase))
    return f"len(list_filter(range(1, len({t}) - {n - 2}), lambda i: {each}))"


def _hits_sql(base: str, wanted, unwanted=(), where: str = "true") -> str:
    """CTEs up to hits(root, path, name, ext, size, modified_time, score). A phrase is (words, prefix)."""
    cols = "".join(f", {_occ('nw', *p)} AS n{k}, {_occ('cw', *p)} AS c{k}" for k, p in enumerate([*wanted, *unwanted]))
    match = " AND ".join(f"n{k} + c{k} > 0" for k in range(len(wanted))) or "true"
    if unwanted:
        match += " AND NOT (" + " AND ".join(f"n{k + len(wanted)} + c{k + len(wanted)} > 0" for k in range(len(unwanted))) + ")"
    df = "".join(f", sum(CASE WHEN n{k} + c{k} > 0 THEN 1 ELSE 0 END) AS df{k}" for k in range(len(wanted)))
    score = " ".join(f"- greatest(ln((nd - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * (10.0 * n{k} + c{k}) * 2.2 / (10.0 * n{k} + c{k} + 1.2 * (0.25 + 0.75 * len_ / mean))" for k in range(len(wanted)))
    return f"""WITH {base}, w AS (SELECT *, {_toks('name')} AS nw, {_toks('content')} AS cw FROM docs),
t AS (SELECT root, path, name, ext, size, modified_time, len(nw) + len(cw) AS len_{cols} FROM w),
st AS (SELECT root AS r, count(*) AS nd, avg(len_) AS mean{df} FROM t GROUP BY root),
hits AS (SELECT root, path, name, ext, size, modified_time, 0.0e0 {score} AS score FROM t JOIN st ON root = r WHERE ({match}) AND ({where}))"""


def _page(spark, sf, q: SearchQuery, docs=corpus) -> DataFrame:
    """A page of results with its row numbers and rounded scores; the page is small, so one window orders it."""
    found = S.search(docs(spark, sf), q)
    rn = F.row_number().over(Window.orderBy(*S.order(q, not parse(q.pattern).wanted)))
    return found.select((rn + q.offset).alias("rn"), "root", "path", F.round("relevance_score", 6).alias("score"))


def _page_sql(hits: str, order: str, limit: int = 200, offset: int = 0) -> str:
    ties = f"{_NOCASE}, path, root"
    return f"{hits}, o AS (SELECT *, row_number() OVER (ORDER BY {order}, {ties}) AS rn FROM hits) SELECT rn, root, path, round(score, 6) AS score FROM o WHERE rn > {offset} AND rn <= {offset + limit}"


_BEST, _WORST = "round(score, 9)", "round(score, 9) DESC"
W = lambda w, prefix=True: ((w,), prefix)

#: name -> (query, corpus, SQL)
_SEARCHES: dict[str, tuple] = {
    "browse_nocase": (Q(), corpus, _page_sql(_hits_sql(_DOCS, []), _NOCASE)),
    "browse_desc_size": (Q(sort_field="size", descending=True), corpus, _page_sql(_hits_sql(_DOCS, []), "size DESC")),
    "browse_recent": (Q(sort_field="modified", descending=True), corpus, _page_sql(_hits_sql(_DOCS, []), "modified_time DESC")),
    "browse_page2": (Q(limit=100, offset=200), corpus, _page_sql(_hits_sql(_DOCS, []), _NOCASE, 100, 200)),
    "term_bm25": (Q('"erst"'), corpus, _page_sql(_hits_sql(_DOCS, [W("erst", False)]), _BEST)),
    "two_terms_bm25": (Q("the of -and ext:md", limit=20), corpus, _page_sql(_hits_sql(_DOCS, [W("the"), W("of")], [W("and")], "ext = '.md'"), _BEST, 20)),
    "bm25_name_boost": (Q("doc 12"), corpus, _page_sql(_hits_sql(_DOCS, [W("doc"), W("12")]), _BEST)),
    "bm25_desc": (Q("erst", descending=True), corpus, _page_sql(_hits_sql(_DOCS, [W("erst")]), _WORST)),
    "prefix_term": (Q("ere"), corpus, _page_sql(_hits_sql(_DOCS, [W("ere")]), _BEST)),
    "prefix_multi_token": (Q("doc_1"), corpus, _page_sql(_hits_sql(_DOCS, [(("doc", "1"), True)]), _BEST)),
    "phrase_match": (Q('"of the"'), corpus, _page_sql(_hits_sql(_DOCS, [(("of", "the"), False)]), _BEST)),
    "phrase_in_one_column": (Q('doc_1 "of the"'), corpus, _page_sql(_hits_sql(_DOCS, [(("doc", "1"), True), (("of", "the"), False)]), _BEST)),
    "exclude_one": (Q("the -tion"), corpus, _page_sql(_hits_sql(_DOCS, [W("the")], [W("tion")]), _BEST)),
    "exclude_two_anded": (Q("the -erst -ondoc"), corpus, _page_sql(_hits_sql(_DOCS, [W("the")], [W("erst"), W("ondoc")]), _BEST)),
    "exclude_only": (Q("-the"), corpus, _page_sql(_hits_sql(_DOCS, [], [W("the")]), _NOCASE)),
    "punct_excluded": (Q("the -!!!"), corpus, _page_sql(_hits_sql(_DOCS, [W("the")]), _BEST)),
    "exact_mode": (Q("erst", exact_words=True), corpus, _page_sql(_hits_sql(_DOCS, [W("erst", False)]), _BEST)),
    "diacritic_fold": (Q("etre", exact_words=True), corpus, _page_sql(_hits_sql(_DOCS, [W("etre", False)]), _BEST)),
    "ext_operator": (Q("ext:pdf"), corpus, _page_sql(_hits_sql(_DOCS, [], (), "lower(ext) = '.pdf'"), _NOCASE)),
    "type_group": (Q(extensions=files.group_extensions("word")), corpus, _page_sql(_hits_sql(_DOCS, [], (), "lower(ext) IN ('.doc', '.docx', '.docm', '.dot', '.dotx', '.rtf', '.odt')"), _NOCASE)),
    "path_contains_ascii_ci": (Q("path:/FR/doc"), corpus, _page_sql(_hits_sql(_DOCS, [], (), "contains(lower(path), '/fr/doc')"), _NOCASE)),
    "modified_since": (Q("the", modified_since=1_701_000_000), corpus, _page_sql(_hits_sql(_DOCS, [W("the")], (), "modified_time >= 1701000000"), _BEST)),
    "all_filters": (Q("the ext:txt path:/en/ -erst", extensions=(".TXT", ".md"), modified_since=1_700_500_000, sort_field="name"), corpus, _page_sql(_hits_sql(_DOCS, [W("the")], [W("erst")], "ext = '.txt' AND contains(path, '/en/') AND modified_time >= 1700500000"), _NOCASE)),
    "merge_sources_topk": (Q("the", sort_field="name", limit=50, offset=25), corpus, _page_sql(_hits_sql(_DOCS, [W("the")]), _NOCASE, 50, 25)),
    "pages_search": (Q('"html lang" utf'), page_corpus, _page_sql(_hits_sql(_PAGES, [(("html", "lang"), False), W("utf")]), _BEST)),
    "conversations_phrase": (Q('"of the" assistant'), talk_corpus, _page_sql(_hits_sql(_TALKS, [(("of", "the"), False), W("assistant")]), _BEST)),
}

_FROM, _TO = ordering._FROM, ordering._TO


def _key_sql(path: str, folders_first: bool, descending: bool, whole: bool = True) -> str:
    s = -1 if descending else 1
    run = f"list_concat([{s * 0x31}, {s} * len(ltrim(x, '0'))], list_transform(list_filter(string_split(ltrim(x, '0'), ''), lambda d: d <> ''), lambda d: {s} * (unicode(d) - 47)))"
    pieces = lambda p: f"flatten(list_transform(regexp_extract_all(translate({p}, '{_FROM}', '{_TO}'), '[0-9]+|[^0-9]'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN {run} ELSE [{s} * (unicode(x) + 1)] END))"
    if not whole:
        return f"list_concat({pieces(path)}, [0])"
    parts = f"regexp_split_to_array({path}, '[/\\\\]')"
    kind = f"CASE WHEN (i = len({parts})) = {str(folders_first).lower()} THEN 1 ELSE 0 END"
    return f"flatten(list_transform(range(1, len({parts}) + 1), lambda i: list_concat(list_concat([{kind}], {pieces(f'{parts}[i]')}), [0])))"


def _text(key: Column) -> Column:
    return F.array_join(F.transform(key, lambda x: x.cast("string")), " ")


def _tree(folders_first: bool, descending: bool):
    return lambda spark, sf: corpus(spark, sf).select("path", _text(ordering.tree_key(F.col("path"), folders_first, descending)).alias("key"))


def _tree_sql(folders_first: bool, descending: bool) -> str:
    return f"WITH {_DOCS} SELECT path, array_to_string({_key_sql('path', folders_first, descending)}, ' ') AS key FROM docs"


def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two states of all documents: some moved, some of another size."""
    d = corpus(spark, sf)
    new = d.withColumn("path", F.when(F.col("size") % 7 == 0, F.concat_ws("/", "root", F.lit("moved"), "name")).otherwise(F.col("path"))).withColumn("size", F.when(F.col("size") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return d, new


_SNAPSHOTS = f"""{_DOCS}, new AS (SELECT root, CASE WHEN size % 7 = 0 THEN root || '/moved/' || name ELSE path END AS path, CASE WHEN size % 11 = 0 THEN size + 1 ELSE size END AS size, modified_time, name, ext FROM docs),
act AS (SELECT coalesce(o.root, n.root) AS root, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'vanished' WHEN o.size = n.size AND o.modified_time = n.modified_time THEN 'unchanged' ELSE 'changed' END AS action
 FROM docs o FULL JOIN new n ON o.root = n.root AND o.path = n.path)"""


def _problems(spark, sf) -> DataFrame:
    return corpus(spark, sf).select("path", "root", (F.col("size") % 7).cast("int").alias("problem"), (F.lit(1000) + F.col("size") % 3).cast("long").alias("seen_at"))


_EVENT_KINDS = {"signup": "Created", "view": "Modified", "click": "Modified", "purchase": "RenamedTo", "error": "Removed"}


def _events(spark, sf) -> DataFrame:
    e = _read(spark, sf, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _EVENT_KINDS.items() for x in kv]), F.col("event_type"))
    return e.select(F.col("event_id").alias("seq"), "ts", F.concat(F.lit("/r"), (F.col("user_id") % 3).cast("string")).alias("root"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), kind.alias("kind"))


_EVENTS = """ev AS (SELECT event_id AS seq, ts, '/r' || (user_id % 3) AS root, '/u/' || user_id AS path, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'view' THEN 'Modified' WHEN 'click' THEN 'Modified' WHEN 'purchase' THEN 'RenamedTo' WHEN 'error' THEN 'Removed' END AS kind FROM events)"""
_SESSIONS = f"""{_EVENTS}, i AS (SELECT DISTINCT ts FROM ev), g AS (SELECT ts, CASE WHEN lag(ts) OVER (ORDER BY ts) IS NULL OR ts > lag(ts) OVER (ORDER BY ts) + INTERVAL 30 SECOND THEN ts END AS s FROM i),
se AS (SELECT ts, max(s) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)"""


def _timings(spark, sf) -> DataFrame:
    e = _read(spark, sf, "events")
    part = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0))
    return e.groupBy(F.col("user_id").cast("string").alias("root")).agg(part("view").alias("read"), part("click").alias("parse"), part("purchase").alias("write"), part("error").alias("walk"))


_TIMINGS = """tm AS (SELECT CAST(user_id AS VARCHAR) AS root, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS read, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS parse,
 sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS write, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS walk FROM events GROUP BY user_id)"""


def _stage_shares(spark, sf):
    s = metrics.stage_shares(_timings(spark, sf))
    return s.select("root", *[F.round(f"{x}_pct", 4).alias(f"{x}_pct") for x in metrics.STAGES], "dominant")


def _exact_vs_forms(spark, sf):
    d = corpus(spark, sf)
    n = lambda q, name: S.matches(d, q).agg(F.count("*").alias("n")).select(F.lit(name).alias("mode"), "n")
    return n(Q("erst", exact_words=True), "exact").union(n(Q("erst"), "forms"))


def _punct_only(spark, sf):
    """A term without words matches nothing, and excludes nothing."""
    d, out = corpus(spark, sf), None
    for q in ("the !!!", "!!!", "the -!!!"):
        own = S.count(d, Q(q)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(q).alias("query"), "n")
        out = own if out is None else out.union(own)
    return out


def _excerpts(exact: bool):
    return lambda spark, sf: S.search(corpus(spark, sf), Q("erst the", with_snippets=True, exact_words=exact, limit=50)).select("path", "snippet")


def _upsert(spark, sf):
    old, new = _snapshots(spark, sf)
    cols = ["root", "path", "name", "ext", "size", "modified_time"]
    return maintain.upsert(old.select(*cols), new.select(*cols)).select("root", "path", "size")


def _remove_path(spark, sf):
    old, new = _snapshots(spark, sf)
    return maintain.remove(old.select("root", "path", "size"), new.where("size % 2 = 0").select("root", "path"))


def _unreadable(spark, sf):
    old, new = _snapshots(spark, sf)
    folders = old.where("lang = 'fr'").select("root", F.concat_ws("/", "root", "lang").alias("folder")).distinct()
    off = old.where("root = '/src3'").select("root").distinct()
    return maintain.reconcile(old, new, folders, off).groupBy("root", "action").agg(F.count("*").alias("n"))


def _retry(spark, sf):
    p = _problems(spark, sf)
    return maintain.retry_outcome(p.select("path"), p.where("problem <> 0"), 1001).groupBy("outcome").agg(F.count("*").alias("n"))


def _longest_root(spark, sf):
    d = corpus(spark, sf)
    roots = d.select("root").union(d.select(F.concat_ws("/", "root", "lang").alias("root"))).union(d.select(F.concat("root", F.lit("/f")).alias("root"))).distinct()
    return maintain.longest_root(d.select("path"), roots)


def _backfill(spark, sf):
    return maintain.backfill_batch(corpus(spark, sf).withColumn("id", F.col("doc_id")), 100, 10**12, 200).select("id", "path")


def _registry(spark, sf):
    d = corpus(spark, sf)
    sources = d.groupBy("root").agg(F.min("path").alias("db_path"), F.max("modified_time").alias("last_full_scan"))
    rows = d.where("lang = 'fr'").select("root").union(spark.createDataFrame([("/new",)], "root string")).distinct().withColumn("db_path", F.concat(files.store_name(F.col("root")), F.lit(".db"))).withColumn("last_full_scan", F.lit(7).cast("long"))
    return maintain.registry_upsert(sources, rows)


def _masks(spark, sf):
    p = page_corpus(spark, sf)
    return p.select("path", files.excluded(F.substr(F.col("path"), F.instr("path", "://") + 3, F.length("path")), ["*.html", "BLOG.*", "e?"]).alias("masked"))


def _heavy(spark, sf):
    return corpus(spark, sf).select("path", files.text_bytes(F.col("ext"), F.col("size")).alias("expected"), files.heavy(F.col("ext"), F.col("size"), 4000).alias("heavy"))


def _stem_vocab(spark, sf):
    words = spark.createDataFrame([(w,) for w in ("практикума", "программой", "читали", "красивые", "hello", "ёлки", "и")], "word string")
    d = corpus(spark, sf).select(F.explode(analysis.words(F.col("content"))).alias("word")).distinct().union(words)
    return d.distinct().select("word", stemmer.stem_column(F.col("word")).alias("stem"))


def _cyrillic_keys(spark, sf):
    names = spark.createDataFrame([(x,) for x in ("ёлка", "Ежевика", "Жук", "Договор 2.docx", "Договор 10.docx", "007", "8")], "name string")
    return names.select("name", _text(ordering.natural_key(F.col("name"))).alias("key"))


def _presented(spark, sf):
    return corpus(spark, sf).select("path", files.base_name(F.col("path")).alias("base"), files.extension(F.col("name")).alias("ext"), files.extractable(F.col("ext")).alias("readable"), files.time_text(F.col("modified_time")).alias("changed"))


_OTHERS: dict[str, tuple] = {
    "exact_vs_forms_count": (_exact_vs_forms, f"{_hits_sql(_DOCS, [W('erst', False)])} SELECT 'exact' AS mode, count(*) AS n FROM hits UNION ALL SELECT 'forms', (SELECT count(*) FROM w WHERE {_occ('nw', ('erst',), True)} + {_occ('cw', ('erst',), True)} > 0)"),
    "punct_only": (_punct_only, f"{_hits_sql(_DOCS, [W('the')])} SELECT 'the -!!!' AS query, count(*) AS n FROM hits UNION ALL SELECT 'the !!!', 0 UNION ALL SELECT '!!!', 0"),
    "order_path_folders": (_tree(True, False), _tree_sql(True, False)),
    "order_path_folders_desc": (_tree(True, True), _tree_sql(True, True)),
    "order_path_files": (_tree(False, False), _tree_sql(False, False)),
    "order_path_files_desc": (_tree(False, True), _tree_sql(False, True)),
    "order_name_natural": (lambda spark, sf: corpus(spark, sf).select("path", _text(ordering.natural_key(F.col("name"))).alias("key")), f"WITH {_DOCS} SELECT path, array_to_string({_key_sql('name', True, False, False)}, ' ') AS key FROM docs"),
    "merge_sources_count": (lambda spark, sf: S.count(corpus(spark, sf), Q("the -erst")), f"{_hits_sql(_DOCS, [W('the')], [W('erst')])} SELECT root, count(*) AS n FROM hits GROUP BY root"),
    "per_source_stats": (lambda spark, sf: S.statistics(corpus(spark, sf), Q("the ere")).select("root", "n_docs", F.round("mean_length", 6).alias("mean_length"), "df0", "df1"), f"{_hits_sql(_DOCS, [W('the'), W('ere')])} SELECT r AS root, nd AS n_docs, round(mean, 6) AS mean_length, CAST(df0 AS BIGINT) AS df0, CAST(df1 AS BIGINT) AS df1 FROM st"),
    "snippet_exact": (_excerpts(True), None),
    "snippet_forms": (_excerpts(False), None),
    "upsert_merge": (_upsert, f"WITH {_SNAPSHOTS} SELECT root, path, size FROM new UNION ALL SELECT root, path, size FROM docs o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.root = o.root AND n.path = o.path)"),
    "remove_path": (_remove_path, f"WITH {_SNAPSHOTS} SELECT root, path, size FROM docs o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.size % 2 = 0 AND n.root = o.root AND n.path = o.path)"),
    "remove_under": (lambda spark, sf: maintain.remove_under(corpus(spark, sf), "/src1/").select("root", "path"), f"WITH {_DOCS} SELECT root, path FROM docs WHERE NOT starts_with(path, '/src1/')"),
    "fts_files_join": (None, f"{_hits_sql(_DOCS, [W('erst', False)])} SELECT h.root, h.path, d.doc_id, d.size FROM hits h JOIN docs d ON h.root = d.root AND h.path = d.path"),
    "reconcile_actions": (lambda spark, sf: maintain.reconcile(*_snapshots(spark, sf)), f"WITH {_SNAPSHOTS} SELECT root, path, CASE action WHEN 'vanished' THEN 'remove' ELSE action END AS action FROM act"),
    "reconcile_unreadable": (_unreadable, f"WITH {_SNAPSHOTS} SELECT root, CASE WHEN action <> 'vanished' THEN action WHEN root = '/src3' OR contains(path, '/fr/') THEN 'kept' ELSE 'remove' END AS action, count(*) AS n FROM act GROUP BY 1, 2"),
    "vanished_anti": (lambda spark, sf: (lambda o, n: maintain.remove(o.select("root", "path"), n.select("root", "path")))(*_snapshots(spark, sf)), f"WITH {_SNAPSHOTS} SELECT root, path FROM act WHERE action = 'vanished'"),
    "retry_outcome": (_retry, f"WITH {_DOCS} SELECT CASE WHEN size % 7 = 0 THEN 'fixed' WHEN 1000 + size % 3 < 1001 THEN 'waiting' ELSE 'failing' END AS outcome, count(*) AS n FROM docs GROUP BY 1"),
    "problems_rollup": (lambda spark, sf: maintain.problems_by_reason(_problems(spark, sf)), f"WITH {_DOCS} SELECT CAST(size % 7 AS INTEGER) AS problem, count(*) AS n FROM docs WHERE size % 7 <> 0 GROUP BY ROLLUP (CAST(size % 7 AS INTEGER))"),
    "longest_prefix_root": (_longest_root, f"WITH {_DOCS}, r AS (SELECT DISTINCT unnest([root, root || '/' || lang, root || '/f']) AS root FROM docs) SELECT path, max_by(r.root, length(r.root)) AS root FROM docs JOIN r ON starts_with(path, r.root) GROUP BY path"),
    "backfill_batch": (_backfill, f"WITH {_DOCS} SELECT doc_id AS id, path FROM docs WHERE doc_id > 100 ORDER BY doc_id LIMIT 200"),
    "registry_upsert": (_registry, f"WITH {_DOCS}, s AS (SELECT root, min(path) AS db_path, max(modified_time) AS t FROM docs GROUP BY root), u AS (SELECT DISTINCT root FROM docs WHERE lang = 'fr' UNION SELECT '/new') SELECT coalesce(u.root, s.root) AS root, CASE WHEN u.root IS NULL THEN s.db_path ELSE replace(u.root, '/', '_') || '.db' END AS db_path, coalesce(s.t, 7) AS last_full_scan FROM s FULL JOIN u ON s.root = u.root"),
    "mask_filter": (_masks, "SELECT url AS path, len(list_filter(string_split(regexp_extract(url, '://(.*)$', 1), '/'), lambda x: regexp_matches(lower(x), '^(.*\\.html|blog\\..*|e.)$') OR regexp_matches(x, '^~\\$.'))) > 0 AS masked FROM pages"),
    "heavy_split": (_heavy, f"WITH {_DOCS}, e AS (SELECT path, CASE ext WHEN '.docx' THEN size * 2 WHEN '.PDF' THEN size // 4 ELSE size END AS expected FROM docs) SELECT path, expected, expected > 4000 AS heavy FROM e"),
    "stage_shares": (_stage_shares, f"WITH {_TIMINGS}, t AS (SELECT *, read + parse + write + walk AS total, greatest(read, parse, write, walk) AS top FROM tm) SELECT root, " + ", ".join(f"round(CASE WHEN total > 0 THEN 100.0 * {s} / total ELSE 0 END, 4) AS {s}_pct" for s in metrics.STAGES) + ", CASE top WHEN read THEN 'read' WHEN parse THEN 'parse' WHEN write THEN 'write' ELSE 'walk' END AS dominant FROM t"),
    "advice": (lambda spark, sf: metrics.advice(_timings(spark, sf)), f"WITH {_TIMINGS}, t AS (SELECT *, read + parse + write + walk AS total, greatest(read, parse, write, walk) AS top FROM tm) SELECT root, CASE WHEN total < 3 THEN 'none' WHEN top / total < 0.4 THEN 'even' WHEN top = read THEN 'read' WHEN top = parse THEN 'parse' WHEN top = write THEN 'write' ELSE 'walk' END AS advice FROM t"),
    "ewma_rate": (lambda spark, sf: metrics.ewma(_read(spark, sf, "events").select(F.col("user_id").cast("string").alias("root"), F.struct("ts", "event_id").alias("ts"), F.col("value").alias("rate"))).select("root", F.round("rate", 6).alias("rate")), "WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r AS (SELECT user_id, CAST(value AS DOUBLE) AS v, k FROM s WHERE k = 1 UNION ALL SELECT s.user_id, 0.7 * r.v + 0.3 * s.value, s.k FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1) SELECT CAST(user_id AS VARCHAR) AS root, round(max_by(v, k), 6) AS rate FROM r GROUP BY user_id"),
    "stem_vocab": (_stem_vocab, f"WITH {_DOCS}, v AS (SELECT DISTINCT unnest({_toks('content')}) AS word FROM docs) SELECT word, word AS stem FROM v UNION SELECT * FROM (VALUES ('практикума', 'практикум'), ('программой', 'программ'), ('читали', 'чита'), ('красивые', 'красив'), ('hello', 'hello'), ('ёлки', 'елк'), ('и', 'и'))"),
    "order_key_cyrillic": (_cyrillic_keys, f"SELECT name, array_to_string({_key_sql('name', True, False, False)}, ' ') AS key FROM (VALUES ('ёлка'), ('Ежевика'), ('Жук'), ('Договор 2.docx'), ('Договор 10.docx'), ('007'), ('8')) t(name)"),
    "events_coalesced": (lambda spark, sf: changes.latest(_events(spark, sf)).select("root", "path", "kind", "n"), f"WITH {_EVENTS} SELECT root, path, max_by(kind, seq) AS kind, count(*) AS n FROM ev GROUP BY root, path"),
    "events_session": (lambda spark, sf: changes.coalesced(_events(spark, sf), "30 seconds").select(F.date_format("session", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session"), "root", "path", "kind", "n"), f"WITH {_SESSIONS} SELECT strftime(session, '%Y-%m-%d %H:%M:%S.%f') AS session, root, path, max_by(kind, seq) AS kind, count(*) AS n FROM ev JOIN se USING (ts) GROUP BY session, root, path"),
    "file_columns": (_presented, f"WITH {_DOCS} SELECT path, name AS base, ext, true AS readable, strftime(make_timestamp(modified_time * 1000000), '%d.%m.%Y %H:%M') AS changed FROM docs"),
}


def queries() -> dict:
    """All queries of the engine."""
    from searchloom import catalogue_runs

    out = {name: (lambda spark, sf, q=q, docs=docs: _page(spark, sf, q, docs)) for name, (q, docs, _) in _SEARCHES.items()}
    return out | {name: f for name, (f, _) in _OTHERS.items()} | catalogue_runs.queries()


def oracle_sql() -> dict:
    from searchloom import catalogue_runs

    return {name: sql for name, (*_, sql) in [*_SEARCHES.items(), *_OTHERS.items()] if sql} | catalogue_runs.oracle_sql()
