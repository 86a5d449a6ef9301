"""Searches as one plan: filters, matching, per-source ranking, order, page, excerpts.

`docs` has root, path, name, ext, size, modified_time, content. Filters on its stored columns reach the scan.
Statistics of a source count all its documents, whichever the filters; they come out of the same scan as the hits. Ordering with a limit is a top-k per partition; excerpts join the texts to one page of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.functions.analysis import analyze, ascii_lower, lower_ascii_text, once
from searchloom.functions.ordering import tree_order
from searchloom.operators import snippet
from searchloom.operators.index import StoredIndex
from searchloom.operators.match import Phrase, bm25, idf, occurrences, phrase
from searchloom.plans.query import Parsed, SearchQuery, parse

RESULT = ["root", "path", "name", "ext", "size", "modified_time"]


def filters(q: SearchQuery, parsed: Parsed) -> Column:
    """ext:, path:, the type filter, the date filter and the chosen sources."""
    keep = F.lit(True)
    if parsed.ext:
        keep = keep & (ascii_lower(F.col("ext")) == parsed.ext)
    if q.extensions:
        keep = keep & ascii_lower(F.col("ext")).isin(*map(lower_ascii_text, q.extensions))
    if parsed.path:
        keep = keep & F.contains(ascii_lower(F.col("path")), F.lit(lower_ascii_text(parsed.path)))
    if q.modified_since:
        keep = keep & (F.col("modified_time") >= q.modified_since)
    if q.roots:
        keep = keep & F.col("root").isin(*q.roots)
    return keep


def _phrases(q: SearchQuery, parsed: Parsed) -> tuple[list[Phrase], list[Phrase]]:
    return [phrase(t, q.exact_words) for t in parsed.wanted], [phrase(t, q.exact_words) for t in parsed.unwanted]


def _counted(docs: DataFrame, q: SearchQuery, wanted: list[Phrase], unwanted: list[Phrase]) -> DataFrame:
    """docs' result columns, length, and for each phrase its occurrences in name (n0, ..) and content (c0, ..). A text is split once."""
    cols = [c for c in RESULT if c in docs.columns]
    words = once(docs, [*map(F.col, cols), analyze(F.col("name"), q.exact_words).alias("nw"), analyze(F.col("content"), q.exact_words).alias("cw")])
    each = []
    for k, p in enumerate([*wanted, *unwanted]):
        each += [occurrences(F.col("nw"), p).alias(f"n{k}"), occurrences(F.col("cw"), p).alias(f"c{k}")]
    return words.select(*cols, (F.size("nw") + F.size("cw")).alias("length"), *each)


def _has(k: int) -> Column:
    return F.col(f"n{k}") + F.col(f"c{k}") > 0


def _matching(q: SearchQuery, wanted: list[Phrase], unwanted: list[Phrase]) -> Column:
    keep = F.lit(True)
    for k in range(len(wanted)):
        keep = keep & _has(k)
    if unwanted:
        bad = [_has(len(wanted) + k) for k in range(len(unwanted))]
        out = bad[0]
        for b in bad[1:]:
            out = out | b if q.exclude_any else out & b
        keep = keep & ~out
    return keep


def _unscored(docs: DataFrame, q: SearchQuery, parsed: Parsed) -> DataFrame:
    """Matching documents; filters on stored columns come first and reach the scan, statistics aren't needed."""
    wanted, unwanted = _phrases(q, parsed)
    kept = docs.where(filters(q, parsed))
    if not wanted and not unwanted:
        return kept.select(*RESULT)
    return _counted(kept, q, wanted, unwanted).where(_matching(q, wanted, unwanted)).select(*RESULT)


def matches(docs: DataFrame, q: SearchQuery) -> DataFrame:
    """All matching documents with relevance_score, without order or page.

    One scan gives the hits and their sources' statistics: before the only shuffle of documents, all that don't match become one row of
    each source and task, which holds their number, lengths and phrases. Hits and statistics both read that shuffle.
    """
    parsed = parse(q.pattern)
    wanted, unwanted = _phrases(q, parsed)
    if not wanted:
        return _unscored(docs, q, parsed).withColumn("relevance_score", F.lit(0.0))
    if q.roots:
        docs = docs.where(F.col("root").isin(*q.roots))
    ks = range(len(wanted))
    counted = _counted(docs, q, wanted, unwanted)
    hit = F.when(filters(q, parsed) & _matching(q, wanted, unwanted), F.struct(*RESULT[1:], "length", *[x for k in ks for x in (f"n{k}", f"c{k}")]))
    sums = [F.count("*").alias("copies"), F.sum("length").alias("words"), *[F.sum(_has(k).cast("long")).alias(f"df{k}") for k in ks]]
    met = counted.groupBy("root", hit.alias("hit")).agg(*sums)
    met = once(met, [F.col(c) for c in met.columns])
    stats = met.groupBy("root").agg(F.sum("copies").alias("n_docs"), (F.sum("words") / F.sum("copies")).alias("mean_length"), *[F.sum(f"df{k}").alias(f"df{k}") for k in ks])
    hits = met.where("hit is not null").select("root", "hit.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    idfs = [idf(F.col("n_docs"), F.col(f"df{k}")) for k in ks]
    score = bm25([F.col(f"n{k}") for k in ks], [F.col(f"c{k}") for k in ks], idfs, F.col("length"), F.col("mean_length"))
    return hits.join(stats, "root").select(*RESULT, score.alias("relevance_score"))


def statistics(docs: DataFrame, q: SearchQuery) -> DataFrame:
    """Per source: documents, mean length in words, and documents with each wanted phrase (df0, ..)."""
    wanted, _ = _phrases(q, parse(q.pattern))
    counted = _counted(docs, q, wanted, [])
    return counted.groupBy("root").agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"), *[F.sum(_has(k).cast("long")).alias(f"df{k}") for k in range(len(wanted))])


def order(q: SearchQuery, browsing: bool) -> list[Column]:
    """The sort, with name, path and source as tie-breaks in every case."""
    way = lambda c: c.desc() if q.descending else c.asc()
    name, ties = ascii_lower(F.col("name")), [ascii_lower(F.col("name")).asc(), F.col("path").asc(), F.col("root").asc()]
    if q.sort_field == "path":
        return [*tree_order(F.col("path"), q.folders_first, q.descending), F.col("root").asc()]
    if q.sort_field == "name" or q.sort_field == "relevance" and browsing:
        return [way(name), *ties]
    field = {"relevance": F.round("relevance_score", 9), "modified": F.col("modified_time"), "size": F.col("size")}[q.sort_field]
    return [way(field), *ties]


def search(docs: DataFrame, q: SearchQuery) -> DataFrame:
    """One page of results over all sources, in order."""
    return _page(matches(docs, q), docs, q)


def _page(found: DataFrame, docs: DataFrame | None, q: SearchQuery) -> DataFrame:
    parsed = parse(q.pattern)
    ordering = order(q, not parsed.wanted)
    found = found.orderBy(*ordering)
    if q.offset:
        found = found.offset(q.offset)
    if q.limit is not None:
        found = found.limit(q.limit)
    if not q.with_snippets or docs is None:
        return found
    wanted, _ = _phrases(q, parsed)
    if q.limit is None:
        return snippet.add(found.join(docs.select("root", "path", "content"), ["root", "path"]), wanted, q.exact_words).orderBy(*ordering)
    page = F.broadcast(found).join(docs.select("root", "path", "content"), ["root", "path"])  # a page has `limit` rows at most
    return snippet.add(page, wanted, q.exact_words).orderBy(*ordering).limit(q.limit)


def search_stored(index: StoredIndex, files: DataFrame, q: SearchQuery, docs: DataFrame | None = None) -> DataFrame:
    """The same page by a stored index (of the analyzer that the query asks for): reads the lists of the query's words, not the texts.

    files has the result columns; docs, if given, the texts for excerpts.
    """
    parsed = parse(q.pattern)
    wanted, unwanted = _phrases(q, parsed)
    keep = files.where(filters(q, parsed)).select(*RESULT)
    found = keep.join(index.score(wanted), ["root", "path"]) if wanted else keep.withColumn("relevance_score", F.lit(0.0))
    bad = None
    for p in unwanted:
        own = index.occurrences(p).select("root", "path")
        bad = own if bad is None else bad.union(own).distinct() if q.exclude_any else bad.join(own, ["root", "path"])
    if bad is not None:
        found = found.join(bad, ["root", "path"], "left_anti")
    return _page(found.select(*RESULT, "relevance_score"), docs, q)


def count(docs: DataFrame, q: SearchQuery) -> DataFrame:
    """(root, n): matches per source, whichever the page. Nothing is scored, so only one scan of the filtered documents is left."""
    return _unscored(docs, q, parse(q.pattern)).groupBy("root").agg(F.count("*").alias("n"))


def snippet_of(docs: DataFrame, path: str, q: SearchQuery) -> str:
    """The excerpt of one document; '' if it is unknown or nothing is searched for."""
    wanted, _ = _phrases(q, parse(q.pattern))
    row = docs.where(F.col("path") == path).select("content").first() if wanted else None
    if row is None:
        return ""
    return (snippet.exact if q.exact_words else snippet.forms)(row["content"] or "", wanted)
