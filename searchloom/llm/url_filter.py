"""Operator 10, URL filters: association rules mined by FP-growth, matched by an inverted index.

DataFrame, SQL and Spark ML's DataFrame API only. A url's items are its scheme, host suffixes, path parts and query
names; a labelled page's transaction also has the item ``=bad``. FP-growth mines combinations; those that imply
``=bad`` with enough support and confidence become rules. A rule matches a url that has all its items: url items join
the rules' posting lists (item -> rule), and a rule whose tally reaches its size fires.

Defined cases: a null url, or one without ``://``, has host and path ``''`` and no items, so it is allowed; repeated rows
are judged row by row; labels that are null or for unknown pages are ignored; no labels or empty tables: no rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: (verdict, host, path) of the explicit rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BAD = "=bad"
#: Rules in the inverted index are broadcast up to this many postings (a few MB), and joined by shuffle beyond.
BROADCAST_POSTINGS = 50_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased; path: from there up to ? # or end."""
    rest = F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def explicit(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. The rules are a short list kept in the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def items(host: Column, path: Column, url: Column) -> Column:
    """A url's distinct items, without empty ones."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "#")))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("q:"), x))
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([^:/?#]*)://", 1))))
    return F.when(host != "", F.array_distinct(F.concat(scheme, suffixes, parts, names))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_count: int = 10) -> DataFrame:
    """Rules (rule_id, items, size, confidence, support) from labelled(items, bad): items -> bad.

    A rule needs `min_support` of the labelled urls and `min_count` of them. One that has a single-item rule inside it is
    redundant and pruned.
    """
    baskets = labelled.where(F.size("items") > 0).select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    n = baskets.count()
    if n < min_count:
        return labelled.sparkSession.createDataFrame([], "rule_id bigint, items array<string>, size int, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    rules = rules.select(F.array_sort("antecedent").alias("items"), F.size("antecedent").alias("size"), "confidence", "support")
    rules = rules.select(F.xxhash64(F.array_join("items", "\n")).alias("rule_id"), "items", "size", "confidence", "support")
    single = rules.where("size = 1").select(F.element_at("items", 1).alias("item"))
    redundant = rules.where("size > 1").select("rule_id", F.explode("items").alias("item")).join(single, "item", "left_semi").select("rule_id").distinct()
    return rules.join(redundant, "rule_id", "left_anti")


def match(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """pages(key, items) -> (key, best confidence) of pages on which a rule fires, by inverted index and tally."""
    postings = rules.select("rule_id", "size", "confidence", F.explode("items").alias("item"))
    if postings.count() <= BROADCAST_POSTINGS:
        postings = F.broadcast(postings)
    hits = pages.select(key, F.explode("items").alias("item")).join(postings, "item")
    return hits.groupBy(key, "rule_id", "size", "confidence").count().where("count = size").groupBy(key).agg(F.max("confidence").alias("bad_confidence"))


def judge(pages: DataFrame, labels: DataFrame | None, rules: Sequence[tuple[str, str, str]] = RULES, min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """pages(page_id, url), labels(doc_id, quality, toxic) of the pages with that id ->
    (page_id, url, host, path, rule, verdict, bad_confidence).

    A label is bad if it is toxic or of quality 0. Distinct urls are matched once and joined back.
    """
    base = pages.select("page_id", "url")
    host, path = host_path(F.col("url"))
    parsed = base.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = parsed.select("url", "host", "path").distinct().withColumn("items", items(F.col("host"), F.col("path"), F.col("url")))
    if labels is None:
        scored = urls.select("url", F.lit(None).cast("double").alias("bad_confidence")).where("url is not null and false")
    else:
        bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"))
        labelled = parsed.join(bad, "page_id").select(items(F.col("host"), F.col("path"), F.col("url")).alias("items"), "bad")
        scored = match(urls.where("url is not null").select("url", "items"), mine(labelled, min_support, min_confidence), "url")
    out = parsed.join(scored, "url", "left")
    found = explicit(F.col("host"), F.col("path"), rules)
    return out.withColumn("found", found).select(
        "page_id", "url", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("bad_confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "bad_confidence",
    )
