import math
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from searchloom.llm import url_filter as uf
from searchloom.llm.queries import op10_url_rules

from .helpers import SF


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    i = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:i])
    rest = rest[i:]
    j = next((k for k, c in enumerate(rest) if c in "?#"), len(rest))
    return host, rest[:j]


def test_whole_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op10_url_rules(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.host, r.path) == brute_parts(pages[r.page_id])
        rule, verdict = brute_rule(r.host, r.path)
        assert r.rule == rule and (rule is None or r.verdict == verdict)


def brute_items(url):
    host, path = brute_parts(url)
    if not host:
        return frozenset()
    labels, after = host.split("."), url.split("://", 1)[1][len(host) + len(path) :]
    out = {"s:" + url.split("://", 1)[0].lower()} | {"h:" + ".".join(labels[i:]) for i in range(len(labels))}
    out |= {"p:" + re.sub("[0-9]+", "#", x) for x in path.split("/") if x}
    return frozenset(out | {"q:" + x for x in re.findall("[?&]([^=&#]+)", after)})


def test_verdicts_without_a_rule_equal_brute_force(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    bad = {r.doc_id: r.toxic == 1 or r.quality == 0 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    sets = {i: brute_items(u) for i, u in urls.items()}
    baskets = [(s, bad[i]) for i, s in sets.items() if s and i in bad]
    least = math.ceil(max(0.002, 10 / len(baskets)) * len(baskets))
    every, of_bad = Counter(), Counter()
    for s, is_bad in baskets:
        for k in range(1, len(s) + 1):
            for c in combinations(sorted(s), k):
                every[c] += 1
                of_bad[c] += is_bad
    judged = {0.8: op10_url_rules(spark, sf), 0.3: uf.judge(spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), min_confidence=0.3)}
    for confidence, got in judged.items():
        mined = {c for c, n in of_bad.items() if n >= least and n / every[c] >= confidence}
        assert mined or confidence > 0.3
        for r in got.where("rule is null").collect():
            s = sorted(sets[r.page_id])
            fires = any(c in mined for k in range(1, len(s) + 1) for c in combinations(s, k))
            assert r.verdict == ("block" if fires else "allow"), urls[r.page_id]


def test_awkward_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://A.Example.COM?x=1", "a://b://c/d", "x://example.com/en/7#f", "x://xexample.com/en/7", "x://com/en/", "x://É.net/de/\nline?q", "x://example.net/de/8", "x://example.net/de/8"]
    df = spark.createDataFrame([(i % 11, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = uf.judge(df, None).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path) == brute_parts(r.url) and r.rule == brute_rule(r.host, r.path)[0] and r.verdict == (brute_rule(r.host, r.path)[1] or "allow")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert uf.judge(df, labels).count() == len(urls) and uf.judge(df.limit(0), labels).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rows = [(i, f"http://{'spam' if i % 4 == 0 else 'good'}.example.org/{'win' if i % 3 == 0 else 'news'}/{i}") for i in range(240)]
    bad = {i for i, u in rows if "spam" in u and "win" in u}
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i in bad else 1, None if i % 5 else 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in uf.judge(pages, labels).collect()}
    assert {i for i, v in got.items() if v == "block"} == bad
    host, path = uf.host_path(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    sets = {r.page_id: frozenset(r.i) for r in df.select("page_id", uf.items(F.col("host"), F.col("path"), F.col("url")).alias("i")).collect()}
    labelled = df.select(uf.items(F.col("host"), F.col("path"), F.col("url")).alias("items"), F.col("page_id").isin(*bad).alias("bad"))
    mined = {frozenset(r["items"]) for r in uf.mine(labelled).collect()}
    universe = sorted(set().union(*sets.values()))
    want = set()
    for k in (1, 2, 3):
        for c in combinations(universe, k):
            has = [i for i, s in sets.items() if s >= set(c)]
            n = sum(i in bad for i in has)
            if n >= 10 and n / len(has) >= 0.8 and not any(frozenset([x]) in want for x in c):
                want.add(frozenset(c))
    assert {m for m in mined if len(m) <= 3} == want
