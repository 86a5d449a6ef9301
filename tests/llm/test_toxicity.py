import math
import random
import re
import zlib

from pyspark.sql import functions as F

from searchloom.llm import toxicity as tox
from searchloom.llm.queries import op5_toxicity

from .helpers import docs_df

BIG = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    terms = ["moron", "scum", "idiot", "idea", "trash", "abc"]
    auto = tox.Automaton(terms)
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        w = "".join(w)
        best = min((distance(w, t), t) for t in terms)
        got = auto.match(w)
        assert (got is None) == (best[0] > 1) and (got is None or got[0] == best[0])
    assert tox.Automaton(["lowei*"]).match("loweiung") == (0, "lowei*") and tox.Automaton(["lowei*"]).match("lowung") is None


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = op5_toxicity(spark, BIG).join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    out = [r for r in rows if r.held_out]
    bad = [r for r in out if r.toxic]
    assert sum(r.predicted for r in bad) >= 0.85 * len(bad)
    assert sum(r.predicted for r in out if not r.toxic) <= 0.02 * len(out)


def edited(word, rng):
    k, c, kind = rng.randrange(len(word)), rng.choice("abcdefghijklmnopqrstuvwxyz"), rng.randrange(3)
    return word[:k] + (c + word[k:] if kind == 0 else c + word[k + 1 :] if kind == 1 else word[k + 1 :])


def brute_score(model, text):
    """The score from its description: every word against every term by edit distance, no automaton, trie or cache."""
    n, open_at, report, hits = 0, None, -100, []
    for tok in re.findall(r"[^\W_]+|[\"“”„«»‘’']", (text or "").lower()):
        if tok in "\"“”„«»‘’'":
            open_at = None if open_at is not None else n
            continue
        report = n if tok in tox._REPORTS else report
        stem = next((t for k in range(1, len(tok) + 1) for t in model.terms if t == tok[:k] + "*"), None)
        near = min(((distance(tok, t), t) for t in model.terms if not t.endswith("*") and abs(len(t) - len(tok)) < 2), default=(9, ""))
        hit = (0, stem) if stem else near if near[0] < 2 else None
        if hit and hit != (0, tok) and (tok in model.known or hit[0] and (max(len(tok), len(hit[1])) < 5 or min(len(tok), len(hit[1])) < 4)):
            hit = None
        if hit:
            hits.append((n, hit, (open_at is not None and n - open_at <= 12) or n - report <= 4))
        n += 1
    free = [(p, h) for p, h, quoted in hits if not quoted]
    exact, off = sum(h[0] == 0 for _, h in free), sum(h[0] > 0 for _, h in free)
    dense = max((sum(p <= x < p + 12 for x, _ in free) for p, _ in free), default=0)
    x = [math.log1p(exact), math.log1p(off), math.log1p(len(hits) - len(free)), math.log1p(dense), math.log1p(len({h[1] for _, h in free})), min(1, 20 * (exact + off) / n) if n else 0]
    return 1 / (1 + math.exp(-model.weights[0] - sum(w * v for w, v in zip(model.weights[1:], x, strict=True))))


def test_scores_equal_brute_force_and_edits_are_caught(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    model = tox.learn(tox.training(docs, labels))
    rows, rng = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect(), random.Random(5)
    whole = {r.doc_id: r.score for r in tox.score(docs, model).collect()}
    for r in [r for r in rows if r.toxic][:40] + [r for r in rows if not r.toxic and len(r.text or "") < 3000][:60]:
        assert abs(whole[r.doc_id] - brute_score(model, r.text)) < 1e-9
    score = lambda t: model.score(model.features(t))
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    plain = {t for t in model.terms if not t.endswith("*")}
    bad = [r.text for r in held if r.toxic and sum(w in plain for w in re.findall(r"[^\W_]+", r.text.lower())) > 1]
    off = [re.sub(r"[^\W_]+", lambda m: edited(m[0].lower(), rng) if m[0].lower() in plain else m[0], t) for t in bad]
    assert len(bad) > 8 and sum(score(t) >= 0.7 for t in off) >= 0.85 * len(off)
    clean = next(r.text for r in held if not r.toxic and len(r.text.split()) > 60).split()[:48]
    terms = sorted(plain & {"idiot", "moron", "trash", "stupid", "loser"})[:3]
    said = lambda words, quote="": f"{quote}{' '.join(words)}{quote} " + " ".join(clean)
    assert score(said(terms)) >= 0.7 and score(said([t + t[-1] for t in terms])) >= 0.7 > score("he wrote " + said(terms, '"'))


def test_a_large_lexicon_is_kept_whole(spark):
    """More terms and more known neighbours than any fixed bound would have kept by alphabet."""
    words = [f"z{i:04d}qy" for i in range(6000)]
    rows = [(k * 40 + j, " ".join(words[(k * 150 + j * 7 + i) % 6000] for i in range(150)), "s") for k in range(40) for j in range(8)] + [(10_000 + i, f"plain text number {i}", "s") for i in range(400)]
    docs = docs_df(spark, rows)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") < 10_000).cast("int").alias("toxic"))
    model = tox.learn(tox.training(docs, labels))
    assert sum(model.hit(w) is not None for w in words) > 5900


def sample(spark, n=400):
    rng = random.Random(1)
    words = ["w%s" % "".join(rng.choice("abcdeu") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(n):
        t = rng.choices(words, k=40)
        if i % 4 == 0:
            for _ in range(4):
                t[rng.randrange(40)] = rng.choice(["vermin", "dimwit", "gutter"])
        rows.append((i, " ".join(t), "s"))
    docs = docs_df(spark, rows)
    return docs, docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")), words


def test_misspelled_and_quoted(spark):
    docs, labels, words = sample(spark)
    model = tox.learn(tox.training(docs, labels))
    assert set(model.terms) & {"vermin", "vermi*", "verm*"}
    tail = " ".join(words[:30])
    score = lambda t: model.score(model.features(t))
    assert score("you dimwit you gutter vermin " + tail) > 0.7 > score(tail)
    assert model.features("you dimvit " + tail)[1] > 0 or model.features("you dimvit " + tail)[0] > 0
    abuse, quote = model.features("dimwit and gutter " + tail), model.features('he wrote "dimwit and gutter" ' + tail)
    assert abuse[2] == 0 < quote[2] and quote[0] == 0 < abuse[0]


def test_awkward_rows(spark):
    docs, labels, _ = sample(spark, 200)
    odd = docs_df(spark, [(None, None, None), (1000, "", "s"), (1001, None, "s"), (1001, None, "s"), (1002, "vermin " * 100_000, "s"), (1003, '"“«', "s")])
    marks = labels.union(spark.createDataFrame([(None, 1, 1), (5, 0, None), (99_999, 0, 1)], labels.schema))
    every = docs.union(odd)
    model = tox.learn(tox.training(every, marks))
    got = tox.score(every, model).collect()
    assert len(got) == 206 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.score for r in got}[1002] > 0.7
    kept = tox.reject(every, model)
    assert kept.columns == every.columns and kept.where("doc_id = 1001").count() == 2 and kept.where("doc_id = 1002").count() == 0
    nothing = tox.learn(tox.training(every, marks.limit(0)))
    assert tox.score(every, nothing).agg(F.max("score")).first()[0] == 0
    assert tox.score(every.limit(0), model).count() == 0
