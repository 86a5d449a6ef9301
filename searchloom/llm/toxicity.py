"""Operator 5, toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

Learned from labelled training rows only. Lexicon: words that toxic texts use in many contexts and other texts hardly use
(counted over the training rows), and likewise stems, written ``stem*``, with which many such words begin. Its trie is intersected with Levenshtein automata of distance 1: states are sets of
(trie node, errors), determinised as they are met, so a word walks one table whatever the lexicon's size and leaves at the
first letter from which no term is in reach. Words that non-toxic texts use are no misspellings. Each hit is looked at
in its window: inside quotation marks or after a reporting verb it counts as quoted, else as abuse; the densest window
of hits counts too. A logistic regression over these features gives the score; it is fitted on the features
of about FIT_ROWS training rows at most, chosen by their hashes, and of copies of the toxic ones in which each term has an error, so that
misspelled terms count as evidence by a weight of their own. About LABELS labelled rows at most are learned from at all; that alone
bounds the lexicon and the words known beside it, of which none is left out.

Defined cases: null and empty texts have no hits and the model's base score; null labels and labels of unknown documents are ignored,
a document with several labels is toxic if one says so; without training rows of both kinds every score is 0; repeated
rows are scored alike.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, trim

#: Rows of the fit, about.
FIT_ROWS = 20_000
#: Labelled training rows that are learned from, about, and broadcast to the texts; those with the smallest hashes.
LABELS = 400_000
#: A term has at least so many contexts in toxic training texts, so many times its share elsewhere, and this length.
CONTEXTS, LIFT, LENGTH = 5, 20.0, 4
#: Lengths of stems, and the words of one stem at least.
STEMS, STEM_WORDS = (4, 5, 6), 3
#: Of a word and its term the longer has so many letters at least, and the shorter one less, if they may differ by an error.
FUZZY_LENGTH = 5
WINDOW = 12
_TOKEN = re.compile(r"[^\W_]+|[\"“”„«»‘’']")
_MARKS = frozenset("\"“”„«»‘’'")
#: Verbs that report speech.
_REPORTS = frozenset("said says say wrote writes called calls quoted quotes claimed dijo dice dit écrit sagte sagt schrieb".split())
FEATURES = ("exact", "misspelled", "quoted", "dense", "kinds", "share")


class Automaton:
    """Levenshtein automata of distance `errors`, intersected with a trie of terms, determinised lazily."""

    def __init__(self, terms, errors: int = 1):
        self.children, self.term, self.stem = [{}], [None], [None]
        for t in sorted(terms):
            at = 0
            for c in t.rstrip("*"):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                at = self.children[at][c]
            (self.stem if t.endswith("*") else self.term)[at] = t
        self.errors, self.ids, self.sets, self.moves, self.ends, self.stems = errors, {}, [], [], [], []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set) -> int:
        best = {}
        todo = list(pairs)
        while todo:  # a term's letter may be missing from the word
            node, e = todo.pop()
            if best.get(node, self.errors + 1) <= e:
                continue
            best[node] = e
            if e < self.errors:
                todo += [(n, e + 1) for n in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] is not None]
            self.ends.append(min(ends) if ends else None)
            self.stems.append(next((self.stem[n] for n, e in key if e == 0 and self.stem[n] is not None), None))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        to = set()
        for node, e in self.sets[state]:
            if c in self.children[node]:
                to.add((self.children[node][c], e))
            if e < self.errors:
                to.add((node, e + 1))  # a letter too many
                to.update((n, e + 1) for n in self.children[node].values())  # another letter
        nxt = self._state(to) if to else -1
        self.moves[state][c] = nxt
        return nxt

    def match(self, word: str) -> tuple[int, str] | None:
        """(errors, term) of the stem that the word begins with, or the nearest term within reach, or None."""
        s, moves, stems = self.start, self.moves, self.stems
        for c in word:
            n = moves[s].get(c)
            if n is None:
                n = self._move(s, c)
            if n < 0:
                return None
            s = n
            if stems[s] is not None:
                return 0, stems[s]
        return self.ends[s]


def fuzzy(word: str, term: str) -> bool:
    return max(len(word), len(term)) >= FUZZY_LENGTH and min(len(word), len(term)) >= FUZZY_LENGTH - 1


@dataclass
class Model:
    terms: tuple[str, ...] = ()
    known: frozenset[str] = frozenset()
    weights: tuple[float, ...] = ()
    _auto: Automaton | None = field(default=None, repr=False)
    _seen: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"terms": self.terms, "known": self.known, "weights": self.weights, "_auto": None, "_seen": {}}

    def hit(self, word: str) -> tuple[int, str] | None:
        if self._auto is None:
            self._auto = Automaton(self.terms)
        m = self._auto.match(word)
        if m is None or m == (0, word):
            return m
        if word in self.known or m[0] and not fuzzy(word, m[1]):
            return None
        return m

    def misspelled(self, text: str | None) -> str:
        """The text with one error in each word that is a term or begins with a stem: the example by which misspelled terms get their weight."""

        def edit(m: re.Match) -> str:
            word, hit = m[0], self.hit(m[0])
            if hit is None or hit[0] or len(word) < FUZZY_LENGTH - 1:
                return word
            h = zlib.crc32(f"{m.start()} {word}".encode())
            # not among the letters of a stem, which are looked for as they are
            low = len(hit[1]) - 1 if hit[1].endswith("*") else 1
            k, kind, letter = low + h % max(1, len(word) - low), h // 97 % 3, chr(ord("a") + h // 291 % 26)
            if kind == 0 and len(word) > FUZZY_LENGTH:
                return word[:k] + word[k + 1 :]
            return word[:k] + (letter + word[k:] if kind == 1 or len(word) < FUZZY_LENGTH else letter + word[k + 1 :])

        return re.sub(r"[^\W_]+", edit, (text or "").lower())

    def features(self, text: str | None) -> list[float]:
        tokens = _TOKEN.findall((text or "").lower())
        seen, open_, n, hits = self._seen, None, 0, []
        if len(seen) > 50_000:
            seen.clear()
        last_report = -WINDOW
        for tok in tokens:
            if tok in _MARKS:
                # a mark opens a quotation, or ends the one that is open
                open_ = None if open_ is not None else n
                continue
            m = seen.get(tok, 0)
            if m == 0:
                m = seen[tok] = self.hit(tok)
            if tok in _REPORTS:
                last_report = n
            if m is not None:
                hits.append((n, m, (open_ is not None and n - open_ <= WINDOW) or n - last_report <= WINDOW // 3))
            n += 1
        exact = sum(1 for _, m, q in hits if not q and m[0] == 0)
        off = sum(1 for _, m, q in hits if not q and m[0])
        quoted = sum(1 for *_, q in hits if q)
        dense, lo = 0, 0
        free = [p for p, _, q in hits if not q]
        for hi, p in enumerate(free):
            while p - free[lo] >= WINDOW:
                lo += 1
            dense = max(dense, hi - lo + 1)
        return [math.log1p(exact), math.log1p(off), math.log1p(quoted), math.log1p(dense), math.log1p(len({m[1] for _, m, q in hits if not q})), min(1.0, 20.0 * (exact + off) / n) if n else 0.0]

    def score(self, x: list[float]) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(doc_id):
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1


def learn(labelled: DataFrame) -> Model:
    """labelled(doc_id, text, toxic 0/1) of training rows -> a model."""
    scratch = Scratch(labelled.sparkSession)
    rows = scratch.write(labelled.select("text", "toxic", F.xxhash64("doc_id", "text").alias("h")))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model()
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0))
    each = rows.select("toxic", F.explode(words).alias("word")).where(F.length("word") >= LENGTH)
    share = scratch.write(each.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine")))
    lift = (F.col("bad") + 0.5) / n[1] / ((F.col("fine") + 0.5) / n[0])
    stems = share.select("bad", "fine", F.explode(F.array(*[F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEMS])).alias("word"))
    stems = stems.where("word is not null").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"), F.sum(F.when(F.col("bad") > 0, 1).otherwise(0)).alias("words")).where(F.col("words") >= STEM_WORDS).drop("words")
    likely = share.union(stems).where((F.col("bad") >= CONTEXTS) & (lift >= LIFT)).select("word")
    maybe = frozenset(r["word"] for r in likely.collect())

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of copies of one text each word has the same neighbour; a term has many."""
        for b in batches:
            out = set()
            for t in b.column(0):
                before = ""
                for w in re.findall(r"[^\W_]+", (t.as_py() or "").lower()):
                    for x in (w, *(w[:k] + "*" for k in STEMS if len(w) > k)):
                        if x in maybe:
                            out.add((x, before + " " + w))
                    before = w
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([c for _, c in out], pa.string())], names=["word", "before"])

    used = rows.where("toxic = 1").select("text").mapInArrow(contexts, "word string, before string")
    seen = used.groupBy("word").agg(F.countDistinct("before").alias("n"), F.countDistinct(F.substring_index("before", " ", 1)).alias("c")).where(F.least("n", "c") >= CONTEXTS)
    kept = {r["word"] for r in seen.select("word").collect()}
    covered = lambda w: any(w[:k] + "*" in kept for k in STEMS if len(w.rstrip("*")) > k)
    model = Model(tuple(sorted(w for w in kept if not covered(w))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [w.as_py() for w in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w in hits if (m := model.hit(w)) and m != (0, w)], pa.string())], names=["word"])

    words_near = share.where((F.col("fine") > 1) & (lift < LIFT)).select("word").mapInArrow(near, "word string")
    model.known = frozenset(r["word"] for r in words_near.collect())
    total = n[0] + n[1]
    fit = (rows.where(F.pmod("h", F.lit(1 << 20)) < int(FIT_ROWS / total * (1 << 20))) if total > FIT_ROWS else rows).select("text", "toxic")

    def feats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                b = batch.slice(at, 500)
                rows = [(t, y) for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in ([text, model.misspelled(text)] if y else [text])]
                yield pa.RecordBatch.from_arrays([pa.array([model.features(t) for t, _ in rows], pa.list_(pa.float64())), pa.array([y for _, y in rows], pa.int32())], names=["x", "y"])
        trim()

    got = fit.mapInArrow(feats, "x array<double>, y int").collect()
    model.weights = logistic(np.array([[1.0, *r["x"]] for r in got]), np.array([float(r["y"]) for r in got]))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Newton's method; the ridge spares the constant."""
    w, pen = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pen, x.T @ (y - p) - pen @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents that aren't held out, of about LABELS at most."""
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    n = marks.count()
    if n > LABELS:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(LABELS / n * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, score); texts are the only input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(model.features(t.as_py())) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, all columns."""

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([model.score(model.features(t.as_py())) for t in texts], pa.float64())
        trim()

    return docs.where(of(F.coalesce("text", F.lit(""))) < threshold)
