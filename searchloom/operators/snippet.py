"""Excerpts with the hits in brackets, made for the rows of one result page only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from searchloom.functions import stemmer
from searchloom.functions.analysis import fold_table
from searchloom.operators.match import Phrase

FORMS_WORDS, BEFORE, AFTER, NO_HIT, SCAN = 12, 5, 12, 17, 16 * 1024 * 1024
#: The word characters of exact excerpts.
_EXACT_WORD = re.compile("[0-9A-Za-zÀ-ÖØ-öø-ɏЀ-ӿ]+")
_FOLD = str.maketrans(*fold_table())


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, folded word) of a text's words."""
    out, start, word = [], None, []
    for i, c in enumerate(text):
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind == "Co":
            if start is None:
                start, word = i, []
            word.append(c)
        elif not (kind[0] == "M" and start is not None) and start is not None:
            out.append((start, i, "".join(word).lower().translate(_FOLD)))
            start = None
    if start is not None:
        out.append((start, len(text), "".join(word).lower().translate(_FOLD)))
    return out


def _instances(words: list[str], phrases: list[Phrase]) -> list[tuple[int, int, int]]:
    """(offset, phrase number, length) of every hit, by offset."""
    out = []
    for p, ph in enumerate(phrases):
        n = len(ph.words)
        for i in range(len(words) - n + 1 if n else 0):
            if words[i : i + n - 1] == list(ph.words[:-1]) and (words[i + n - 1].startswith(ph.words[-1]) if ph.prefix else words[i + n - 1] == ph.words[-1]):
                out.append((i, p, n))
    return sorted(out)


def forms(text: str, phrases: list[Phrase], size: int = FORMS_WORDS) -> str:
    """The best window of `size` words: windows that start near a hit or at a sentence's start are weighed by their different phrases
    (1000 each), repeats (1 each) and a bonus for a sentence's start (100; 120 for the text's)."""
    toks = tokens(text)
    n = len(toks)
    if not n:
        return ""
    hits = _instances([stemmer.stem(w) for *_, w in toks], phrases)
    begins = [0] + [k for k in range(1, n) if (gap := text[toks[k - 1][1] : toks[k][0]]) and gap[-1].isspace() and gap.rstrip()[-1:] in (".", ":")]

    def weigh(w: int) -> tuple[int, int]:
        seen, total, first, last = set(), 0, None, 0
        for o, p, m in hits:
            if w <= o < w + size:
                total += 1 if p in seen else 1000
                seen.add(p)
                first = o if first is None else first
                last = max(last, o + m)
        if first is None:
            return 0, w
        return total, max(0, min(first - int((size - (last - first)) / 2), n - size))

    best, start = 0, 0
    for o, *_ in hits:
        score, at = weigh(o)
        if score > best:
            best, start = score, at
        if n > size:
            s = max(b for b in begins if b <= o)
            if s < o:
                score = weigh(s)[0] + (120 if s == 0 else 100)
                if score > best:
                    best, start = score, s
    end = min(n, start + size)
    spans: list[list[int]] = []
    for o, _, m in hits:
        a, b = max(o, start), min(o + m, end)
        if a >= b:
            continue
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    out, at = [], toks[start][0] if start else 0
    for a, b in spans:
        out += [text[at : toks[a][0]], "[", text[toks[a][0] : toks[b - 1][1]], "]"]
        at = toks[b - 1][1]
    tail = text[at : toks[end - 1][1]] + "..." if end < n else text[at:]
    return ("..." if start else "") + "".join(out) + tail


def exact(text: str, phrases: list[Phrase]) -> str:
    """Five words before the first hit to twelve after it; without a hit the first seventeen words."""
    raw = text.encode("utf-8")
    text = raw[:SCAN].decode("utf-8", "ignore") if len(raw) > SCAN else text
    wanted = [p.words for p in phrases if p.words]
    spans, words, hit = [], [], None
    most = max((len(w) for w in wanted), default=1)
    for m in _EXACT_WORD.finditer(text):
        spans.append(m.span())
        words.append(m[0].lower().translate(_FOLD).replace("ё", "е"))
        k = len(words)
        if hit is None:
            start = k - most
            for s in range(max(0, start), k):
                own = [w for w in wanted if len(w) <= k - s and tuple(words[s : s + len(w)]) == w]
                if own:
                    hit = (s, s + max(map(len, own)))
                    break
        if hit and k >= hit[1] + AFTER + 1:
            break
    first, last = (max(0, hit[0] - BEFORE), min(len(words), hit[1] + AFTER)) if hit else (0, min(len(words), NO_HIT))
    if not words:
        return ""
    out, at, k = [], spans[first][0] if first else 0, first
    while k < last:
        own = [len(w) for w in wanted if tuple(words[k : k + len(w)]) == w and k + len(w) <= last]
        if own:
            a, b = spans[k][0], spans[k + max(own) - 1][1]
            out += [text[at:a], "[", text[a:b], "]"]
            at, k = b, k + max(own)
        else:
            k += 1
    cut = last < len(words)
    return ("..." if first else "") + "".join(out) + text[at : spans[last - 1][1]] + ("..." if cut else text[spans[last - 1][1] :])


def add(page: DataFrame, phrases: list[Phrase], exact_words: bool) -> DataFrame:
    """A result page with `content` -> the same with `snippet` in its place."""
    names = [c for c in page.columns if c != "content"]
    kinds = dict(page.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = exact if exact_words else forms
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array([make(t.as_py() or "", phrases) if phrases else "" for t in b.column(len(names))], pa.string())], names=[*names, "snippet"])

    return page.select(*names, "content").mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "snippet string"]))
