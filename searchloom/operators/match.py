"""Phrases over word arrays, and the BM25 score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from searchloom.functions.analysis import analyze_text
from searchloom.plans.query import Token

NAME_WEIGHT, CONTENT_WEIGHT = 10.0, 1.0
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Phrase:
    """Consecutive words; with `prefix` the last one need only begin so. Without words it matches nothing."""

    words: tuple[str, ...]
    prefix: bool = False


def phrase(token: Token, exact: bool) -> Phrase:
    """A bare word is a prefix unless words are exact; one that splits is a phrase whose last word is the prefix."""
    return Phrase(tuple(analyze_text(token.text, exact)), not token.phrase and not exact)


def occurrences(words: Column, p: Phrase) -> Column:
    """How often a phrase occurs in a word array."""
    if not p.words:
        return F.lit(0)

    def fits(x: Column, k: int) -> Column:
        w = p.words[k]
        return x.startswith(w) if p.prefix and k == len(p.words) - 1 else x == w

    if len(p.words) == 1:
        return F.size(F.filter(words, lambda x: fits(x, 0)))

    def at(x: Column, i: Column) -> Column:
        hit = fits(x, 0)
        for k in range(1, len(p.words)):
            hit = hit & F.coalesce(fits(F.get(words, i + k), k), F.lit(False))
        return hit

    return F.size(F.filter(words, at))


def idf(n_docs: Column, n_hits: Column) -> Column:
    return F.greatest(F.log((n_docs - n_hits + 0.5) / (n_hits + 0.5)), F.lit(LEAST_IDF))


def bm25(in_name: list[Column], in_content: list[Column], idfs: list[Column], length: Column, mean: Column) -> Column:
    """Negative, smaller is better: per phrase, occurrences weighted by column against the document's length."""
    norm = K1 * (1 - B + B * length / mean)
    out = F.lit(0.0)
    for a, b, i in zip(in_name, in_content, idfs, strict=True):
        f = NAME_WEIGHT * a + CONTENT_WEIGHT * b
        out = out - i * f * (K1 + 1) / (f + norm)
    return out
