"""Text analysis as column expressions: words, folding, the exact and the stemming analyzer.

Words are maximal runs of letters, numbers and private-use characters; marks inside a word are dropped. Case is folded by
`lower`; a character whose decomposition is one ASCII letter and one mark becomes that letter (so й and ё stay). All
of it stays inside whole-stage code generation or Catalyst's array functions; no Python runs on rows. The stored index alone splits whole
texts in Arrow batches (`pieces`, `folded`), where a word is folded and stemmed once for all places it has in a batch.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stemmer


@functools.cache
def fold_table() -> tuple[str, str]:
    """(from, to) of the diacritic rule over the Latin blocks, generated from the Unicode decompositions."""
    pairs = []
    for cp in range(0x80, 0x3000):
        c = chr(cp)
        if unicodedata.category(c)[0] not in "LN" or c.lower() != c:
            continue
        d = unicodedata.normalize("NFD", c)
        if len(d) == 2 and "a" <= d[0] <= "z" and unicodedata.category(d[1])[0] == "M":
            pairs.append((c, d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_SEPARATORS = r"[^a-z0-9\p{L}\p{N}\p{Co}\p{M}]+"


def words(c: Column, exact: bool = False) -> Column:
    """Folded words of a text in order; null has none. Texts of ASCII alone have neither marks nor letters to fold."""
    c = F.coalesce(c, F.lit(""))
    old, new = fold_table()
    folded = F.translate(F.regexp_replace(F.lower(c), r"\p{M}+", ""), *((old + "ё", new + "е") if exact else (old, new)))
    return F.array_remove(F.split(F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(folded), _SEPARATORS), "")


def exact_words(c: Column) -> Column:
    """The exact analyzer: words, ё as е."""
    return words(c, True)


def stem_words(c: Column) -> Column:
    """The stemming analyzer. Words are stemmed only in texts with Cyrillic letters, the stemmer leaves all others alone."""
    w = words(c)
    return F.when((F.octet_length(c) > F.length(c)) & c.rlike("[А-Яа-яЁё]"), F.transform(w, stemmer.stem_column)).otherwise(w)


def analyze(c: Column, exact: bool) -> Column:
    return exact_words(c) if exact else stem_words(c)


def analyze_text(text: str, exact: bool) -> list[str]:
    """The same analyzers on the driver, for the words of a query."""
    if exact:
        text = text.translate({ord("ё"): "е", ord("Ё"): "е"})
    text = text.lower().translate(str.maketrans(*fold_table()))
    out, word = [], ""
    for ch in text + " ":
        kind = unicodedata.category(ch)
        if kind[0] in "LN" or kind == "Co":
            word += ch
        elif kind[0] != "M":
            if word:
                out.append(word)
            word = ""
    return out if exact else [stemmer.stem(w) for w in out]


#: Characters of which Python and every JVM say the same: case one by one, letters, numbers and marks. No dotted capital I, no final sigma.
COMMON = r"\x00-\u012F\u0131-\u024F\u0300-\u036F\u0400-\u04FF\u2000-\u206F\u20A0-\u20BF\u2190-\u23FF\uFFFD"
_MARKS = "\u0300-\u036f\u0483-\u0489"
_PIECE, _STEMMED = re.compile(rf"[\w{_MARKS}]+"), re.compile(stemmer._CYRILLIC)
_ASCII = {c: " " if not chr(c).isalnum() else chr(c).lower() for c in range(128)}


def to_split(c: Column, exact: bool) -> list[Column]:
    """A text for `pieces`, and whether it is split already: one with characters that are not COMMON is, by `words`."""
    c = F.coalesce(c, F.lit(""))
    other = (F.octet_length(c) > F.length(c)) & c.rlike(f"[^{COMMON}]")
    return [F.when(other, F.array_join(words(c, exact), " ")).otherwise(c), other]


def pieces(text: str, split: bool) -> list[str]:
    """The words of such a text in order; `folded` makes terms of them, and of a mark alone nothing."""
    if split:
        return text.split(" ") if text else []
    return text.translate(_ASCII).split() if text.isascii() else _PIECE.findall(text.lower().replace("_", " "))


def folded(word: str, exact: bool) -> str:
    if word.isascii():
        return word
    word = word.translate(_folds(exact))
    return stemmer.stem(word) if not exact and _STEMMED.match(word) else word


@functools.cache
def _folds(exact: bool) -> dict[int, int | None]:
    return str.maketrans(*fold_table()) | dict.fromkeys([*range(0x300, 0x370), *range(0x483, 0x48A)]) | ({ord("ё"): ord("е")} if exact else {})


def once(df: DataFrame, cols: list[Column]) -> DataFrame:
    """The columns as outputs of a generator, which the optimizer neither repeats in later expressions nor prunes one by one."""
    return df.select(F.inline(F.array(F.struct(*cols))))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z only."""
    return F.when(F.lower(c) == c, c).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def lower_ascii_text(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def register(spark: SparkSession) -> None:
    """SQL names of both analyzers, text to words: analyze_exact(text) and analyze_forms(text), in Arrow batches. Column code uses `analyze`."""
    for name, exact in (("analyze_exact", True), ("analyze_forms", False)):

        def run(texts: pd.Series, exact: bool = exact) -> pd.Series:
            return texts.map(lambda t: analyze_text(t or "", exact))

        spark.udf.register(name, F.pandas_udf(run, "array<string>"))
