"""Natural and folder-tree order as sortable array keys.

A key compares as the order does: text case-insensitive for Latin-1 and Cyrillic, ё as е, runs of digits by value, path
separators before all else, and at every level folders before or after files. Descending order turns names and numbers
round but not folders and files. Ties fall to the path's bytes. Sorting by a precomputed column needs no collation in the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper-case letters that fold, and what they fold to: A-Z, À-Þ without ×, А-Я, Ѐ-Џ; Ё and ё are е.
_UPPER = [*range(0x41, 0x5B), *(c for c in range(0xC0, 0xDF) if c != 0xD7), *range(0x410, 0x430)]
_FROM = "".join(map(chr, [*_UPPER, 0x401, 0x451, *(c for c in range(0x400, 0x410) if c != 0x401)]))
_TO = "".join(map(chr, [*(c + 0x20 for c in _UPPER), 0x435, 0x435, *(c + 0x50 for c in range(0x400, 0x410) if c != 0x401)]))


def fold(c: Column) -> Column:
    return F.translate(c, _FROM, _TO)


def _pieces(part: Column, sign: int) -> Column:
    """array<array<int>> of one name: a digit run as (mark, length, digits), any other character as its code point."""

    def one(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+", "")
        run = F.concat(F.array(F.lit(sign * 0x31), F.lit(sign) * F.length(digits)), F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d: F.lit(sign) * (F.ascii(d) - 47)))
        return F.when(x.rlike("^[0-9]"), run).otherwise(F.array(F.lit(sign) * (F.ascii(x) + 1)))

    return F.transform(F.regexp_extract_all(fold(part), F.lit(r"(?s)([0-9]+|[^0-9])"), 1), one)


def tree_key(path: Column, folders_first: bool = True, descending: bool = False) -> Column:
    """array<int> key of a path; sort by it ascending, whichever the direction, then by the path in that direction."""
    parts, sign = F.split(path, r"[/\\]"), -1 if descending else 1

    def level(part: Column, i: Column) -> Column:
        last = i == F.size(parts) - 1
        kind = F.when(last == F.lit(folders_first), 1).otherwise(0)
        return F.concat(F.array(kind), F.flatten(_pieces(part, sign)), F.array(F.lit(0)))

    return F.flatten(F.transform(parts, level))


def natural_key(name: Column, descending: bool = False) -> Column:
    return F.concat(F.flatten(_pieces(name, -1 if descending else 1)), F.array(F.lit(0)))


def tree_order(path: Column, folders_first: bool = True, descending: bool = False) -> list[Column]:
    return [tree_key(path, folders_first, descending).asc(), path.desc() if descending else path.asc()]
