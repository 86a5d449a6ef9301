"""Scalar functions over names, sizes and times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .analysis import ascii_lower

# Extensions whose text is read, the groups of the type filter, the days of the date filter.
EXTRACTABLE = tuple(
    ".txt .md .csv .log .ini .json .xml .cpp .h .hpp .c .cc .cxx .py .js .ts .java .cs .go .rs .rb .php .sql .yaml .yml .sh .bat .ps1 .html .htm .css"
    " .docx .xlsx .pdf".split()
)
TYPE_GROUPS = {
    "all": "",
    "documents": "doc docx docm rtf odt xls xlsx xlsm xlsb ods csv pdf ppt pptx pps ppsx odp txt md",
    "word": "doc docx docm dot dotx rtf odt",
    "excel": "xls xlsx xlsm xlsb ods csv",
    "pdf": "pdf",
    "presentations": "ppt pptx pps ppsx odp",
    "text": "txt md log ini cfg conf json xml html htm",
    "images": "jpg jpeg png gif bmp tif tiff webp heic svg",
    "archives": "zip rar 7z tar gz tgz bz2",
}
#: None is any time, 0 is since midnight.
DATE_PRESETS = {"any": None, "today": 0, "7days": 7, "30days": 30, "year": 365}


def group_extensions(group: str) -> tuple[str, ...]:
    return tuple("." + e for e in TYPE_GROUPS[group].split())


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def extension(name: Column) -> Column:
    """With its dot, in its own case; a dot file has none."""
    return F.regexp_extract(name, r"(?s).(\.[^.]*)$", 1)


def extractable(ext: Column) -> Column:
    return ascii_lower(ext).isin(*EXTRACTABLE)


def store_name(root: Column) -> Column:
    """A root as a name for a table or partition."""
    return F.translate(root, ":\\/ ", "____")


def inside(path: Column, folder: Column | str) -> Column:
    """The folder itself or anything under it, with either separator."""
    f = F.lit(folder) if isinstance(folder, str) else folder
    return (path == f) | path.startswith(F.concat(f, F.lit("/"))) | path.startswith(F.concat(f, F.lit("\\")))


def since_preset(preset: str, now: Column | None = None) -> Column:
    """Epoch seconds from which a date preset counts."""
    now = F.current_timestamp() if now is None else now
    days = DATE_PRESETS[preset]
    if days is None:
        return F.lit(0).cast("long")
    return F.unix_timestamp(F.date_trunc("day", now)) if days == 0 else F.unix_timestamp(now) - days * 86_400


def glob_regex(mask: str) -> str:
    """An anchored pattern of a mask with * and ?, blind to the case of ASCII letters."""
    out = []
    for c in mask:
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c.isascii() and c.isalpha():
            out.append(f"[{c.lower()}{c.upper()}]")
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def excluded(relative: Column, masks: list[str]) -> Column:
    """Whether a path below the root has a masked component; ~$ owner files always are."""
    patterns = [glob_regex(m) for m in masks]
    return F.exists(F.split(relative, r"[/\\]"), lambda x: F.reduce(F.array(*[x.rlike(p) for p in patterns]), F.lit(False), lambda a, b: a | b) | x.rlike(r"^~\$.") if patterns else x.rlike(r"^~\$."))


def text_bytes(ext: Column, size: Column) -> Column:
    """Expected bytes of text in a file of this type."""
    e = ascii_lower(ext)
    return F.when(e == ".xlsx", size * 6).when(e == ".docx", size * 2).when(e == ".pdf", F.floor(size / 4)).when(e.isin(*EXTRACTABLE), size).otherwise(0).cast("long")


def heavy(ext: Column, size: Column, threshold: int = 20 * 1024 * 1024) -> Column:
    """Files that are extracted last, one at a time; a threshold of 0 means none."""
    return text_bytes(ext, size) > threshold if threshold else F.lit(False)


def size_text(size: Column) -> Column:
    """A size in B, KB, MB or GB."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return F.when(size < kb, F.concat(size.cast("string"), F.lit(" B"))).when(size < mb, F.concat(F.format_number(size / kb, 1), F.lit(" KB"))).when(size < gb, F.concat(F.format_number(size / mb, 1), F.lit(" MB"))).otherwise(F.concat(F.format_number(size / gb, 2), F.lit(" GB")))


def count_text(n: Column, one: str, few: str, many: str) -> Column:
    """A number with its noun in the Slavic plural form: 1, 21; 2-4, 22-24; all others."""
    tens, ones = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    form = F.when((tens >= 11) & (tens <= 14), many).when(ones == 1, one).when((ones >= 2) & (ones <= 4), few).otherwise(many)
    return F.concat_ws(" ", n.cast("string"), form)


def time_text(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "dd.MM.yyyy HH:mm")


def duration_text(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s.cast("long"))).otherwise(F.format_string("%d:%02d", m, s.cast("long")))
