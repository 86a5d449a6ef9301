"""Text of DOCX and XLSX files: parts of a ZIP archive, by linear scans of their markup."""

from __future__ import annotations

import io
import re
import zipfile

_ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos);")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def unescape(text: str) -> str:
    """The five named entities and character references; anything else stays."""

    def one(m: re.Match) -> str:
        if m[1][0] != "#":
            return _NAMED[m[1]]
        n = int(m[1][2:], 16) if m[1][1] in "xX" else int(m[1][1:])
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


def runs(xml: str, ns: str) -> str:
    """Text runs of a WordprocessingML (w) or DrawingML (a) part: paragraphs and breaks are new lines, tabs are tabs."""
    out = []
    for m in re.finditer(rf"<{ns}:t(?:[ \t\r\n][^>]*)?(/)?>|</{ns}:p>|<{ns}:tab[ />]|<{ns}:br[ />]", xml):
        tag = m[0]
        if tag.startswith(f"</{ns}:p"):
            out.append("\n")
        elif tag.startswith(f"<{ns}:tab"):
            out.append("\t")
        elif tag.startswith(f"<{ns}:br"):
            out.append("\n")
        elif not tag.endswith("/>"):
            end = xml.find(f"</{ns}:t>", m.end())
            out.append(unescape(xml[m.end() : end if end >= 0 else len(xml)]))
    return "".join(out)


def _texts(xml: str) -> list[str]:
    return [unescape(m[1]) for m in re.finditer(r"<t(?:[ \t\r\n][^>]*)?(?<!/)>(.*?)</t>", xml, re.S)]


def shared_strings(xml: str) -> list[str]:
    return ["".join(_texts(m[1] or "")) for m in re.finditer(r"<si(?:[ \t\r\n][^>]*)?(?:/>|>(.*?)</si>)", xml, re.S)]


def cells(xml: str, shared: list[str]) -> str:
    """A sheet's cells, each followed by a space: shared and inline strings, formulas' strings, numbers, dates as stored; no booleans or errors."""
    out = []
    for m in re.finditer(r"<c(?:[ \t\r\n]([^>]*?))?(?:/>|>(.*?)</c>)", xml, re.S):
        kind, body = re.search(r'\bt="([^"]*)"', m[1] or ""), m[2] or ""
        kind = kind[1] if kind else ""
        value = re.search(r"<v(?:[ \t\r\n][^>]*)?>(.*?)</v>", body, re.S)
        text = None
        if kind == "s" and value and value[1].strip().isdigit() and int(value[1]) < len(shared):
            text = shared[int(value[1])]
        elif kind == "inlineStr":
            t = re.search(r"<t(?:[ \t\r\n][^>]*)?>(.*?)</t>", body, re.S)
            text = unescape(t[1]) if t else None
        elif kind in ("str", "", "n", "d") and value:
            text = unescape(value[1])
        if text:
            out.append(text + " ")
    return "".join(out)


_DOCX = re.compile(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$")
_DRAWN = re.compile(r"(?:word|xl)/(?:charts/chart|diagrams/data|drawings/drawing)[^/]*\.xml$")
_SHEET = re.compile(r"xl/worksheets/sheet[^/]*\.xml$")
_NOTES = re.compile(r"xl/comments[^/]*\.xml$|xl/threadedComments/[^/]*\.xml$")


class TooLarge(Exception):
    pass


def _open(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def _read(z: zipfile.ZipFile, name: str) -> str:
    return z.read(name).decode("utf-8", "replace")


def _wanted(z: zipfile.ZipFile, keep, limit: int) -> list[str]:
    """Wanted parts in the archive's order; their unpacked sizes are known before anything is unpacked."""
    own = [i for i in z.infolist() if i.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and keep(i.filename)]
    if sum(i.file_size for i in own) > limit:
        raise TooLarge
    return [i.filename for i in own]


def docx(data: bytes, limit: int) -> str:
    """The body, then the other parts in the archive's order. KeyError if there is no body."""
    with _open(data) as z:
        names = _wanted(z, lambda n: _DOCX.match(n) or _DRAWN.match(n), limit)
        z.getinfo("word/document.xml")
        names.sort(key=lambda n: n != "word/document.xml")
        return "\n".join(t for n in names if (t := runs(_read(z, n), "a" if _DRAWN.match(n) else "w")))


def xlsx(data: bytes, limit: int) -> str:
    """Sheet names, cells, then drawings, charts and comments."""
    with _open(data) as z:
        names = _wanted(z, lambda n: n in ("xl/workbook.xml", "xl/sharedStrings.xml") or _SHEET.match(n) or _DRAWN.match(n) or _NOTES.match(n), limit)
        z.getinfo("xl/workbook.xml")
        shared = shared_strings(_read(z, "xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
        out = [unescape(x) for x in re.findall(r'<sheet\b[^>]*?\bname="([^"]*)"', _read(z, "xl/workbook.xml"))]
        out += [cells(_read(z, n), shared) for n in names if _SHEET.match(n)]
        for n in names:
            if _DRAWN.match(n):
                out.append(runs(_read(z, n), "a"))
            elif _NOTES.match(n):
                out += _texts(_read(z, n))
        return "\n".join(t for t in out if t)
