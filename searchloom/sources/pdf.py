"""Text of PDF files: objects found by scanning, streams inflated or decrypted, shown strings decoded by their fonts' maps."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from . import crypto

_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[ \t\r\n\f\0]+(\d{1,5})[ \t\r\n\f\0]+obj\b")
_NO_TEXT = re.compile(rb"/Subtype\s*/(?:Image|Type1C|CIDFontType0C|OpenType)\b|/Type\s*/(?:Metadata|XRef|ObjStm|EmbeddedFile)\b|/Length1\b|/(?:DCTDecode|JPXDecode|CCITTFaxDecode|JBIG2Decode)\b")
_IMAGE = re.compile(rb"/Subtype\s*/Image\b")
_REF = rb"(\d+)\s+(\d+)\s+R"


class Protected(Exception):
    pass


@dataclass
class _Object:
    number: int
    generation: int
    head: bytes
    body: memoryview | None = None
    raw: bytes = b""


@dataclass
class _Font:
    codes: dict[int, str] = field(default_factory=dict)
    width: int = 1


def inflate(data: bytes) -> bytes | None:
    """What a zlib or raw deflate stream holds, as far as it goes; None if nothing comes out."""
    for bits in (15, -15):
        d, out = zlib.decompressobj(bits), b""
        try:
            out = d.decompress(data)
        except zlib.error:
            d, out = zlib.decompressobj(bits), b""
            try:
                for i in range(0, len(data), 256):
                    out += d.decompress(data[i : i + 256])
            except zlib.error:
                pass
        if out:
            return out
    return None


class Document:
    def __init__(self, data: bytes):
        self.data, self.objects = data, {}
        spans = list(_OBJECT.finditer(data))
        at = 0
        for m in spans:
            if m.start() < at:
                continue  # inside a stream
            o = _Object(int(m[1]), int(m[2]), b"")
            stop = data.find(b"endobj", m.end())
            stop = len(data) if stop < 0 else stop
            s = data.find(b"stream", m.end(), stop)
            if s >= 0 and data[s - 3 : s] != b"end":
                o.head = data[m.end() : s]
                a = s + 6
                a += 2 if data[a : a + 2] == b"\r\n" else data[a : a + 1] in (b"\n", b"\r")
                n = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", o.head)
                b = a + int(n[1]) if n else -1
                if not n or b > len(data) or not re.match(rb"\s*endstream", data[b : b + 20]):
                    b = data.find(b"endstream", a)
                    b = len(data) if b < 0 else b
                    if not n:  # an end of line before the keyword is no part of the stream
                        b -= 2 if data[b - 2 : b] == b"\r\n" else data[b - 1 : b] in (b"\n", b"\r")
                o.raw = data[a:b]
                at = b
            else:
                o.head = data[m.end() : stop]
                at = stop
            self.objects[o.number] = o
        self.key, self.cipher = None, None
        self._security()

    def _value(self, head: bytes, name: bytes) -> bytes:
        """A dictionary's value of a name: inline, or what it refers to."""
        m = re.search(rb"/" + name + rb"(?![A-Za-z0-9])\s*(?:" + _REF + rb")", head)
        if m:
            o = self.objects.get(int(m[1]))
            return o.head if o else b""
        m = re.search(rb"/" + name + rb"(?![A-Za-z0-9])\s*", head)
        return _balanced(head, m.end()) if m else b""

    def _security(self) -> None:
        found = None
        for m in re.finditer(rb"/Encrypt\s+(?:" + _REF + rb"|<<)", self.data):
            found = m
        if not found:
            return
        head = self.objects[int(found[1])].head if found[1] and int(found[1]) in self.objects else _balanced(self.data, found.end() - 2) if not found[1] else b""
        number = lambda name, other: int(m[1]) if (m := re.search(rb"/" + name + rb"\s+(-?\d+)", head)) else other
        v, r = number(b"V", 0), number(b"R", 0)
        if b"/Standard" not in head or v not in (1, 2, 4, 5):
            raise Protected
        self.cipher, length = "RC4", (number(b"Length", 40) // 8 if v > 1 else 5)
        if v >= 4:
            name = re.search(rb"/StmF\s*/(\w+)", head)
            name = name[1] if name else b"Identity"
            method = re.search(rb"/" + name + rb"\s*<<[^>]*?/CFM\s*/(\w+)", head)
            self.cipher = {b"V2": "RC4", b"AESV2": "AESV2", b"AESV3": "AESV3"}.get(method[1] if method else b"", "Identity")
            length = 16 if v == 4 else 32
        ids = re.search(rb"/ID\s*\[\s*", self.data)
        file_id = _string(self.data, ids.end())[0] if ids else b""
        part = lambda n: _string(head, m.end())[0] if (m := re.search(rb"/" + n + rb"(?![A-Za-z])\s*(?=[(<])", head)) else b""
        key = crypto.file_key(r, length, part(b"O"), part(b"U"), part(b"UE"), number(b"P", 0), file_id, b"/EncryptMetadata false" not in head)
        if key is None:
            raise Protected
        self.key = key

    def stream(self, o: _Object) -> bytes | None:
        data = o.raw
        if self.key is not None:
            data = crypto.decrypt_stream(self.cipher, self.key, o.number, o.generation, data)
        if re.search(rb"/FlateDecode|/Fl\b", o.head):
            return inflate(data)
        return data if b"/Filter" not in o.head else None

    def _fonts(self, page: bytes) -> dict[bytes, _Font]:
        """Font names of a page, or of a form, with their maps."""
        fonts = self._value(self._value(page, b"Resources") or page, b"Font")
        out = {}
        for m in re.finditer(rb"/([^\s/<>\[\]()]+)\s+" + _REF, fonts):
            o = self.objects.get(int(m[2]))
            t = re.search(rb"/ToUnicode\s+" + _REF, o.head) if o else None
            c = self.objects.get(int(t[1])) if t else None
            data = self.stream(c) if c else None
            if data:
                out[m[1]] = cmap(data)
        return out

    def text(self) -> tuple[str, bool]:
        """(text, whether there are images)."""
        contents, fonts_of, maps = [], {}, []
        for o in self.objects.values():
            if re.search(rb"/Type\s*/Page\b(?!s)", o.head):
                fonts = self._fonts(o.head)
                for n in re.findall(rb"(\d+)\s+\d+\s+R", _balanced(o.head, m.end()) if (m := re.search(rb"/Contents\s*", o.head)) and o.head[m.end() : m.end() + 1] == b"[" else (re.search(rb"/Contents\s+(\d+\s+\d+\s+R)", o.head) or [b"", b""])[1]):
                    fonts_of[int(n)] = fonts
        images = any(_IMAGE.search(o.head) for o in self.objects.values())
        for o in self.objects.values():
            if not o.raw or _NO_TEXT.search(o.head):
                continue
            data = self.stream(o)
            if not data:
                continue
            if b"beginbfchar" in data or b"beginbfrange" in data:
                maps.append(cmap(data))
            elif re.search(rb"\b(?:Tj|TJ)\b|['\"]", data):
                contents.append((data, fonts_of.get(o.number) or self._fonts(o.head)))
        return "\n".join(t for data, fonts in contents if (t := shown(data, fonts, maps)).strip()), images


def _balanced(data: bytes, at: int) -> bytes:
    """The dictionary or array that starts here, or the next few bytes."""
    pairs = {b"<<": b">>", b"[": b"]"}
    for a, b in pairs.items():
        if data[at : at + len(a)] == a:
            depth = 0
            for m in re.finditer(re.escape(a) + b"|" + re.escape(b), data[at:]):
                depth += 1 if m[0] == a else -1
                if depth == 0:
                    return data[at : at + m.end()]
            return data[at:]
    return data[at : at + 64]


_SPECIAL = re.compile(rb"[\\()]")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal or hex string that starts here, and where it ends."""
    if data[at : at + 1] == b"<":
        end = data.find(b">", at)
        end = len(data) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    out, depth, i = bytearray(), 1, at + 1
    while m := _SPECIAL.search(data, i):
        out += data[i : m.start()]
        i, c = m.start(), m[0][0]
        if c == 0x5C and i + 1 < len(data):
            i += 1
            c = data[i]
            if 0x30 <= c <= 0x37:
                m = re.match(rb"[0-7]{1,3}", data[i : i + 3])
                out.append(int(m[0], 8) & 255)
                i += len(m[0])
                continue
            if c in (10, 13):
                i += 2 if data[i : i + 2] == b"\r\n" else 1
                continue
            out.append(_ESCAPES.get(c, c))
        else:
            depth += (c == 0x28) - (c == 0x29)
            if depth == 0:
                return bytes(out), i + 1
            out.append(c)
        i += 1
    return bytes(out + data[i:]), max(i, len(data))


def _units(digits: bytes) -> str:
    raw = bytes.fromhex((digits + b"0" * (-len(digits) % 4)).decode())
    return "".join(chr(u) for i in range(0, len(raw), 2) if not 0xD800 <= (u := raw[i] << 8 | raw[i + 1]) < 0xE000)


def cmap(data: bytes) -> _Font:
    """bfchar and linear bfrange entries of a ToUnicode map."""
    f = _Font()
    for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf", data, re.S):
        if kind == b"char":
            for src, dst in re.findall(rb"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]*)\s*>", body):
                f.codes[int(src, 16)] = _units(dst)
                f.width = max(f.width, (len(src) + 1) // 2)
        else:
            for lo, hi, dst in re.findall(rb"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]+)\s*>", body):
                a, b, d = int(lo, 16), int(hi, 16), int(dst, 16)
                if len(dst) == 4 and 0 <= b - a < 65_536:
                    f.codes.update({a + k: chr(d + k) for k in range(b - a + 1) if not 0xD800 <= d + k < 0xE000 and d + k < 65_536})
                    f.width = max(f.width, (len(lo) + 1) // 2)
    return f


def _by(font: _Font, s: bytes, width: int) -> tuple[str, int]:
    out, hits = [], 0
    for i in range(0, len(s) - width + 1, width):
        t = font.codes.get(int.from_bytes(s[i : i + width], "big"))
        hits += t is not None
        out.append(t or "")
    return "".join(out), hits


_UNPRINTED = bytes(c for c in range(256) if not 32 <= c < 127)
_UNSEEN = bytes(c for c in _UNPRINTED if c not in (9, 10, 13))


def _plain(s: bytes) -> str:
    return s.translate(None, _UNSEEN).decode("ascii")


def decoded(s: bytes, font: _Font | None, maps: list[_Font]) -> str:
    """A shown string: by its font's map; without one, by whichever map covers it best, or as ASCII."""
    if font and font.codes:
        return _by(font, s, font.width)[0]
    best, text = (len(s.translate(None, _UNPRINTED)) / max(1, len(s)), 0), _plain(s)
    for m in maps:
        for width in (1, 2):
            t, hits = _by(m, s, width)
            rank = (hits * width / max(1, len(s)), hits)
            if hits and rank > best:
                best, text = rank, t
    return text


_TOKEN = re.compile(rb"[(<\[\]]|/[^\s/<>\[\]()]*|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+|%[^\r\n]*")


def shown(data: bytes, fonts: dict[bytes, _Font], maps: list[_Font]) -> str:
    """What a content stream's Tj, TJ, ' and " show, by the font that Tf selects; a wide gap in TJ is a space."""
    out, stack, font, at, name = [], [], None, 0, None
    while m := _TOKEN.search(data, at):
        t, at = m[0], m.end()
        c = t[:1]
        if c == b"(" or (c == b"<" and data[m.start() : m.start() + 2] != b"<<"):
            s, at = _string(data, m.start())
            stack.append(s)
        elif c == b"<":
            at = m.start() + 2
        elif c in b"[]%":
            continue
        elif c == b"/":
            name = t[1:]
        elif c.isdigit() or c in b"+-.":
            stack.append(float(t))
        else:
            if t == b"Tf":
                font = fonts.get(name)
            elif t in (b"Tj", b"TJ", b"'", b'"'):
                out += [decoded(s, font, maps) if isinstance(s, bytes) else " " if t == b"TJ" and abs(s) > 100 else "" for s in stack]
                out.append("\n" if t in (b"'", b'"') else "")
            elif t in (b"Td", b"TD", b"T*", b"ET", b"Tm"):
                out.append("\n")
            stack = []
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")


def extract(data: bytes) -> tuple[str, bool]:
    return Document(data).text()
