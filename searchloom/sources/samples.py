"""Small sample files of the formats that are read: what queries and tests of extraction write and get back."""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib

from . import crypto


def archive(parts: dict[str, str], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    """A ZIP archive of these parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def docx(text: str) -> bytes:
    """A paragraph for each line."""
    return archive({"word/document.xml": "<w:document>" + "".join(f'<w:p><w:r><w:t xml:space="preserve">{_escape(line)}</w:t></w:r></w:p>' for line in text.split("\n")) + "</w:document>"})


def xlsx(text: str, number: int, note: str) -> bytes:
    """A row of a shared string, a number, an inline string, and a flag, which isn't text."""
    cells = f'<row><c t="s"><v>0</v></c><c><v>{number}</v></c><c t="inlineStr"><is><t>{_escape(note)}</t></is></c><c t="b"><v>1</v></c></row>'
    return archive({"xl/workbook.xml": '<workbook><sheets><sheet name="Rows" sheetId="1"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst><si><t>{_escape(text)}</t></si></sst>", "xl/worksheets/sheet1.xml": cells})


def shown(text: str) -> bytes:
    """Page content that shows an ASCII text."""
    return b"BT /F1 12 Tf (" + text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("ascii") + b") Tj ET"


def pdf(text: str) -> bytes:
    return document([(zlib.compress(shown(text)), "/Filter /FlateDecode")])


def document(contents: list[tuple[bytes, str]], extra: str = "", fonts: str = "", page: str = "", trailer: str = "") -> bytes:
    """A small PDF: a page with these content streams (bytes, dictionary entries)."""
    out = b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] >>\nendobj\n"
    refs = " ".join(f"{10 + k} 0 R" for k in range(len(contents)))
    out += f"3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents [{refs}] /Resources << /Font << {fonts} >> >> {page} >>\nendobj\n".encode()
    for k, (data, entries) in enumerate(contents):
        out += f"{10 + k} 0 obj\n<< /Length {len(data)} {entries} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    return out + extra.encode("latin-1") + f"trailer\n<< /Root 1 0 R {trailer} >>\n%%EOF".encode("latin-1")


def encrypted(revision: int, password: bytes = b"", broken: bool = False, plain: bytes = b"BT (Secret contract text) Tj ET") -> bytes:
    """A PDF whose one stream is encrypted for a user password."""
    v, cfm, n = {2: (1, None, 5), 3: (2, None, 16), 4: (4, "AESV2", 16), 5: (5, "AESV3", 32), 6: (5, "AESV3", 32)}[revision]
    file_id, o, perms = b"0123456789abcdef", bytes(range(60, 92)), -44
    pad = (password + crypto.PAD)[:32]
    entries = f"/Filter /Standard /V {v} /R {revision} /Length {n * 8} /P {perms} "
    if revision >= 5:
        salt, key_salt, key = b"saltsalt", b"keysalts", bytes(range(32))
        digest = (lambda s: crypto._hash_r6(password, s)) if revision == 6 else lambda s: hashlib.sha256(password + s).digest()
        u, ue = digest(salt) + salt + key_salt, crypto.cbc_encrypt(digest(key_salt), bytes(16), key)
        o = bytes(48)
        entries += f"/UE <{ue.hex()}> "
    else:
        key = hashlib.md5(pad + o + (perms & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
        for _ in range(50 if revision > 2 else 0):
            key = hashlib.md5(key[:n]).digest()
        key = key[:n]
        u = crypto.rc4(key, crypto.PAD)
        if revision > 2:
            u = hashlib.md5(crypto.PAD + file_id).digest()
            for i in range(20):
                u = crypto.rc4(bytes(b ^ i for b in key), u)
            u += bytes(16)
    if broken:
        u = bytes([u[0] ^ 1]) + u[1:]
    if cfm:
        entries += f"/CF << /StdCF << /CFM /{cfm} /AuthEvent /DocOpen >> >> /StmF /StdCF /StrF /StdCF "
    entries += f"/O <{o.hex()}> /U <{u.hex()}>"
    own = key if cfm == "AESV3" else hashlib.md5(key + (10).to_bytes(3, "little") + bytes(2) + (b"sAlT" if cfm else b"")).digest()[: min(16, n + 5)]
    if cfm:
        fill = 16 - len(plain) % 16
        iv = bytes(range(100, 116))
        data = iv + crypto.cbc_encrypt(own, iv, plain + bytes([fill]) * fill)
    else:
        data = crypto.rc4(own, plain)
    return document([(data, "")], f"40 0 obj\n<< {entries} >>\nendobj\n", trailer=f"/Encrypt 40 0 R /ID [<{file_id.hex()}> <{file_id.hex()}>]")
