import zipfile
import zlib

from searchloom.operators.maintain import PROBLEMS
from searchloom.sources import crypto, filetree, office, pdf, samples
from searchloom.sources.extract import extract, extract_files
from searchloom.sources.samples import archive, document, encrypted


def test_docx():
    body = '<w:document><w:tblPr w:val="dxa"/><w:p><w:r><w:t>First &amp; more</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve"> Второй</w:t><w:tab/><w:t>x</w:t><w:br/><w:t/><w:t>&#1041;&#x42;&nope;</w:t></w:r></w:p></w:document>'
    parts = {"word/header1.xml": "<w:p><w:t>Head</w:t></w:p>", "word/document.xml": body, "word/media/i.png": "x" * 3_000_000, "word/footnotes.xml": "<w:t>Foot</w:t>", "word/charts/chart1.xml": "<a:p><a:t>Chart</a:t></a:p>", "word/comments.xml": "<w:t>Note</w:t>", "word/styles.xml": "<w:t>no</w:t>"}
    text, problem, _ = extract(archive(parts), ".DOCX")
    assert problem == 0 and text.startswith("First & more\n Второй\tx\nБB&nope;") and all(x in text for x in ("Head", "Foot", "Chart", "Note")) and "dxa" not in text and "no" not in text.split()
    assert extract(archive(parts, zipfile.ZIP_STORED), ".docx")[0] == text
    assert extract(archive(parts), ".docx", max_bytes=1024)[0] == text  # the size of the archive is no limit
    assert extract(archive(parts), ".docx", max_unpacked=64)[1] == PROBLEMS["TooLarge"]


def test_xlsx():
    parts = {
        "xl/workbook.xml": '<workbook><sheets><sheet name="Q&amp;A" sheetId="1"/><sheet sheetId="2" name="Итоги"/></sheets></workbook>',
        "xl/sharedStrings.xml": "<sst><si><t>Apple</t></si><si><r><t>Ба</t></r><r><t>нан</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c t="inlineStr"><is><t>Extra note</t></is></c><c><v>582030</v></c><c t="n"><v>1250.75</v></c><c t="b"><v>1</v></c><c t="e"><v>#DIV/0!</v></c><c t="str"><f>2*A1</f><v>1164060</v></c><c t="s"><v>99</v></c><c r="Z"/></row>',
        "xl/comments1.xml": "<comments><authors><author>Ann</author></authors><comment><text><r><t>seen</t></r></text></comment></comments>",
        "xl/charts/chart1.xml": "<a:p><a:t>Sales</a:t></a:p>", "xl/drawings/drawing1.xml": "<a:t>Box</a:t>",
    }
    text, problem, _ = extract(archive(parts), ".xlsx")
    assert problem == 0 and text.split("\n")[:3] == ["Q&A", "Итоги", "Apple Банан Extra note 582030 1250.75 1164060 "]
    assert all(x in text for x in ("seen", "Sales", "Box")) and not any(x in text for x in ("Ann", "#DIV/0!"))
    assert extract(archive(parts), ".xlsx", max_unpacked=64)[1] == PROBLEMS["TooLarge"]


def test_plain_pdf():
    text = lambda data: extract(data, ".pdf")[0]
    assert text(document([(b"BT /F1 12 Tf (Hello PDF) Tj ET", "")])) == "Hello PDF"
    assert text(document([(b"BT [(Hello) -500 (World) 20 (s)] TJ ET", "")])) == "Hello Worlds"
    assert text(document([(zlib.compress(b"BT (a\\(b\\)\\101\\\n!) Tj <4869> Tj ET"), "/Filter /FlateDecode")])) == "a(b)A!Hi"
    cut = zlib.compress(b"BT (kept) Tj ET " + bytes(range(256)) * 40)[:-40]
    assert text(document([(cut, "/Filter /FlateDecode")])).startswith("kept")


def test_pdf_maps_and_images():
    cmap = "begincmap 2 beginbfchar <01> <0410> <02> <0411> endbfchar endcmap"
    wide = "begincmap 1 beginbfrange <0003> <0005> <0412> endbfrange endcmap"
    extra = f"20 0 obj\n<< /Type /Font /ToUnicode 21 0 R >>\nendobj\n21 0 obj\n<< /Length {len(cmap)} >>\nstream\n{cmap}\nendstream\nendobj\n22 0 obj\n<< /Type /Font /ToUnicode 23 0 R >>\nendobj\n23 0 obj\n<< /Length {len(wide)} >>\nstream\n{wide}\nendstream\nendobj\n"
    body = b"BT /F1 9 Tf <0102> Tj /F2 9 Tf <00030004> Tj ET"
    assert extract(document([(body, "")], extra, "/F1 20 0 R /F2 22 0 R"), ".pdf")[0] == "АБВГ"
    assert extract(document([(b"BT <0102> Tj ET", "")], extra), ".pdf")[0] == "АБ"  # no font is named, the best map is found
    image = "30 0 obj\n<< /Subtype /Image /Length 20 >>\nstream\n(IMG) Tj (not text) \nendstream\nendobj\n"
    assert extract(document([(b"BT (page) Tj ET", "")], image), ".pdf")[0] == "page"
    assert extract(document([], image), ".pdf")[1] == PROBLEMS["ImagesOnly"]


def test_problems():
    reason = lambda data, ext, **k: extract(data, ext, **k)[1]
    p = PROBLEMS
    assert reason(b"", ".txt") == 0 and reason(None, ".txt") == p["CannotOpen"] and reason(b"z" * 4000, ".docx") == p["Damaged"] and reason(b"z" * 4000, ".xlsx") == p["Damaged"]
    assert reason(bytes.fromhex("D0CF11E0A1B11AE1") + b"x" * 99, ".docx") == p["Protected"] and reason(archive({"x": "y"}), ".docx") == p["Damaged"]
    assert reason(b"no pdf", ".pdf") == p["Damaged"] and reason(b"x" * 200, ".txt", max_bytes=100) == p["TooLarge"] and reason(b"x", ".exe") == 0
    assert reason(document([(b"BT (x) Tj ET", "")], trailer="/Encrypt 99 0 R"), ".pdf") == p["Protected"]


def test_ciphers():
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    for key, want in ((bytes(range(16)), "69c4e0d86a7b0430d8cdb78070b4c55a"), (bytes(range(32)), "8ea2b7ca516745bfeafc49904b496089")):
        aes = crypto.AES(key)
        assert aes.encrypt_block(block).hex() == want and aes.decrypt_block(bytes.fromhex(want)) == block


def test_encrypted_pdfs():
    for r in (2, 3, 4, 5, 6):
        assert extract(encrypted(r), ".pdf")[:2] == ("Secret contract text", 0), r
        assert extract(encrypted(r, b"secret"), ".pdf")[1] == PROBLEMS["Protected"], r
        assert extract(encrypted(r, broken=True), ".pdf")[1] == PROBLEMS["Protected"], r


def test_files_to_text(spark, tmp_path):
    (tmp_path / "good.txt").write_text("Hello plain text")
    (tmp_path / "broken.docx").write_bytes(b"z" * 4000)
    (tmp_path / "page.pdf").write_bytes(document([(b"BT (Hello PDF) Tj ET", "")]))
    rows = extract_files(filetree.binary_files(spark, str(tmp_path))).collect()
    assert {r.name: (r.content, r.problem) for r in rows} == {"good.txt": ("Hello plain text", 0), "broken.docx": ("", 2), "page.pdf": ("Hello PDF", 0)}


def test_unescape_and_cmap_edges():
    assert office.unescape("&lt;&gt;&quot;&apos;&#65;&#x1F600;&#xD800;&#99999999;&") == "<>\"'A\U0001f600&#xD800;&#99999999;&"
    assert pdf.inflate(b"\xff\xff\xff\xff") is None and pdf.inflate(zlib.compress(b"x" * 500)[2:-4]) == b"x" * 500


def test_long_pdf_strings_in_linear_steps():
    """A shown text is read by stretches between its brackets and escapes, not by bytes."""
    import sys

    text, lines = "plain words (in brackets) and a\\slash " * 20_000, 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    data = samples.pdf(text)
    sys.settrace(count)
    try:
        got = pdf.extract(data)[0]
    finally:
        sys.settrace(None)
    assert got == text.strip("\n") and lines < len(text)
    for raw in (b"a(b(c)d)e) x", b"a\\101\\n\\\r\nb) x", b"open \\", b"", b"x\\"):
        own, end = pdf._string(b"(" + raw, 0)
        assert own == {b"a(b(c)d)e) x": b"a(b(c)d)e", b"a\\101\\n\\\r\nb) x": b"aA\nb", b"open \\": b"open \\", b"": b"", b"x\\": b"x\\"}[raw] and end == (len(raw) - 1 if raw.endswith(b" x") else len(raw) + 1)


def test_files_of_a_query_are_made_once(spark):
    from searchloom import catalogue_runs as R

    made = spark.sparkContext.accumulator(0)

    def make(text, number, note):
        made.add(1)
        return samples.pdf(text)

    rows = spark.createDataFrame([(str(k), f"text {k}", k, "") for k in range(150)], "key string, text string, number long, note string")
    assert sorted((r.path, r.chars) for r in R._texts(R._made(rows, make, ".pdf")).collect()) == sorted((str(k), len(f"text {k}")) for k in range(150))
    assert made.value == 150
