import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from searchloom.functions import analysis, files, ordering, stemmer
from searchloom.plans.query import Token, parse


def test_parse():
    t = lambda *a: Token(*a)
    assert parse("practicum report").tokens == (t("practicum"), t("report"))
    assert parse('"quarterly report"').tokens == (t("quarterly report", True),)
    assert parse('report -draft -"old version"').tokens == (t("report"), t("draft", False, True), t("old version", True, True))
    p = parse("report ext:docx")
    assert p.tokens == (t("report"),) and p.ext == ".docx"
    assert parse("ext:.PDF").ext == ".pdf" and parse('EXT:"xlsx"').ext == ".xlsx"
    assert parse("path:D:\\Work\\ report").path == "D:\\Work\\"
    assert parse('path:"D:\\My Files\\" report').path == "D:\\My Files\\"
    p = parse("ext:docx ext:pdf")
    assert p.ext == ".docx" and not p.tokens
    p = parse('"практикум номер 1" -черновик ext:docx path:D:\\Work\\')
    assert (len(p.wanted), len(p.unwanted), p.ext, p.path) == (1, 1, ".docx", "D:\\Work\\")
    assert parse("").tokens == () and parse("report - draft").tokens == (t("report"), t("draft")) and parse('"" report').tokens == (t("report"),)
    assert parse("-ext:pdf").tokens == (t("ext:pdf", False, True),) and parse("-ext:pdf").ext is None
    assert parse("--x").tokens == (t("-x", False, True),)
    assert parse('a"b').tokens == (t('a"b'),)
    assert parse('"open end').tokens == (t("open end", True),)
    assert parse("ext: report").tokens == (t("report"),) and parse("ext: report").ext is None


def test_stems():
    one = lambda s: len({stemmer.stem(w) for w in s.split()}) == 1
    assert one("практикум практикума практикуму практикумом практикумы") and one("программа программы программу программой программ")
    assert one("читать читал читала читали читаю читает") and one("красивый красивая красивое красивые красивых")
    assert [stemmer.stem(w) for w in ("hello", "practicum2", "и", "")] == ["hello", "practicum2", "и", ""]
    assert stemmer.stem("практикум") != stemmer.stem("документ") and stemmer.stem("ёлка") == stemmer.stem("елка")


def test_stemmer_in_python_and_as_a_column(spark):
    import random

    rng = random.Random(0)
    ends = " ".join([stemmer.NOUN, stemmer.VERB_1, stemmer.VERB_2, stemmer.ADJECTIVE, stemmer.GERUND_1, stemmer.DERIVATIONAL, stemmer.SUPERLATIVE, "ся нн ь"]).split()
    words = ["".join(rng.choice("абвгдеёиклмнорстуя") for _ in range(rng.randint(1, 6))) + rng.choice(ends) + rng.choice(["", "ся", "нный"]) for _ in range(3000)] + ["hello", "дом2"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stemmer.stem_column(F.col("w")).alias("s")).collect()
    assert all(r.s == stemmer.stem(r.w) for r in rows)


def test_words(spark):
    texts = ["don't a_b 3.14 café À", "e\u0301te\u0301 и\u0306 й ё", "«Михайлов»—Ещё", "", None, "日本 x²"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", analysis.words(F.col("t")).alias("w"), analysis.exact_words(F.col("t")).alias("e")).collect()
    assert [r.w for r in rows] == [["don", "t", "a", "b", "3", "14", "cafe", "a"], ["ete", "и", "й", "ё"], ["михайлов", "ещё"], [], [], ["日本", "x²"]]
    assert rows[2].e == ["михайлов", "еще"]
    assert all(r.e == analysis.analyze_text(r.t or "", True) for r in rows)


def _natural(a, b):
    """A plain comparator of two names."""
    f = dict(zip(ordering._FROM, ordering._TO, strict=True))
    piece = lambda s: [(1, int(x)) if x.isdigit() else (0, x) for x in re.findall(r"[0-9]+|[^0-9]", "".join(f.get(c, c) for c in s))]
    for x, y in zip(piece(a), piece(b), strict=False):
        kx, ky = ((0x31, v) if n else (ord(v) + 1, 0) for n, v in (x, y))
        if kx != ky:
            return -1 if kx < ky else 1
    return (len(piece(a)) > len(piece(b))) - (len(piece(a)) < len(piece(b)))


def test_natural_order(spark):
    pairs = [("а", "Б"), ("Ежевика", "ёлка"), ("ёлка", "Жук"), ("apple", "Banana"), ("zebra", "арбуз"), ("Договор 2.docx", "Договор 10.docx"), ("file9", "file10"), ("v1.9", "v1.10"), ("2023-12", "2024-01"), ("007", "8"), ("файл 19", "файл 100"), ("a1b", "a01c")]
    import random

    rng = random.Random(2)
    names = sorted({"".join(rng.choice("abB12 0é.ё") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    pairs += [(a, b) if _natural(a, b) < 0 else (b, a) for a in names for b in names if _natural(a, b)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", (ordering.natural_key(F.col("a")) < ordering.natural_key(F.col("b"))).alias("less")).collect()
    assert [(r.a, r.b) for r in rows if not r.less] == []


PATHS = ["/Alpha/x.txt", "/EcoLine/Архив/c.docx", "/EcoLine/ВАЖНОЕ/Подпапка/b.docx", "/EcoLine/ВАЖНОЕ/а.docx", "/EcoLine/ВАЖНОЕ/я.docx", "/EcoLine/ВАЖНОЕ 2/a.docx", "/EcoLine/ВАЖНОЕ.old/d.docx", "/EcoLine/важное.txt"]


def test_tree_order(spark):
    df = spark.createDataFrame([(p,) for p in reversed(PATHS)], "path string")
    got = lambda *a: [PATHS.index(r.path) for r in df.orderBy(*ordering.tree_order(F.col("path"), *a)).collect()]
    assert got(True, False) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert got(True, True) == [6, 5, 2, 4, 3, 1, 7, 0]
    assert got(False, False) == [0, 7, 1, 3, 4, 2, 5, 6]
    assert got(False, True) == [7, 6, 5, 4, 3, 2, 1, 0]
    two = spark.createDataFrame([("D:\\z.txt",), ("D:\\Work\\a.txt",)], "path string")
    assert [r.path for r in two.orderBy(*ordering.tree_order(F.col("path"))).collect()] == ["D:\\Work\\a.txt", "D:\\z.txt"]


def test_file_functions(spark):
    df = spark.createDataFrame([("/a/b.TXT", ".xlsx", 10, 90), ("C:\\d\\.git", ".PDF", 100, 3700), ("x", ".exe", 9_000_000, 5)], "p string, e string, n long, s long")
    rows = df.select(files.base_name(F.col("p")), files.extension(files.base_name(F.col("p"))), files.text_bytes(F.col("e"), F.col("n")), files.heavy(F.col("e"), F.col("n"), 50), files.heavy(F.col("e"), F.col("n"), 0), files.extractable(F.col("e")), files.size_text(F.col("n")), files.duration_text(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("b.TXT", ".TXT", 60, True, False, True, "10 B", "1:30"), (".git", "", 25, False, False, True, "100 B", "1:01:40"), ("x", "", 0, False, False, False, "8.6 MB", "0:05")]
    masked = lambda p, *m: spark.createDataFrame([(p,)], "p string").select(files.excluded(F.col("p"), list(m))).first()[0]
    assert masked("app/node_modules/lib/x.js", "node_modules") and masked("app/cache.TMP", "*.tmp") and not masked(".gitignore", ".git") and masked("~$report.docx") and not masked("~report.docx") and not masked("a.txt")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab -"\t:extpath.', max_size=30))
def test_any_query_parses(raw):
    p = parse(raw)
    assert all(t.text for t in p.tokens) and (p.ext is None or p.ext.startswith("."))
