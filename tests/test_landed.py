"""Landed responses, office files, names, plans and grids."""

import hashlib
import hmac
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from basalt.operators import batching
from basalt.operators import landed as L
from basalt.sources import office


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


W = 'xmlns:w="http://w"'
BOOK = {
    "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="Data" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row/><row><c r="B3" t="inlineStr"><is><t>in line</t></is></c><c r="C3" t="s"><v>1</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>",
}
DOC = {"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One </w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>x</w:t><w:br/><w:t>y</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>End</w:t></w:r></w:p></w:body></w:document>"}
SLIDES = {f"ppt/slides/slide{n}.xml": f'<p:sld xmlns:p="http://p" xmlns:a="http://a"><a:p><a:r><a:t>Slide {n}</a:t></a:r></a:p><a:p/></p:sld>' for n in (1, 2, 10)}


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    for name, content in (("a.xlsx", packed(BOOK)), ("b.docx", packed(DOC)), ("c.pptx", packed(SLIDES)), ("d.docx", b"not a zip"), ("e.xlsx", packed({"x": "y"})), ("f.txt", b"other")):
        (tmp_path / name).write_bytes(content)
    got = {r["file"].rpartition("/")[2]: r for r in office.parsed(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.xlsx", "b.docx", "c.pptx", "d.docx", "e.xlsx"}
    assert got["a.xlsx"]["text"] == "[Data]\n| name |  | 7 |\n|---|---|---|\n|  | in line | ab |"
    assert (got["b.docx"]["text"], got["b.docx"]["tables"], got["b.docx"]["confidence"]) == ("One \ttwo\n\nEnd", ["| h | x y |\n|---|---|\n|  | 2 |"], 1.0)
    assert got["c.pptx"]["text"] == "--- Slide 1 ---\nSlide 1\n\n--- Slide 2 ---\nSlide 2\n\n--- Slide 3 ---\nSlide 10" and got["c.pptx"]["n_pages"] == 3
    assert got["d.docx"]["error"] and got["e.xlsx"]["confidence"] == 0.0


def test_signatures(spark):
    for secret in ("k", "long" * 40):
        for kind in ("sha256", "sha1"):
            good = hmac.new(secret.encode(), "bödy".encode(), kind).hexdigest()
            for header, want in ((f"{kind}={good}", True), (f" {kind.upper()} = {good} ", True), (f"{kind}={good[:-1]}0x", False), (f"md5={good}", False), ("", False), (None, False), (good, False)):
                assert one(spark, L.signed(F.lit("bödy"), secret, F.lit(header))) is want, (kind, header)
    assert one(spark, L.signed(F.lit("b"), "", F.lit("sha256=x"))) is False
    assert hashlib.sha256(b"").hexdigest()


def test_names_of_files(spark):
    assert one(spark, L.repaired(F.lit("보고서.pdf".encode().decode("latin-1")))) == "보고서.pdf"
    assert one(spark, L.repaired(F.lit("보고서".encode("cp949").decode("latin-1")))) == "보고서"
    assert [one(spark, L.repaired(F.lit(x))) for x in ("plain", "보고서", "a%20b", None)] == ["plain", "보고서", "a%20b", None]
    assert [one(spark, L.disposition_name(F.lit(h))) for h in ("attachment; filename*=UTF-8''a%20b.pdf; x", 'x; filename="q.txt"', "filename*=euc-kr''z.doc", "inline", "filename=50%.pdf")] == ["a b.pdf", "q.txt", "z.doc", "", "50%.pdf"]
    assert [one(spark, L.extension_of(F.lit(t))) for t in ("application/pdf", "application/x-hwp", "application/zip", "image/jpeg", "text/plain", "x")] == [".pdf", ".hwp", ".zip", ".jpg", ".txt", ".bin"]


def test_pages_of_listings(spark):
    rows = [("a", 0, i) for i in range(3)] + [("a", 1, i) for i in range(2)] + [("a", 2, i) for i in range(3)] + [("b", 1, 0)] + [("c", 0, i) for i in range(3)] + [("c", 2, 0)]
    got = L.offset_pages(spark.createDataFrame(rows, "k string, p int, i int"), "k", "p", 3).collect()
    assert sorted({(r["k"], r["p"]) for r in got}) == [("a", 0), ("a", 1), ("c", 0)]


def test_month_grid_of_odd_pages():
    assert L.month_grid(None, 2026) == {"year_month": None, "days": [], "people": []}
    page = '<a href="/x?date=2025-03-01">x</a><div class="p-periodType-monthly-x">2026년 7월</div><div data-role="header-row-cell" class="period-monthly"><span>31</span><span>일</span></div><div data-role="header-row-cell" class="other"><span>1</span></div>'
    got = L.month_grid(page, 2020)
    assert got["year_month"] == "2026-07" and got["days"] == [{"day": 31, "weekday": "일", "date": "2026-07-31", "is_weekend": True}]
    assert L.month_grid('<a href="/x?date=2025-03-01">x</a>', 2020)["year_month"] == "2025-03"


def test_windows_in_time(spark):
    rows = [("q", t) for t in (0.0, 0.01, 0.049, 0.05, 0.2)] + [("r", float(t) / 1000) for t in range(20)]
    got = batching.windows(spark.createDataFrame(rows, "k string, t double").repartition(3), "k", "t", 0.05, 16).collect()
    assert [r["batch"] for r in sorted((r for r in got if r["k"] == "q"), key=lambda r: r["t"])] == [0, 0, 0, 1, 2]
    assert sorted(r["batch"] for r in got if r["k"] == "r") == [0] * 16 + [1] * 4


def folded(rows, seconds, most):
    """Batches by a plain loop: (key, place) -> batch, and what is shown at the first row of each."""
    out, shown, of = {}, [], object()
    for k, t, i, d in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        if k != of:
            of, start, count, batch, text, new = k, t, 0, 0, "", True
        elif t - start >= seconds or (most and count >= most):
            start, count, batch, new = t, 0, batch + 1, True
        count += 1
        text += d
        out[i] = batch
        if new:
            shown.append((k, t, text))
            new = False
    return out, shown


@pytest.mark.parametrize("seed,seconds,most,parts", [(1, 0.05, 16, 7), (2, 0.1, None, 9), (3, 1.0, 3, 5), (4, 50.0, None, 6), (5, 0.3, 1, 4), (6, 0.7, 40, 1), (7, 0.001, 5, 8)])
def test_one_key_over_many_ranges(spark, seed, seconds, most, parts):
    r = random.Random(seed)
    rows = [("hot", round(r.uniform(0, 40), r.choice([1, 3])), i, r.choice(["a", "bc", ""])) for i in range(900)]
    rows += [(r.choice(["a", "b", None, "z"]), round(r.uniform(0, 5), 1), 1000 + i, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t double, i long, d string").repartition(3)
    want, shown = folded(rows, seconds, most)
    got = batching.windows(df, "k", "t", seconds, most, parts)
    assert got.columns == ["k", "t", "i", "d", "batch"] and {x["i"]: x["batch"] for x in got.collect()} == want
    if most is None:
        found = batching.throttled(df, "k", "t", seconds, "d", parts).collect()
        assert sorted(((x["k"], x["t"], x["text"]) for x in found), key=str) == sorted(shown, key=str)
        assert all(len(x["text"]) == x["n_chars"] for x in found)
    assert batching.windows(df.limit(0), "k", "t", seconds, most).count() == 0


def test_served_files(spark):
    folder = next(iter(L.FOLDERS.values()))
    for asked, path, want in (("a.pdf", f"/x/{folder}/s/a.pdf", True), ("../a.pdf", f"/x/{folder}/a.pdf", False), ("a.pdf", f"/x/{folder}/../../a.pdf", False), ("", f"/x/{folder}/", False), ("a.pdf", "/x/other/a.pdf", False), (None, f"/x/{folder}/a.pdf", False)):
        assert one(spark, L.served_file(F.lit(asked), F.lit("/x"), F.lit(path))) is want, (asked, path)
