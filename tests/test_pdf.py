"""PDF files written here, read back as placed items and as elements."""

import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.sources import layout, pdf

FONT = b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding/FirstChar 32/LastChar 126/Widths[" + b"600 " * 95 + b"]>>"


def line(x, y, text, size=10, font="F"):
    return f"BT /{font} {size} Tf {x} {y} Td ({text}) Tj ET\n"


def page_objects(contents, fonts={"F": FONT}, extra={}, first=1):
    """Objects of a file with one page for each content: {number: bytes}, catalog first."""
    objects = {first: b"<</Type/Catalog/Pages %d 0 R>>" % (first + 1)}
    n = first + 2
    named = {}
    for name, spec in fonts.items():
        objects[n], named[name], n = spec, n, n + 1
    xobjects = {}
    for name, body in extra.items():
        objects[n], xobjects[name], n = body, n, n + 1
    kids = []
    resources = b"<</Font<<" + b"".join(f"/{k} {v} 0 R".encode() for k, v in named.items()) + b">>/XObject<<" + b"".join(f"/{k} {v} 0 R".encode() for k, v in xobjects.items()) + b">>>>"
    for content in contents:
        body = zlib.compress(content.encode("cp1252"))
        objects[n] = b"<</Filter/FlateDecode/Length %d>>stream\n" % len(body) + body + b"\nendstream"
        objects[n + 1] = b"<</Type/Page/Parent %d 0 R/Contents %d 0 R>>" % (first + 1, n)
        kids.append(n + 1)
        n += 2
    objects[first + 1] = b"<</Type/Pages/Count %d/MediaBox[0 0 600 800]/Resources " % len(kids) + resources + b"/Kids[" + b" ".join(b"%d 0 R" % k for k in kids) + b"]>>"
    return objects


def written(objects, root=1, backwards=False, table=True):
    out, places = b"%PDF-1.5\n%\xe2\xe3\n", {}
    for number in sorted(objects, reverse=backwards):
        places[number] = len(out)
        out += b"%d 0 obj\n" % number + objects[number] + b"\nendobj\n"
    if not table:
        return out + b"trailer<</Root %d 0 R>>" % root
    at, size = len(out), max(objects) + 1
    rows = [b"0000000000 65535 f \n"] + [b"%010d 00000 n \n" % places[i] if i in places else b"0000000000 00000 f \n" for i in range(1, size)]
    return out + b"xref\n0 %d\n" % size + b"".join(rows) + b"trailer<</Size %d/Root %d 0 R>>\nstartxref\n%d\n%%%%EOF" % (size, root, at)


def packed(objects, root=1):
    """All objects but streams in one object stream, found by a cross-reference stream with a predictor."""
    plain = {k: v for k, v in objects.items() if b"stream" not in v}
    heads, body = [], b""
    for number, value in plain.items():
        heads.append(b"%d %d" % (number, len(body)))
        body += value + b" "
    first = b" ".join(heads) + b" "
    stream = zlib.compress(first + body)
    number = max(objects) + 1
    out, places = b"%PDF-1.5\n", {}
    for k, value in {**{k: v for k, v in objects.items() if k not in plain}, number: b"<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>stream\n" % (len(plain), len(first), len(stream)) + stream + b"\nendstream"}.items():
        places[k] = len(out)
        out += b"%d 0 obj\n" % k + value + b"\nendobj\n"
    at, size = len(out), number + 2
    order = list(plain)
    rows = []
    for k in range(size):
        kind = (1, places[k], 0) if k in places else (2, number, order.index(k)) if k in plain else (1, at, 0) if k == number + 1 else (0, 0, 0)
        rows.append(kind[0].to_bytes(1, "big") + kind[1].to_bytes(4, "big") + kind[2].to_bytes(2, "big"))
    raw, before = b"", bytes(7)
    for row in rows:  # the second predictor: differences from the row above
        raw += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, before))
        before = row
    table = zlib.compress(raw)
    head = b"<</Type/XRef/Size %d/W[1 4 2]/Root %d 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 7>>/Length %d>>" % (size, root, len(table))
    return out + b"%d 0 obj\n" % (number + 1) + head + b"stream\n" + table + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at


COLUMNS = line(60, 760, "A heading that goes over the whole of the page, as wide as both of its columns") + "".join(
    line(x, y, f"{side} {n}") for side, x in (("right", 320), ("left", 60)) for n, y in (("three", 640), ("two", 652), ("one", 664))
) + line(60, 600, "left again") + line(320, 600, "right again")

GRID = "1 w 60 500 m 360 500 l S 60 480 m 360 480 l S 60 460 300 0.5 re f 60 460 m 60 500 l S 200 460 m 200 500 l S 360 460 m 360 500 l S\n"
TABLE = GRID + line(70, 486, "key one") + line(210, 486, "b \\(c\\)") + line(70, 466, "d") + line(60, 430, "Below the table") + line(60, 560, "Large words", 20) + line(60, 540, "small words that make the usual size of the page")


def elements(spark, files, tmp_path=None):
    rows = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "path string, content binary")
    return layout.pdf_elements(pdf.pdf_items(rows))


def told(df, path):
    return [(x.page, x.kind, x.text) for x in df if x.path == path]


@pytest.fixture(scope="module")
def found(spark):
    objects = page_objects([COLUMNS, TABLE])
    files = {
        "plain.pdf": written(objects), "backwards.pdf": written(objects, backwards=True), "packed.pdf": packed(objects), "no table.pdf": written(objects, table=False),
        "broken.pdf": written(objects).replace(b"startxref\n", b"startxref\n9"), "no.pdf": b"nothing", "null.pdf": None, "empty.pdf": b"",
        "cut.pdf": written(objects)[:-60],
    }
    return elements(spark, files).orderBy("path", "place").collect()


WANT = [
    (1, "NarrativeText", "A heading that goes over the whole of the page, as wide as both of its columns"),
    (1, "NarrativeText", "left one left two left three"), (1, "NarrativeText", "left again"),
    (1, "NarrativeText", "right one right two right three"), (1, "NarrativeText", "right again"),
    (2, "Title", "Large words"), (2, "NarrativeText", "small words that make the usual size of the page"),
    (2, "Table", "key one\tb (c)\nd\t"), (2, "NarrativeText", "Below the table"),
]


@pytest.mark.parametrize("path", ["plain.pdf", "backwards.pdf", "packed.pdf", "no table.pdf", "broken.pdf", "cut.pdf"])
def test_columns_tables_and_order(found, path):
    assert told(found, path) == WANT


def test_files_that_are_none(found):
    assert [k for _, k, _ in told(found, "no.pdf")] == [k for _, k, _ in told(found, "null.pdf")] == [k for _, k, _ in told(found, "empty.pdf")] == ["error"]


def test_boxes_are_shares_of_the_page(found):
    row = next(x for x in found if x.path == "plain.pdf" and x.text == "left again")
    assert (row.left, row.right) == pytest.approx((60 / 600, (60 + 10 * 6) / 600)) and row.top == pytest.approx((800 - 608) / 800) and row.bottom == pytest.approx((800 - 598) / 800)
    grid = next(x for x in found if x.path == "plain.pdf" and x.kind == "Table")
    assert grid.cells == [["key one", "b (c)"], ["d", ""]] and grid.left == pytest.approx(0.1) and grid.right == pytest.approx(0.6)


def test_embedded_fonts_moves_forms_and_images(spark):
    mapped = zlib.compress(b"1 begincodespacerange <0000><FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0010> <D83DDE00> endbfchar 2 beginbfrange <0021> <0023> <0041> <0030> <0031> [<00660069> <00E9>] endbfrange")
    fonts = {
        "F": FONT,
        "E": b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 90 0 R/DescendantFonts[<</DW 500/W[33[700 600] 48 49 400]>>]>>",
        "D": b"<</Type/Font/Subtype/Type1/FirstChar 1/Widths[500 500 500]/Encoding<</Differences[1/A/eacute/uni4E2D]>>>>",
    }
    form = line(0, 0, "in a form")
    extra = {"Fm": b"<</Subtype/Form/Matrix[1 0 0 1 100 100]/Length %d>>stream\n" % len(form) + form.encode() + b"\nendstream", "Im": b"<</Subtype/Image/Width 1/Height 1/Length 0>>stream\n\nendstream"}
    content = (
        "BT /E 10 Tf 1 0 0 1 60 700 Tm <00210022000300230030003100030010> Tj ET\n"
        "BT /D 10 Tf 60 650 Td (\\001\\002\\003) Tj ET\n"
        "BT /F 10 Tf 14 TL 60 600 Td [(kern) -20 (ed) -400 (apart)] TJ T* (next) Tj (line two) ' ET\n"
        "q 2 0 0 2 0 0 cm /Fm Do Q q 100 0 0 50 300 300 cm /Im Do Q\n"
    )
    objects = page_objects([content], fonts, extra) | {90: b"<</Filter/FlateDecode/Length %d>>stream\n" % len(mapped) + mapped + b"\nendstream"}
    rows = spark.createDataFrame([("a.pdf", bytearray(written(objects)))], "path string, content binary")
    got = pdf.pdf_items(rows).orderBy("place").collect()
    assert [x.text for x in got if x.kind == "word"] == ["AB", "Cfié", "😀", "Aé中", "kerned", "apart", "next", "line", "two", "in", "a", "form"]
    first = got[0]
    assert (first.x0, first.x1, first.size) == pytest.approx((60, 60 + 13, 10))
    inner = next(x for x in got if x.text == "in")
    assert (inner.x0, inner.size) == pytest.approx((200, 20))
    image = next(x for x in got if x.kind == "image")
    assert (image.x0, image.top, image.x1, image.bottom) == pytest.approx((300, 450, 400, 500))
    shown = layout.pdf_elements(pdf.pdf_items(rows)).collect()
    assert ("Image", "Im") in [(x.kind, x.text) for x in shown]


def test_turned_pages_headers_and_contents(spark):
    pages = [line(60, 780, f"Report 2024 page {i}") + line(60, 500, f"body of page number {'abcdefg'[i]}") + line(60, 10, "footer") for i in range(3)]
    pages += [line(60, 500, "Table of contents") + line(60, 488, "one ..... 3")]
    turned = {k: v.replace(b"/Type/Page/", b"/Type/Page/Rotate 180/") if b"/Type/Page/" in v else v for k, v in page_objects([line(540, 700, "x y z words")]).items()}
    got = elements(spark, {"a.pdf": written(page_objects(pages)), "b.pdf": written(turned)}).collect()
    assert sorted(x.text for x in got if x.path == "a.pdf") == [f"body of page number {c}" for c in "abc"]
    assert [x.kind for x in got if x.path == "b.pdf"] == ["NarrativeText"]
    assert next(x for x in got if x.path == "b.pdf").top > 0.8
    assert elements(spark, {"a.pdf": written(page_objects([""]))}).count() == 0


def test_values():
    data = rb"<</A [1 -2.5 (a\(b\)\101\n(c)) <414> /N#20x null true 3 0 R]/B<</C/D>>>>"
    value, _ = pdf.read_value(data, 0)
    assert value == {"A": [1, -2.5, b"a(b)A\n(c)", b"A@", "N x", None, True, pdf.Ref(3)], "B": {"C": "D"}}


def test_read_from_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.pdf").write_bytes(written(page_objects([COLUMNS])))
    (tmp_path / "in" / "other.txt").write_bytes(b"x")
    got = pdf.read_pdf(spark, str(tmp_path))
    assert got.where(F.col("kind") == "word").count() == len(COLUMNS.split("Tj")) - 1 + sum(t.count(" ") for t in [x.split(")")[0] for x in COLUMNS.split("(")[1:]])
