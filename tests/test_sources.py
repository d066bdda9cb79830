"""Sources and sinks: files are written here and read back."""

import io
import zipfile
import zlib

from pyspark.sql import functions as F

from marlstone.operators import code, entities, models, store
from marlstone.session import read_table
from marlstone.sources import files, markup, office, tables
from marlstone.streaming import events as streams

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda text, style="": f'<w:p>{f"<w:pPr>{style}</w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Über alles", '<w:pStyle w:val="Heading1"/>') + p("Contents 3", '<w:pStyle w:val="TOC1"/>') + p("First.") + p("", "") + p("item", "<w:numPr/>")
    body += f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}</w:tr></w:tbl>"
    return pack({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def pptx():
    slide = lambda t: f"<p {A}><a:p><a:r><a:t>{t}</a:t></a:r></a:p><a:tbl><a:tr><a:tc><a:p><a:r><a:t>c</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p>"
    return pack({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two"), "ppt/notesSlides/notesSlide2.xml": f"<n {A}><a:p><a:r><a:t>say this</a:t></a:r></a:p></n>"})


def xlsx():
    sheet = f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row r="2"><c r="A2"/></row><row r="3"><c r="B3"><v>4.5</v></c></row></sheetData></worksheet>'
    return pack({
        "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="One" sheetId="1" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><r><t>na</t></r><r><t>me</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet,
    })


def pdf():
    one = zlib.compress(rb"BT /F1 12 Tf 10 700 Td (Hello \(big\) w\157rld) Tj 0 -14 Td [(spl) -20 (it)] TJ T* <4142> Tj ET")
    two = b"BT (Second page) Tj ET"
    return b"%%PDF-1.4\n1 0 obj\n<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream\nendobj\n2 0 obj\n<</Length %d>>\nstream\n%s\nendstream\nendobj\n%%%%EOF" % (len(one), one, len(two), two)


def test_images_and_many_sheets(spark):
    rels = lambda target: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="{target}"/><Relationship Id="rId2" Target="http://x" TargetMode="External"/></Relationships>'
    blip = f'<w:drawing {A} {R}><a:blip r:embed="rId1"/></w:drawing>'
    word = pack({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>before</w:t>{blip}</w:r></w:p><w:p><w:r><w:t>after</w:t></w:r></w:p></w:body></w:document>", "word/_rels/document.xml.rels": rels("media/image1.png"), "word/media/image1.png": "PNG"})
    slides = pack({"ppt/slides/slide1.xml": f'<p {A} {R}><a:p><a:r><a:t>one</a:t></a:r></a:p><a:blip r:embed="rId1"/><a:blip r:embed="rId2"/></p>', "ppt/slides/_rels/slide1.xml.rels": rels("../media/pic.jpeg"), "ppt/media/pic.jpeg": "JPG"})
    sheet = f'<worksheet {S}><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>'
    book = "".join(f'<sheet name="s{i}" sheetId="{i}" r:id="rId{i}"/>' for i in range(25))
    links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet.xml"/>' for i in range(25))
    many = pack({"xl/workbook.xml": f"<workbook {S} {R}><sheets>{book}</sheets></workbook>", "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>', "xl/worksheets/sheet.xml": sheet})
    rows = spark.createDataFrame([("a.docx", bytearray(word)), ("b.pptx", bytearray(slides)), ("c.xlsx", bytearray(many)), ("d.docx", bytearray(b"no"))], "path string, content binary")
    found = office.parsed_files(rows).collect()
    assert [(x.kind, x.name or x.text) for x in found if x.path == "a.docx"] == [("NarrativeText", "before"), ("Image", "word/media/image1.png"), ("NarrativeText", "after")]
    assert [(x.kind, x.part, x.name or x.text) for x in found if x.path == "b.pptx"] == [("NarrativeText", 1, "one"), ("Image", 1, "ppt/media/pic.jpeg")]
    sheets = lambda most: office.parsed_files(rows.where("path = 'c.xlsx'"), most).count()
    assert (sheets(20), sheets(None), sheets(3)) == (20, 25, 3)
    assert sorted((x.path, x.name, x.media_type, bytes(x.content)) for x in office.images(rows).collect()) == [("a.docx", "word/media/image1.png", "image/png", b"PNG"), ("b.pptx", "ppt/media/pic.jpeg", "image/jpeg", b"JPG")]


def test_office_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, data in (("a.docx", docx()), ("b.pptx", pptx()), ("deep/c.xlsx", xlsx()), ("d.pdf", pdf()), ("e.pdf", b"broken"), ("f.docx", b"PK"), ("g.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    rows = {}
    for x in office.read_office(spark, f"file://{tmp_path}").orderBy("path", "place").collect():
        rows.setdefault(x.path.rsplit("/", 1)[1], []).append(x)
    assert [(x.kind, x.text) for x in rows["a.docx"]] == [("Title", "Über alles"), ("NarrativeText", "First."), ("ListItem", "item"), ("Table", "a | b\n1 | ")]
    assert [(x.kind, x.part, x.text) for x in rows["b.pptx"]] == [("NarrativeText", 2, "two"), ("Table", 2, "c"), ("Notes", 2, "say this"), ("NarrativeText", 10, "ten"), ("Table", 10, "c")]
    assert rows["c.xlsx"][0].name == "One" and rows["c.xlsx"][0].cells == [["name", "", "x"], ["", "4.5", ""]]
    assert [(x.part, x.text) for x in rows["d.pdf"]] == [(1, "Hello (big) world"), (1, "split"), (1, "AB"), (2, "Second page")]
    assert [x.kind for x in rows["e.pdf"] + rows["f.docx"]] == ["error", "error"] and "g.txt" not in rows


def test_ingest_is_by_content(spark):
    f = spark.createDataFrame([("/b", b"one"), ("/a", b"one"), ("/c", b"two"), ("/d", b"")], "path string, content binary")
    catalog = f.where("path = '/c'").select(F.sha2("content", 256).alias("hash"))
    new, known = office.catalogued(f, catalog)
    assert sorted(x.path for x in new.collect()) == ["/a", "/d"] and [x.path for x in known.collect()] == ["/c"]


def test_texts_are_decoded(spark, tmp_path):
    for name, data in (("a.txt", "﻿eins\r\nzwei\rdrei é".encode()), ("b.txt", "größe".encode("latin-1")), ("c.txt", "数据结构".encode("gb18030"))):
        (tmp_path / name).write_bytes(data)
    got = {x.path[-5:]: x.text for x in files.read_texts(spark, f"file://{tmp_path}").collect()}
    assert got["a.txt"] == "eins\nzwei\ndrei é" and got["c.txt"] == "数据结构"
    assert "gr" in got["b.txt"] and len(got["b.txt"]) <= 5


def test_delimited_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text('\n;;\n"a;b";c;n\n"1\n2";x;3\n;;\n4;y;5\n')
    rows = files.read_cells(spark, f"file://{tmp_path}/x.csv", sep=";")
    assert [x.cells for x in rows.orderBy("row").collect()] == [["a;b", "c", "n"], ["1\n2", "x", "3"], ["4", "y", "5"]]
    named = tables.named_rows(rows, "path").orderBy("row").collect()
    assert [(x.names, x.cells) for x in named] == [(["a;b", "c", "n"], ["1\n2", "x", "3"]), (["a;b", "c", "n"], ["4", "y", "5"])]
    few = files.read_cells(spark, f"file://{tmp_path}/x.csv", sep=";", most=2)
    assert few.count() == 2


def test_chunk_archives(spark, tmp_path):
    chunks = spark.createDataFrame([(2024, 1, 7, 0, "a"), (2024, 1, 7, 1, "b"), (2024, 2, 8, 0, "c")], "year int, month int, doc long, chunk_index int, content string")
    path = f"file://{tmp_path}/chunks"
    files.write_chunks(chunks, path, "year", "month")
    back = files.read_chunks(spark, path, chunks.schema)
    assert sorted(map(tuple, back.select(*chunks.columns).collect())) == sorted(map(tuple, chunks.collect()))
    one = back.where("year = 2024 and month = 2 and chunk_index = 0")
    assert one.select("content").first().content == "c" and "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().toString()
    new = files.replace_chunk(back, 1, "B")
    assert sorted(x.content for x in new.collect()) == ["B", "a", "c"]
    assert files.without(back, back.where("doc = 7"), "doc").count() == 1
    news = spark.createDataFrame([(2024, 2, 8, 0, "C"), (2024, 3, 9, 0, "d")], chunks.schema)
    assert sorted(x.content for x in files.merged(chunks, news, "doc").collect()) == ["C", "a", "b", "d"]


def test_markdown_of_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "﻿# A\r\ntext\r\n```\nnever closed"), (4, "no | table\nhere"), (5, "|a|\n|-|"), (6, "#no heading\n####### seven\n#\n")]
    got = {}
    for x in markup.markdown_blocks(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "place").collect():
        got.setdefault(x.doc_id, []).append((x.kind, x.level, x.text))
    assert 1 not in got and 2 not in got
    assert got[3] == [("heading", 1, "A"), ("paragraph", None, "text"), ("code", None, "never closed")]
    assert got[4] == [("paragraph", None, "no | table\nhere")] and got[5][0][0] == "table"
    assert got[6] == [("paragraph", None, "#no heading\n####### seven"), ("heading", 1, "")]


def test_html_of_odd_pages(spark):
    rows = [(1, None, None), (2, "", "u"), (3, "<h1>a<h2>b</h2><a href='x'>l", None), (4, "<table><tr><td>1<table><tr><td>in</table><td>2</table>", "https://e.example/p/")]
    got = {}
    for x in markup.html_blocks(spark.createDataFrame(rows, "page_id long, html string, url string")).orderBy("page_id", "place").collect():
        got.setdefault(x.page_id, []).append((x.kind, x.text, x.url))
    assert set(got) == {3, 4} and ("link", "l", "x") in got[3] and ("table", "in", None) in got[4]


def test_code_folders(spark, tmp_path):
    for name, text in (("a/main.py", "x = 1"), ("a/node_modules/b.js", "no"), ("a/lib/c.min.js", "no"), ("a/dist/d.ts", "no"), ("Dockerfile", "FROM x"), ("notes.xyz", "no"), ("b.go", "func f() {}")):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    got = files.read_code(spark, f"file://{tmp_path}")
    assert sorted((x.path, x.language, x.content) for x in got.collect()) == [("Dockerfile", "dockerfile", "FROM x"), ("a/main.py", "python", "x = 1"), ("b.go", "go", "func f() {}")]


def test_listings_and_watch_events(spark, tmp_path):
    import json

    page = lambda *names: json.dumps({"items": [{"kind": "Pod", "metadata": {"uid": f"u-{n}", "name": n, "namespace": "ns", "resourceVersion": "7"}, "spec": {"a": 1}, "status": {"phase": "Running"}} for n in names]})
    (tmp_path / "1.json").write_text(page("a", "b"))
    (tmp_path / "2.json").write_text(page("c"))
    rows = {x.uid: x for x in files.read_listing(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {"u-a", "u-b", "u-c"} and rows["u-c"].resource_version == "7" and json.loads(rows["u-a"].status) == {"phase": "Running"}
    event = lambda kind, uid, version: json.dumps({"type": kind, "object": {"metadata": {"uid": uid, "resourceVersion": version}}})
    lines = [event("ADDED", "x", "1"), event("MODIFIED", "x", "2"), json.dumps({"type": "ERROR", "object": {"code": 410}}), "broken", ""]
    (tmp_path / "watch").mkdir()
    (tmp_path / "watch" / "1.txt").write_text("\n".join(lines))
    table = streams.run_to_end(files.watch_stream(spark, f"file://{tmp_path}/watch"), "test_watch", "append").collect()
    assert sorted((x.type, x.uid, x.resource_version, x.relist) for x in table if x.type != "ERROR") == [("ADDED", "x", "1", False), ("MODIFIED", "x", "2", False)]
    assert [x.relist for x in table if x.type == "ERROR"] == [True] and len(table) == 3


def test_streams_into_files_and_merges(spark, sf, tmp_path):
    events = read_table(spark, sf, "events")
    stream = lambda: streams.as_stream(spark, sf, events.schema, "events.parquet")
    for _ in range(2):  # the second run finds nothing new
        streams.to_files(stream(), f"file://{tmp_path}/out", f"file://{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == events.count()
    seen = {}
    streams.reconciled(stream(), lambda batch, number: seen.update({number: batch.count()}), f"file://{tmp_path}/c2").awaitTermination()
    assert sum(seen.values()) == events.count()
    counts = {tuple(x) for x in streams.run_to_end(streams.tumbling(stream(), "ts", "1 day", "event_type", late="1 hour"), "test_tumbling", "append").select("window_start", "event_type", "n").collect()}
    want = {tuple(x) for x in streams.tumbling(events, "ts", "1 day", "event_type").select("window_start", "event_type", "n").collect()}
    assert counts and counts <= want  # the last windows are still open


def test_exports_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "hi",\nthere', None), (2, None, 2.5)], "id int, text string, value double")
    store.write_csv(rows, f"file://{tmp_path}/csv")
    back = spark.read.csv(f"file://{tmp_path}/csv", header=True, multiLine=True, escape='"')
    assert sorted((x.id, x.text, x.value) for x in back.collect()) == [("1", 'say "hi",\nthere', None), ("2", None, "2.5")]
    store.write_json(rows, f"file://{tmp_path}/json")
    assert sorted(spark.read.text(f"file://{tmp_path}/json").collect())[1].value == '{"id":2,"text":null,"value":2.5}'
    one = store.json_array(rows, [], "id").first().json
    assert one.startswith('[{"id":1,') and one.endswith('"value":2.5}]')


def test_models_are_hooks(spark):
    def model():
        def ask(texts):
            if any("fail" in t for t in texts):
                raise RuntimeError("lost")
            return [t.upper() for t in texts]

        return ask

    rows = spark.createDataFrame([(i, f"t{i}" if i != 7 else "fail") for i in range(10)] + [(10, None)], "id int, text string").coalesce(1)
    got = {x.id: x.answer for x in models.answers(rows, "id", "text", model, batch=5).collect()}
    assert got[0] == "T0" and [got[i] for i in range(5, 10)] == [""] * 5 and got[10] == ""
    vectors = models.embeddings(rows, "id", "text", lambda: lambda texts: [[float(len(t or ""))] * 2 for t in texts], batch=4)
    assert [list(x.embedding) for x in vectors.orderBy("id").collect()][6:8] == [[2.0, 2.0], [4.0, 4.0]]
    scored = models.pair_scores(rows.where("text is not null"), "t3", "text", lambda: lambda qs, cs: [float(q == c) for q, c in zip(qs, cs)])
    assert [x.id for x in scored.where("rerank_score = 1").collect()] == [3]
    wrong = models.applied(rows, lambda: lambda texts: texts[:-1], ["text"], "string", failed="lost")
    assert {x.answer for x in wrong.collect()} == {"lost"}
    told = models.extracted(rows, "id", "text", lambda: lambda ts: [f"关键词：{t}、b\n摘要：about {t}" for t in ts], entities.parse_answer)
    assert told.where("id = 2").first() == (2, ["t2", "b"], "about t2")


def test_code_is_made_compact(spark):
    long = '"""Doc."""\nimport os\n\n# note\ndef f(a):\n    return a\n' + "x = 1\n" * 1000
    many = "".join(f"def function_number_{i}(argument, another):\n    pass\n" for i in range(80))
    got = [x.c for x in spark.createDataFrame([(1, long), (2, many), (3, "")], "i int, t string").orderBy("i").select(code.compact(F.col("t")).alias("c")).collect()]
    assert got[0].startswith("Doc.\n# note\nimport os\ndef f(a):\n") and len(got[0]) <= 2000
    assert got[1].count("def ") <= 50 and len(got[1]) <= 2000 and not got[1].endswith("def") and got[2] == ""


def test_odd_code_files(spark):
    rows = [("a.py", "python", "def f(:"), ("b.py", "python", None), ("c.py", "python", "x = (lambda: 1)()"), ("d.xyz", None, "what"), ("e.rb", "ruby", "class A\n  def self.go?\n  end\nend\n")]
    files_ = spark.createDataFrame(rows, "path string, language string, content string")
    assert sorted((x.path, x.kind, x.name) for x in code.symbols(files_).collect()) == [("e.rb", "class", "A"), ("e.rb", "function", "go?")]
    assert code.imports(files_).count() == code.calls(files_).count() == code.inherits(files_).count() == 0


def test_wide_tables_keep_dense_and_numeric_columns(spark):
    wide = [[str(i) if c == 24 else "x" if c < 15 or i % 2 else "" for c in range(25)] for i in range(6)]
    rows = spark.createDataFrame([("w", i, r) for i, r in enumerate(wide)] + [("n", 0, ["a", ""])], "sheet string, row int, cells array<string>")
    got = {x.sheet: x.kept for x in tables.kept_columns(tables.column_kinds(rows, "sheet"), "sheet").collect()}
    assert got["w"] == [*range(10), 24] and got["n"] == [0, 1]
    table = rows.where("sheet = 'n'").select(tables.markdown_table(F.array(F.lit("p"), F.lit("q")), F.array("cells", F.array(F.lit("y" * 200)))).alias("t")).first().t
    assert table == "| p | q |\n| --- | --- |\n| a |  |\n| " + "y" * 100 + " |  |"
