"""Whole plans on small files made here: errors and left-out files as rows, pictures, PDF pages, sections, names, scans."""

import io
import random
import re
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from papyrine.operators import layout, markdown, outline
from papyrine.operators.html import without_silent
from papyrine.plans import sql
from papyrine.plans.convert import Options, convert_paths, in_input_order, sheets_markdown, summary
from papyrine.operators import tables
from papyrine.sources import containers, writers
from papyrine.sources.containers import png
from papyrine.sources.files import write_results
from papyrine.sources.pictures import measure

DOT = png(bytes([200] * 30), 5, 2, 3)


def pdf(pages: list[list[tuple[str, float, float, float]]], image: bytes | None = None) -> bytes:
    """A PDF of (text, size, x, y from the bottom) lines; the first page shows the image, 5 by 2 pixels of RGB."""
    out = b"%PDF-1.4\n"
    first = 4 + 2 * len(pages)
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(pages)))
    out += b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [%s] /Count %d>> endobj\n3 0 obj <</Type /Font /BaseFont /Helvetica>> endobj\n" % (kids.encode(), len(pages))
    for k, lines in enumerate(pages):
        code = "".join(f"BT /F1 {s} Tf {x} {y} Td ({t}) Tj ET\n" for t, s, x, y in lines).encode("latin-1")
        more = f"/XObject <</I {first} 0 R>>" if image and k == 0 else ""
        out += f"{4 + 2 * k} 0 obj <</Type /Page /Parent 2 0 R /MediaBox [0 0 300 200] /Contents {5 + 2 * k} 0 R /Resources <</Font <</F1 3 0 R>> {more}>>>> endobj\n{5 + 2 * k} 0 obj <</Length {len(code)}>> stream\n".encode() + code + b"\nendstream endobj\n"
    if image:
        out += b"%d 0 obj <</Subtype /Image /Width 5 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /FlateDecode>> stream\n" % first + zlib.compress(image) + b"\nendstream endobj\n"
    return out + b"%%EOF"


def test_rows_for_missing_and_unsupported_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x\n")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.txt").write_text("x")
    rows = convert_paths(spark, [str(tmp_path / n) for n in ("a.md", "b.txt", "none.docx", "in")]).cache()
    assert summary(rows).first().asDict() == {"success": 1, "error": 1, "skipped": 1, "cancelled": 0}
    assert rows.filter("status = 'error'").first().source.endswith("none.docx") and rows.filter("status = 'skipped'").first().source.endswith("b.txt")
    assert [r.source.rsplit("/", 1)[1] for r in in_input_order(rows).collect()] == ["a.md", "b.txt", "none.docx"]
    assert summary(convert_paths(spark, [str(tmp_path / "gone")])).first().error == 1


def test_pictures_of_markdown(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a b.png").write_bytes(DOT)
    (tmp_path / "n.md").write_text("# T\n\nx ![al](p/a%20b.png) y ![far](http://x/y.png) ![no](p/none.png)\n\n[all](http://u)\n")
    word = convert_paths(spark, [str(tmp_path)], Options()).first()
    with zipfile.ZipFile(io.BytesIO(word.content)) as z:
        assert z.read("word/media/image1.png") == DOT and 'descr="al"' in z.read("word/document.xml").decode() and len(word.warnings) == 2
        assert '<w:pgSz w:w="11906" w:h="16838"/>' in z.read("word/document.xml").decode()
    sheet = convert_paths(spark, [str(tmp_path)], Options(target=".xlsx")).first()
    with zipfile.ZipFile(io.BytesIO(sheet.content)) as z:
        assert z.read("xl/media/image1.png") == DOT and 'Target="http://u"' in z.read("xl/worksheets/_rels/sheet1.xml.rels").decode()
    assert [(c[2], c[4]) for c in containers.xlsx_cells(sheet.content)][:3] == [(0, "x"), (2, "al"), (3, "y")]
    assert measure(DOT) == ("png", 5, 2) and measure(b"GIF89a" + struct.pack("<HH", 7, 8)) == ("gif", 7, 8) and measure(b"x") is None
    assert writers.docx("![a](b)", finder=lambda p: None)


def test_pdf_pages_by_layout(spark, tmp_path):
    one = [("Title of it", 18, 20, 170), ("body line one", 10, 20, 140), ("goes on here", 10, 20, 127), ("new paragraph far below", 10, 20, 80), ("\x95 no bullet", 10, 20, 40)]
    two = [("Part", 13, 20, 170), ("- first", 10, 20, 150), ("- second", 10, 20, 138), ("1. one", 10, 20, 126)]
    (tmp_path / "s.pdf").write_bytes(pdf([one, two], bytes([9] * 30)))
    (tmp_path / "e.pdf").write_bytes(pdf([[]]))
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 /Encrypt")
    rows = {r.source.rsplit("/", 1)[1]: r for r in convert_paths(spark, [str(tmp_path)], Options(add_title=False)).collect()}
    assert rows["s.pdf"].markdown == "# Title of it\n\nbody line one goes on here\n\nnew paragraph far below\n\n\x95 no bullet\n\n![](s_images/image1.png)\n\n## Part\n\n- first\n- second\n1. one\n"
    assert [(a.name, measure(a.content)) for a in rows["s.pdf"].assets] == [("s_images/image1.png", ("png", 5, 2))]
    assert rows["e.pdf"].status == rows["x.pdf"].status == "error" and "password" in rows["x.pdf"].message
    write_results(spark.createDataFrame([rows["s.pdf"]], convert_paths(spark, [str(tmp_path)]).schema), str(tmp_path / "out"))
    assert (tmp_path / "out" / "s_images" / "image1.png").exists()


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams of 4096 bytes at least (padded with zeros), sectors of 512."""
    sectors, fat, entries = [], [], []

    def put(data: bytes) -> int:
        first = len(sectors)
        for k in range(0, len(data), 512):
            sectors.append(data[k : k + 512].ljust(512, b"\0"))
            fat.append(len(sectors))
        fat[-1] = 0xFFFFFFFE
        return first

    for name, data in streams.items():
        data = data.ljust(4096, b"\0")
        entries.append((name, 2, put(data), len(data)))
    raw = b""
    for name, kind, start, size in [("Root Entry", 5, 0xFFFFFFFE, 0), *entries]:
        wide = (name + "\0").encode("utf-16-le")
        raw += wide.ljust(64, b"\0") + struct.pack("<HBB", len(wide), kind, 1) + struct.pack("<III", 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) + bytes(36) + struct.pack("<II", start, size) + bytes(4)
    directory = put(raw)
    table = len(sectors)
    fat += [0xFFFFFFFD]
    sectors.append(struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat))))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", table, *[0xFFFFFFFF] * 108) + b"".join(sectors)


def test_compound_files_and_old_word():
    assert containers.ole_streams(compound({"A": b"x" * 5000, "CONTENTS": b"%PDF-1"}))["A"] == b"x" * 5000
    with pytest.raises(ValueError):
        containers.ole_streams(b"no")
    wide = lambda s: struct.pack("<I", len(s)) + s.encode("utf-16-le")
    record = struct.pack("<IH", 0, 2) + b"a.txt\0C:\\a.txt\0" + struct.pack("<HH", 0, 3) + struct.pack("<I", 2) + b"t\0" + struct.pack("<I", 3) + b"abc" + wide("t") + wide("é.txt") + wide("C:\\é.txt")
    assert containers.attachment(compound({"\x01Ole10Native": record}), "Package", "word/embeddings/o1.bin") == ("é.txt", b"abc")
    assert containers.attachment(compound({"CONTENTS": b"%PDF-1"}), "", "o2.bin")[0] == "o2.pdf" and containers.attachment(compound({"CONTENTS": b"??"}), "Excel.Sheet.8", "o3.bin")[0] == "o3.xls"
    assert containers.attachment(compound({"CONTENTS": b" <HTML>"}), "", "o4.bin")[0] == "o4.html" and containers.attachment(b"plain", "", "x/y.xlsx") == ("y.xlsx", b"plain")
    # Two pieces: one byte a character, then two; a field, a cell mark, a soft break and an empty paragraph.
    one, two = "Tit\x13 HYPERLINK x \x14le\x15\r", "häng\x0bnext\x07cell\r\rend"
    fib = bytearray(2048)
    struct.pack_into("<H", fib, 10, 0x200)
    struct.pack_into("<I", fib, 76, len(one) + len(two))
    fib[1024 : 1024 + len(one)] = one.encode("cp1252")
    fib[1536 : 1536 + 2 * len(two)] = two.encode("utf-16-le")
    plc = struct.pack("<III", 0, len(one), len(one) + len(two)) + struct.pack("<HIH", 0, 0x40000000 | 2048, 0) + struct.pack("<HIH", 0, 1536, 0)
    clx = b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", fib, 0x1A2, 0, len(clx))
    word = compound({"WordDocument": bytes(fib), "1Table": clx})
    assert containers.doc_text(word) == "Title\n\nhäng\nnext\tcell\n\nend"


def test_old_files_in_a_batch(spark, tmp_path):
    (tmp_path / "o.xls").write_bytes(compound({"Workbook": b"x"}))
    (tmp_path / "d.doc").write_bytes(writers.docx("# new inside", add_title=False))
    rows = {r.source[-5:]: r for r in convert_paths(spark, [str(tmp_path)]).collect()}
    assert rows["o.xls"].status == "error" and "external" in rows["o.xls"].message and rows["d.doc"].markdown == "# new inside\n"


def test_silent_elements_are_an_option(spark):
    page = spark.range(1).select(F.lit("<p>a</p><script>x()</script><STYLE>p{}</STYLE>b").alias("h"))
    assert page.select(without_silent(F.col("h")).alias("h")).first().h == "<p>a</p>b"


def test_word_notes_merged_cells_and_linked_files():
    w, r = containers.W[1:-1], containers.R[1:-1]
    cell = lambda text, more="": f"<w:tc><w:tcPr>{more}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    table = f"<w:tbl><w:tr>{cell('a', '<w:vMerge w:val=\"restart\"/>')}{cell('b')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('c')}</w:tr></w:tbl>"
    body = f'<w:p><w:r><w:t>text</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r></w:p>{table}<w:p><w:r><w:object><o:OLEObject r:id="x"/></w:object></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:r="{r}" xmlns:o="{containers.O[1:-1]}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/footnotes.xml", f'<w:footnotes xmlns:w="{w}"><w:footnote w:id="2"><w:p><w:r><w:t>a note</w:t></w:r></w:p></w:footnote></w:footnotes>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="x" TargetMode="External" Target="C:\\d\\f.xls"/></Relationships>')
    html = containers.docx_html(out.getvalue(), attachment_href=lambda n, d: n)[0]
    assert '<p>text<sup><a href="#footnote-2">[1]</a></sup></p>' in html and html.endswith('<ol><li><p>a note</p><p><a href="#footnote-ref-2">↑</a></p></li></ol>')
    assert html.count("<td") == 3 and '<a href="C:\\d\\f.xls">f.xls</a>' in html


def test_pdf_with_packed_objects_and_font_tables():
    """Objects in a stream, two-byte codes with a table, blanks from wide gaps, a scaled matrix, octal escapes."""
    cmap = b"1 beginbfchar <0001> <0110> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    packed = [(1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<</Type /Pages /Kids [3 0 R]>>"), (3, b"<</Type /Page /MediaBox [0 0 300 200] /Contents 6 0 R /Resources 4 0 R>>"), (4, b"<</Font <</F1 5 0 R /F2 8 0 R>>>>"), (5, b"<</Type /Font /Subtype /Type0 /BaseFont /X-BoldMT /ToUnicode 7 0 R>>"), (8, b"<</Type /Font /BaseFont /Y>>")]
    head, body = b"", b""
    for k, text in packed:
        head += b"%d %d " % (k, len(body))
        body += text + b" "
    data = zlib.compress(head + body)
    code = b"BT /F1 1 Tf 12 0 0 12 20 150 Tm [<00010002> -300 <00030004>] TJ ET BT /F2 9 Tf 20 100 Td (a\\(b\\051 \\344) Tj ET"
    out = b"%%PDF-1.5\n9 0 obj <</Type /ObjStm /N 6 /First %d /Filter /FlateDecode>> stream\n" % len(head) + data + b"\nendstream endobj\n"
    out += b"6 0 obj <</Filter /FlateDecode>> stream\n" + zlib.compress(code) + b"\nendstream endobj\n7 0 obj <<>> stream\n" + cmap + b"\nendstream endobj\n"
    assert containers.pdf_lines(out) == [(1, 0, "Đa bc", 12.0, True, 38.0, 50.0), (1, 1, "a(b) ä", 9.0, False, 91.0, 100.0)]


def test_sections(spark, tmp_path):
    md = "lead\n\n# A\n\n## B\n\ntext\n\n### C\n\n## D\n\n## B\n\nmore\n"
    (tmp_path / "d.docx").write_bytes(writers.docx(md, add_title=False))
    run = lambda **o: {r.output or r.status: (r.status, r.markdown) for r in convert_paths(spark, [str(tmp_path)], Options(add_title=False, **o)).collect()}
    assert run(sections=("2.1", "2.1.1")) == {"B.md": ("success", "# B\n\ntext\n\n## C\n")}
    assert run(sections=("2.1",), promote=False) == {"B.md": ("success", "## B\n\ntext\n\n### C\n")}
    split = run(sections=("2.1", "2.3"), split_sections=True)
    assert {k: v[1] for k, v in split.items()} == {"B.md": "# B\n\ntext\n\n## C\n", "B (1).md": "# B\n\nmore\n"}
    assert run(sections=("2.1", "2.3"))["d.md"][1] == "# B\n\ntext\n\n## C\n\n# B\n\nmore\n"
    assert run(sections=("2.1", "9"))["error"][0] == "error"
    assert set(run(sections=("all",), split_sections=True)) == {"d.md", "A.md"}


def test_empty_sheets_are_said_alike(spark):
    cells = [(0, "S", 0, 0, "k", "text"), (0, "S", 1, 0, "v|", "text"), (1, "E", 0, 0, "only", "text")]
    md, warnings = sheets_markdown(cells, sheets=[(0, "S"), (1, "E"), (2, "N")])
    assert md == "## S\n\n| k |\n| --- |\n| v\\| |\n\n## E\n\n> Sheet không có dữ liệu.\n\n## N\n\n> Sheet không có dữ liệu.\n" and len(warnings) == 2
    table = spark.createDataFrame([(1, c[0], c[1], c[2], c[3], c[4]) for c in cells], "doc_id long, sheet_no int, sheet string, row_no int, col_no int, value string")
    sheets = spark.createDataFrame([(1, 0, "S"), (1, 1, "E"), (1, 2, "N")], "doc_id long, sheet_no int, sheet string")
    assert tables.workbook_markdown(table, sheets).first().markdown + "\n" == md
    assert sheets_markdown([])[1] == ["Workbook không có sheet nào."]


def test_unique_names_equal_brute_force(spark):
    """Random names with literal numbers and cases that meet; some taken before; a name that very many files share."""
    random.seed(9)
    stems = ["a", "A", "a (1)", "a (2)", "a (1) (1)", "b", "B (1)", "c.d"]
    files = [(random.choice("fg"), random.choice(stems), ".md", k) for k in range(120)] + [("h", random.choice(["x", "X"]), ".md", k) for k in range(120, 1120)]
    random.shuffle(files)
    taken = [("f", "a.md"), ("f", "B (1).MD"), ("g", "zzz.md")]
    used, want = {(f, n.lower()) for f, n in taken}, {}
    for folder, stem, ext, k in sorted(files, key=lambda r: r[3]):
        name, n = stem + ext, 0
        while (folder, name.lower()) in used:
            n += 1
            name = f"{stem} ({n}){ext}"
        used.add((folder, name.lower()))
        want[k] = name
    rows = spark.createDataFrame(files, "folder string, stem string, ext string, ord long").repartition(4)
    got = outline.unique_names(rows, taken=spark.createDataFrame(taken, "folder string, name string"))
    assert got.columns == ["folder", "stem", "ext", "ord", "unique"] and {r.ord: r.unique for r in got.collect()} == want
    assert outline.unique_names(rows.limit(0)).count() == 0


def plain_page(words):
    """A page of words (text, x0, x1, top, bottom) as lines and tables, in plain Python."""
    middle = lambda w: (w[3] + w[4]) / 2
    rows, at = [], None
    for w in sorted(words, key=lambda w: (middle(w), w[1])):
        if at is None or middle(w) - at[0] > 0.6 * at[1]:
            rows.append([])
            at = middle(w), max(1.0, w[4] - w[3])
        rows[-1].append(w)
    rows = [sorted(r, key=lambda w: w[1]) for r in rows]
    median = lambda r: sorted(max(1.0, w[4] - w[3]) for w in r)[len(r) // 2]
    gaps = [[(a[2], b[1]) for a, b in zip(r, r[1:]) if b[1] - a[2] > 1.2 * median(r)] for r in rows]
    out, k = [], 0
    while k < len(rows):
        end = k
        while end < len(rows) and gaps[end]:
            end += 1
        lanes = []
        if end - k >= 3:
            edges = sorted({x for g in gaps[k:end] for s in g for x in s})
            on = [(a, b) for a, b in zip(edges, edges[1:]) if sum(any(x <= (a + b) / 2 <= y for x, y in g) for g in gaps[k:end]) >= max(2, round((end - k) * 0.6))]
            for a, b in on:
                if lanes and lanes[-1][1] == a:
                    lanes[-1][1] = b
                else:
                    lanes.append([a, b])
        if lanes:
            cuts = [(a + b) / 2 for a, b in lanes]
            cells = [[" ".join(w[0] for w in r if sum(c <= (w[1] + w[2]) / 2 for c in cuts) == n) for n in range(len(cuts) + 1)] for r in rows[k:end]]
            folded = []
            for r in cells:
                if folded and not r[0] and any(r):
                    folded[-1] = [f"{a}\n{b}".strip("\n") if b else a for a, b in zip(folded[-1], r)]
                else:
                    folded.append(r)
            out.append(("table", folded))
        end = end if lanes else max(end, k + 1)
        if not lanes:
            out += [("line", " ".join(w[0] for w in r), median(r)) for r in rows[k:end]]
        k = end
    return out


def test_scanned_pages_equal_plain_python(spark):
    """Prose, tables with wrapped cells, and rows whose gaps no lane shares."""
    random.seed(12)
    pages = []
    for p in range(40):
        words, y = [], 10.0
        for block in range(5):
            table, cols = random.random() < 0.5, random.sample([20.0, 140.0, 260.0, 380.0], random.randrange(2, 4))
            for row in range(random.randrange(2, 6)):
                if table:
                    for c in sorted(cols)[(1 if row and random.random() < 0.3 else 0) :]:
                        words.append((f"t{block}{row}", c + random.random(), c + 40, y + random.random(), y + 10))
                else:
                    x = 20.0
                    for k in range(random.randrange(1, 6)):
                        words.append((f"w{k}", x, x + 30, y + random.random(), y + 10 + random.random()))
                        x += 30 + random.choice([3, 4, 4, 40])
                y += 16
        pages.append(words)
    rows = [(p, 1, k, *w) for p, words in enumerate(pages) for k, w in enumerate(words)]
    frame = spark.createDataFrame(rows, "doc_id int, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    lines, tabs = layout.read_items(frame)
    got_lines, got_tables = {}, {}
    for r in lines.orderBy("doc_id", "seq").collect():
        got_lines.setdefault(r.doc_id, []).append((r.text, round(r.size, 9)))
    for r in tabs.orderBy("doc_id", "top").collect():
        got_tables.setdefault(r.doc_id, []).append([list(x) for x in r.rows])
    assert sum(map(len, got_tables.values())) > 10
    for p, words in enumerate(pages):
        want = plain_page(words)
        assert got_lines.get(p, []) == [(x[1], round(x[2], 9)) for x in want if x[0] == "line"]
        assert got_tables.get(p, []) == [x[1] for x in want if x[0] == "table"]
    assert layout.read_markdown(frame).count() == 40


def test_refined_words(spark):
    words = spark.createDataFrame([(1, 1, 0, "2.", 10.0, 18.0, 0.0, 10.0), (1, 1, 1, "abc", 22.0, 40.0, 0.0, 10.0), (1, 1, 2, "x", 100.0, 101.0, 4.0, 5.0)], "doc_id int, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    crops = layout.crops(layout.printed_rows(words), 1.0)
    assert [(r.crop, r.left, r.right, len(r.words)) for r in crops.orderBy("crop").collect()] == [(0, 7, 43, 2), (1, 97, 104, 1)]
    read = layout.respell(crops.withColumn("reading", F.when(F.col("crop") == 0, "2.Mở đầu").otherwise(F.lit(None))))
    assert [(r.text, r.x0, r.x1) for r in read.orderBy("crop", "place").collect()] == [("2. Mở đầu", 10.0, 40.0), ("x", 100.0, 101.0)]


def test_refine_keeps_words_without_a_reading(spark):
    words = spark.createDataFrame([(1, 1, 0, "ab", 10.0, 30.0, 0.0, 10.0), (1, 1, 1, "cd", 33.0, 50.0, 0.0, 10.0), (1, 1, 2, "ef", 10.0, 30.0, 20.0, 30.0)], "doc_id int, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    readings = spark.createDataFrame([(1, 1, 0, 0, "áb cđ")], "doc_id int, page_no int, row_no int, crop int, reading string")
    assert [(r.word_no, r.text, r.x0) for r in layout.refine(words, readings).orderBy("word_no").collect()] == [(0, "áb", 10.0), (1, "cđ", 33.0), (2, "ef", 10.0)]


def test_assets_move_with_sections(spark):
    text = "![a](d_images/a%20b.png) [n](d_images/none.png) [u](http://x/y) ![a](d_images/a%20b.png)"
    sections = spark.createDataFrame([(1, "Sec", text)], "doc_id long, stem string, text string")
    assets = spark.createDataFrame([(1, "d_images", "a b.png", "_images")], "doc_id long, folder string, name string, suffix string")
    done, used = outline.relocate_assets(sections, assets)
    assert done.first().text == text.replace("d_images/a%20b", "Sec_images/a%20b") and [tuple(r) for r in used.collect()] == [(1, "Sec", "d_images", "a b.png", "Sec_images")]


def test_names_in_sql(spark):
    sql.register(spark)
    book = writers.xlsx([("S", [{"row_no": 1, "col_no": 0, "value": "v", "kind": "table"}])])
    spark.createDataFrame([("# a\n\nb", "<p>x</p>", bytearray(book), bytearray(writers.docx("# h", add_title=False)))], "md string, html string, book binary, word binary").createOrReplaceTempView("files_")
    assert [r.kind for r in spark.sql("SELECT b.kind FROM files_, LATERAL md_blocks(md) b").collect()] == ["heading", "paragraph"]
    assert [tuple(r) for r in spark.sql("SELECT c.sheet, c.value FROM files_, LATERAL xlsx_cells(book) c").collect()] == [("S", "v")]
    assert spark.sql("SELECT p.text FROM files_, LATERAL docx_parts(word) p").first().text.startswith("<h1>")
    assert [tuple(r) for r in spark.sql("SELECT n.kind, n.text FROM files_, LATERAL html_nodes(html) n").collect()] == [("paragraph", "x")]
    assert spark.sql("SELECT html_to_md(html) AS m, doc_text(NULL) AS t FROM files_").first().m == "x\n"


def test_watch_names_do_not_clash(spark, tmp_path):
    from papyrine.streaming.watch import watch

    for turn in ("one", "two"):
        (tmp_path / "in" / turn).mkdir(parents=True)
        (tmp_path / "in" / turn / "n.md").write_text("# " + turn)
        watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert sorted(r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["n (1).docx", "n.docx"]


@pytest.mark.parametrize("text,want", [
    ("[![a](b)](c)", [("image", "a", "c", "b")]), ("***x**", [("text", "*x", None, None)]), ("``a`b``", [("text", "a`b", None, None)]), ("a_b_ _c", [("text", "a_b_ _c", None, None)]),
    ("<b>t</b>", [("text", "t", None, None)]), ("[](u)", [("text", "u", "u", None)]), ("a\\", [("text", "a\\", None, None)]), ("![x", [("text", "![x", None, None)]),
])
def test_inline_corners(text, want):
    assert [(s["kind"], s["text"], s["href"], s["src"]) for s in markdown.inline(text)] == want


def test_block_corners():
    kinds = lambda t: [(b["kind"], b.get("text")) for b in markdown.parse(t)[0]]
    assert kinds("#a\n####### b") == [("paragraph", "#a ####### b")] and kinds("a\n    b") == [("paragraph", "a b")]
    assert kinds("```\nx") == [("code", "x")] and kinds("|a|\n|-|") == [("table", None)] and kinds("- - -") == [("rule", None)] and kinds("-x") == [("paragraph", "-x")]
    assert markdown.parse("﻿---\nA b: 'c'\n1x: d\n...\nt") == ([{"kind": "paragraph", "text": "t"}], {"a b": "c"})
    assert re.match("x", "x") and [i["checked"] for i in markdown.parse("- [ ] a\n- [X] b\n- [] c")[0][0]["items"]] == [False, True, None]
