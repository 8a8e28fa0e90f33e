"""Small literal inputs with exact outputs, round trips, and errors that become rows."""

import pytest
from pyspark.sql import functions as F

from papyrine.functions import text as tx
from papyrine.operators import html, markdown, outline
from papyrine.plans.convert import Options, convert_one, convert_paths, summary
from papyrine.sources import containers, writers

SAMPLE = "# T\n\npara **b** [l](http://x.y)\n\n- a\n  - b\n- c\n\n1. x\n2. y\n\n| a | b |\n| --- | --- |\n| 1 | p\\|q |\n\n> quote\n\n```\ncode\n```\n"


def test_html_rules():
    assert html.to_markdown("<p>a <b>b </b>c<br>d</p>") == "a **b** c  \nd\n"
    assert html.to_markdown("<ol><li>x</li><li></li><li>y</li></ol>") == "1. x\n3. y\n"
    assert html.to_markdown("<table><tr><td>a|b</td></tr><tr><td>1</td><td>2</td></tr></table>") == "| a\\|b |   |\n| --- | --- |\n| 1 | 2 |\n"
    assert html.to_markdown("") == "" == html.to_markdown(None)
    assert "track" in html.to_markdown("<script>track</script>")


def test_docx_round_trip():
    assert html.to_markdown(containers.docx_html(writers.docx(SAMPLE))[0]) == SAMPLE


def test_xlsx_round_trip():
    cells = containers.xlsx_cells(writers.xlsx([("S", [{"row_no": 1, "col_no": c, "value": v, "kind": "table"} for c, v in enumerate(["007", "12", "3.5", "=x"])])]))
    assert [(c[4], c[5]) for c in cells] == [("007", "text"), ("12", "number"), ("3.5", "number"), ("=x", "text")]


def test_outline_ids_and_fences(spark):
    md = "intro\n# A\n## B\n### C\n```\n# no\n~~~\n```\n## D\n# E\n"
    rows = outline.nodes(spark.createDataFrame([(1, md), (2, ""), (3, None)], "doc_id long, markdown string")).orderBy("start").collect()
    assert [(r.node_id, r.level, r.start, r.end) for r in rows] == [("1", 0, 0, 1), ("2", 1, 1, 9), ("2.1", 2, 2, 8), ("2.1.1", 3, 3, 8), ("2.2", 2, 8, 9), ("3", 1, 9, 11)]


def test_outline_promotion(spark):
    docs = spark.createDataFrame([(1, "# A\n## B\ntext\n### C\n")], "doc_id long, markdown string")
    got = outline.extract(docs, spark.createDataFrame([(1, "1.1"), (1, "1.1.1"), (1, "9")], "doc_id long, node_id string")).collect()
    assert [r.text for r in got] == ["# B\ntext\n## C"]


def test_unique_names_fill_gaps(spark):
    rows = spark.createDataFrame([("f", "A", ".md", 1), ("f", "a", ".md", 2), ("f", "a (1)", ".md", 3), ("f", "A", ".md", 4)], "folder string, stem string, ext string, ord long")
    assert [r.unique for r in outline.unique_names(rows).orderBy("ord").collect()] == ["A.md", "a (1).md", "a (1) (1).md", "A (2).md"]


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(tx.slug(F.lit('  a<b>: "c"?. '))) == "ab c"
    assert value(tx.slug(F.lit("???"))) == "section"
    assert value(tx.quote_path(F.lit("a b/ü~*"))) == "a%20b/%C3%BC~%2A"
    assert value(tx.split_row(F.lit(r"| a | x\|y |  |"))) == ["a", "x|y", ""]
    assert value(tx.wrap(F.lit(" a "), "**")) == " **a** "
    assert value(tx.pick_language(F.array(F.lit("eng"), F.lit("vie")))) == "vie+eng"
    assert value(tx.pick_language(F.array(F.lit("en-US"), F.lit("vi-VN")))) == "vi-VN"
    assert value(tx.checksum(F.lit("A" * 64 + "  file"))) == "a" * 64
    assert value(tx.strip_field_codes(F.lit("a\x13 HYPER \x14b\x15c"))) == "abc"
    assert value(tx.longest_prefix(F.lit("Word.Document.12"), {"Word.Document": ".docx"})) == ".docx"
    assert value(tx.link_target(F.lit('<a b> "t"'))) == "a b"


def test_markdown_cells():
    cells = markdown.block_cells(markdown.parse("# H\n\n- [x] done\n\n" + "x" * 40000)[0])
    assert cells[1]["value"] == "[x] done" and len(cells[2]["value"]) == 32767 and cells[2]["warning"]


def test_ole_record():
    import struct

    wide = lambda s: struct.pack("<I", len(s)) + s.encode("utf-16-le")
    record = struct.pack("<IH", 0, 2) + b"a.txt\0C:\\a.txt\0" + struct.pack("<HH", 0, 3) + struct.pack("<I", 2) + b"t\0" + struct.pack("<I", 3) + b"abc" + wide("t") + wide("é.txt") + wide("C:\\é.txt")
    assert containers.ole10_native(record) == ("é.txt", b"abc")
    with pytest.raises(ValueError):
        containers.ole10_native(record[:20])


def test_batch_goes_on(spark, tmp_path):
    (tmp_path / "good.docx").write_bytes(writers.docx(SAMPLE))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "note.md").write_text(SAMPLE)
    (tmp_path / "skip.txt").write_text("x")
    (tmp_path / "~$lock.docx").write_bytes(b"")
    rows = convert_paths(spark, [str(tmp_path)]).cache()
    assert summary(rows).first().asDict() == {"success": 2, "error": 1, "skipped": 0, "cancelled": 0}
    assert rows.filter("output = 'good.md'").first().markdown == SAMPLE
    assert convert_one("x.md", ".md", "unknown", b"a", Options(target=".pdf"))[0] == "error"


def picture_docx(data: bytes) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    w, r = containers.W[1:-1], containers.R[1:-1]
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:r="{r}" xmlns:a="{containers.A[1:-1]}"><w:body><w:p><w:r><w:t>see</w:t></w:r><w:r><w:drawing><a:blip r:embed="i"/></w:drawing></w:r></w:p></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="i" Target="media/p.JPEG"/></Relationships>')
        z.writestr("word/media/p.JPEG", data)
    return out.getvalue()


def test_assets_and_clashing_outputs(spark, tmp_path):
    from papyrine.sources.files import write_results

    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "a b.docx").write_bytes(picture_docx(b"one"))
    (tmp_path / "in" / "x" / "a b.docx").write_bytes(picture_docx(b"two"))
    write_results(convert_paths(spark, [str(tmp_path / "in")]), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a b.md").read_text() == "# a b\n\nsee![](a%20b_images/image1.jpg)\n"
    assert {p.read_bytes() for p in (tmp_path / "out").rglob("*.jpg")} == {b"one", b"two"}
    assert sorted(p.name for p in (tmp_path / "out").glob("*.md")) == ["a b (1).md", "a b.md"]


def test_sheets_of_a_text():
    md = "# Only\n\nlead\n\n## A/b\n\ntext\n\n## Empty\n\n## a?B\n\n| x |\n| --- |\n| 1 |\n"
    data = convert_one("d.md", ".md", "unknown", md.encode(), Options(target=".xlsx"))[5]
    assert [(c[1], c[4]) for c in containers.xlsx_cells(data)] == [("Only", "lead"), ("Ab", "text"), ("aB (2)", "x"), ("aB (2)", "1")]


def test_stream_watch(spark, tmp_path):
    from papyrine.streaming.watch import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "n.md").write_text(SAMPLE)
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).filter("status = 'success'").count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 100
    assert set(e.oracle_sql()) <= set(e.queries())
