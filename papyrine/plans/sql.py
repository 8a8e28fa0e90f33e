"""Functions and table functions under names for spark.sql: ``SELECT ... FROM t, LATERAL md_blocks(t.text)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from papyrine.operators import markdown
from papyrine.operators.html import html_to_md
from papyrine.operators.markdown import md_inline
from papyrine.sources import containers


class MdBlocks:
    def eval(self, text: str):
        for b in markdown.flatten(markdown.parse(text)[0]):
            yield b["block_id"], b["parent_id"], b["seq"], b["depth"], b["kind"], b.get("level"), b.get("text"), b.get("language"), b.get("ordered"), b.get("start"), b.get("checked"), b.get("header"), b.get("rows"), b.get("alignments")


class XlsxCells:
    def eval(self, content: bytes):
        if content is not None:
            yield from containers.xlsx_cells(bytes(content))


class DocxParts:
    """The body as HTML in the first row; then what could not be taken over, a row each."""

    def eval(self, content: bytes):
        if content is not None:
            body, warnings, _ = containers.docx_html(bytes(content))
            yield "html", body
            yield from (("warning", w) for w in warnings)


class HtmlNodes:
    """Blocks of a page's Markdown: what the elements of a page come to, in order."""

    def eval(self, page: str):
        from papyrine.operators.html import to_markdown

        for b in markdown.flatten(markdown.parse(to_markdown(page))[0]):
            yield b["block_id"], b["parent_id"], b["kind"], b.get("level"), b.get("text")


def register(spark: SparkSession) -> None:
    spark.udf.register("html_to_md", html_to_md)
    spark.udf.register("md_inline", md_inline)
    spark.udf.register("doc_text", lambda content: None if content is None else containers.doc_text(bytes(content)), "string")
    spark.udf.register("ole_attachment", lambda content: None if content is None else containers.ole10_native(bytes(content)), "struct<name:string,content:binary>")
    blocks = markdown.BLOCK_SCHEMA.removeprefix("doc_id long, ")
    for name, table, shape in (
        ("md_blocks", MdBlocks, blocks), ("xlsx_cells", XlsxCells, "sheet_no int, sheet string, row_no int, col_no int, value string, vtype string"),
        ("docx_parts", DocxParts, "kind string, text string"), ("html_nodes", HtmlNodes, "block_id int, parent_id int, kind string, level int, text string"),
    ):
        spark.udtf.register(name, F.udtf(table, returnType=shape))
