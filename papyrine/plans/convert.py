"""The conversion plan: files in, one result row a file out. Errors are rows, never exceptions."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from papyrine.functions import text as tx
from papyrine.operators import html, layout, markdown, outline
from papyrine.operators.outline import unique_names
from papyrine.sources import containers, writers
from papyrine.sources.files import listing, with_content
from papyrine.sources.scratch import written

RESULT = "source string, status string, output string, message string, warnings array<string>, duration double, markdown string, content binary, assets array<struct<kind: string, name: string, content: binary>>"
STATUSES = ("success", "error", "skipped", "cancelled")
# Messages for what needs an external program.
NO_OFFICE = "old Office files need an external converter, which is not available"
NO_TEXT = "the file holds no text; scanned pages need an external recogniser"
NO_PRINTER = "PDF output needs an external print engine, which is not available"
# What stands in place of an empty sheet, and the warnings about it.
EMPTY_SHEET, SHEET_IS_EMPTY, NO_SHEETS = "> Sheet không có dữ liệu.", "Sheet '{}' trống.", "Workbook không có sheet nào."


@dataclass(frozen=True)
class Options:
    """Baked into the plan as constants."""

    add_title: bool = True
    extract_images: bool = True
    extract_attachments: bool = True
    target: str = ".docx"
    font: str | None = None
    points: float | None = None
    toc: bool = False
    page_break_h1: bool = False
    overwrite: bool = False
    page_size: str = "A4"
    line_spacing: float | None = None
    sheet_level: int = 2
    sections: tuple[str, ...] | None = None  # ids of an outline, or ("all",) for its roots
    split_sections: bool = False
    promote: bool = True


class Assets:
    """Files that go beside an output: pictures by number, attachments once for each content, under free names."""

    def __init__(self, stem: str) -> None:
        self.stem, self.rows = stem, []
        self._by_digest: dict[bytes, str] = {}
        self._taken: set[str] = set()

    def _add(self, kind: str, name: str, data: bytes) -> str:
        path = f"{self.stem}_{kind}s/{name}"
        self.rows.append((kind, path, data))
        return quote(path)

    def image(self, n: int, part: str, data: bytes) -> str:
        dot = part.rpartition(".")[2].lower() if "." in part else "png"
        return self._add("image", f"image{n}.{ {'jpeg': 'jpg', 'jpe': 'jpg'}.get(dot, dot) }", data)

    def attachment(self, name: str, data: bytes) -> str:
        digest = hashlib.sha1(data).digest()
        if digest not in self._by_digest:
            name = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", name).strip(" .")[:120] or "attachment"
            stem, dot, ext = name.rpartition(".")
            stem, ext = (stem, dot + ext) if stem else (name, "")
            free = next(x for x in chain([name], (f"{stem} ({k}){ext}" for k in count(1))) if x.lower() not in self._taken)
            self._taken.add(free.lower())
            self._by_digest[digest] = self._add("attachment", free, data)
        return self._by_digest[digest]


def sheets_markdown(cells: list[tuple], level: int = 2, sheets: list[tuple[int, str]] | None = None) -> tuple[str, list[str]]:
    """Sheets as headings and tables: without rows and columns that are empty, headers cleaned. For the cells of one
    file at hand; says the same as the native ``tables.workbook_markdown``."""
    out, warnings, books = [], [], {}
    mark = "#" * max(1, min(6, level))
    for no, sheet in sheets or []:
        books[no, sheet] = {}
    for no, sheet, row, col, value, _ in cells:
        books.setdefault((no, sheet), {}).setdefault(row, {})[col] = value
    for (_, sheet), rows in sorted(books.items()):
        body = {r: c for r, c in rows.items() if r > 0 and any(v is not None for v in c.values())}
        cols = sorted({k for c in body.values() for k, v in c.items() if v is not None})
        if not cols:
            warnings.append(SHEET_IS_EMPTY.format(sheet))
            out.append(f"{mark} {sheet}\n\n{EMPTY_SHEET}")
            continue
        clean = lambda v: (v or "").strip().replace("|", "\\|").replace("\r\n", "<br>").replace("\n", "<br>")
        head = [(rows.get(0, {}).get(k) or "").strip() or f"Cột {i}" for i, k in enumerate(cols, 1)]
        lines = ["| " + " | ".join(x) + " |" for x in [head, ["---"] * len(cols), *([clean(c.get(k)) for k in cols] for _, c in sorted(body.items()))]]
        out.append(f"{mark} {sheet}\n\n" + "\n".join(lines))
    return "\n\n".join(out) + "\n", warnings if books else [*warnings, NO_SHEETS]


def convert_one(name: str, suffix: str, container: str, content: bytes, o: Options, output: str | None = None, pictures: dict[str, bytes] | None = None) -> tuple[str, str, str, list[str], str | None, bytes | None, list[tuple[str, str, bytes]]]:
    """(status, output, message, warnings, markdown, bytes, assets) of one file; ``output`` is a name without suffix."""
    stem = name.rsplit(".", 1)[0]
    output = output or stem
    assets = Assets(output)
    try:
        if suffix in tx.MARKDOWN:
            text = content.decode("utf-8-sig", "replace")
            finder = (pictures or {}).get if o.extract_images else None
            if o.target == ".pdf":
                raise ValueError(NO_PRINTER)
            if o.target == ".xlsx":
                data, warnings = workbook(text, stem if o.add_title else "Sheet1", finder)
                return "success", output + ".xlsx", "", warnings, None, data, []
            notes: list[str] = []
            data = writers.docx(text, stem, o.font, o.points, o.toc, o.page_break_h1, o.add_title, o.page_size, o.line_spacing, finder, notes)
            return "success", output + ".docx", "", notes, None, data, []
        warnings: list[str] = []
        if suffix in tx.WORD:
            if container == "zip":
                body, warnings, _ = containers.docx_html(content, assets.image if o.extract_images else None, assets.attachment if o.extract_attachments else None)
                said = html.to_markdown(body)
            elif container == "ole":
                said = containers.doc_text(content) + "\n"
            else:
                raise ValueError("the file is damaged or no Word document")
        elif suffix in tx.EXCEL:
            if container != "zip":
                raise ValueError(NO_OFFICE)
            said, warnings = sheets_markdown(containers.xlsx_cells(content), o.sheet_level, containers.xlsx_sheets(content))
        else:
            return "skipped", "", f"files of the kind {suffix or '(unknown)'} are left out", [], None, None, []
        if o.add_title and not said.lstrip().startswith("# "):
            said = f"# {stem}\n\n{said}"
        return "success", output + ".md", "", warnings, said, None, assets.rows
    except Exception as e:  # one bad file is a row, not the end of the batch
        return "error", "", f"{type(e).__name__}: {e}", [], None, None, []


def workbook(text: str, fallback: str, finder=None) -> tuple[bytes, list[str]]:
    """(.xlsx, warnings) of a Markdown text: a sheet for each section, named by its heading, names unique."""
    blocks, meta = markdown.parse(text)
    warnings = [f"a workbook has no place for front matter ({len(meta)} keys)"] if meta else []
    sheets, taken = [], set()
    parts = markdown.sections(blocks)
    if not parts:
        warnings.append("the document is empty; so is the only sheet")
    for title, part in parts or [(None, [])]:
        cells = markdown.block_cells(part)
        warnings += [c["warning"] for c in cells if c["warning"]]
        sheets.append((markdown.sheet_name(title or fallback, taken), cells))
    return writers.xlsx(sheets, finder, warnings), warnings


def output_names(files: DataFrame, options: Options, taken: DataFrame | None = None) -> DataFrame:
    """files plus ``output``: the name each result gets, without suffix; clashes within a batch, and with ``taken``
    (folder, name) unless results overwrite, get numbers."""
    md = F.col("suffix").isin(*tx.MARKDOWN)
    ext = F.when(md, F.lit(options.target)).otherwise(F.lit(".md"))
    keyed = files.filter("problem is null").withColumn("ext", ext).withColumn("folder", F.lit("")).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    keyed = keyed.withColumn("ord", F.struct(F.lower("path").alias("l"), "path"))
    if options.overwrite:
        return files.withColumn("output", F.when(F.col("problem").isNull(), F.regexp_replace("name", r"\.[^.]*$", "")))
    names = unique_names(keyed.select("folder", "stem", "ext", "path", "ord"), taken=taken).select("path", F.expr("substring(unique, 1, length(unique) - length(ext))").alias("output"))
    return files.join(names, "path", "left")


def convert(files: DataFrame, options: Options = Options()) -> DataFrame:
    """RESULT rows for files as discover() gives them; with a column ``output`` (see output_names), results are named so,
    with ``pictures`` (map of path to bytes), documents made from Markdown show them."""
    none = F.lit(None).cast("string")
    if "output" not in files.columns:
        files = files.withColumn("output", none)
    if "problem" not in files.columns:
        files = files.withColumn("problem", none)
    if "pictures" not in files.columns:
        files = files.withColumn("pictures", F.lit(None).cast("map<string,binary>"))
    pdf = F.col("suffix").isin(*tx.PDF) & F.col("problem").isNull()
    return _convert_each(files.filter(~F.coalesce(pdf, F.lit(False))), options).unionByName(_convert_pdf(files.filter(pdf), options))


def _batches(frames: Iterator[pa.RecordBatch], size: int = 32 << 20) -> Iterator[list[dict]]:
    """Rows of a few files, about ``size`` bytes each time."""
    for b in frames:
        n = max(1, int(size * b.num_rows / max(1, b.nbytes)))
        for k in range(0, b.num_rows, n):
            yield b.slice(k, n).to_pylist()


def _convert_each(files: DataFrame, options: Options) -> DataFrame:
    shape = to_arrow_schema(StructType.fromDDL(RESULT))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(frames):
            out = []
            for r in rows:
                began = time.monotonic()
                if r["problem"] == "missing":
                    status, output, message, warnings, said, data, assets = "error", "", "the file was not found", [], None, None, []
                else:
                    status, output, message, warnings, said, data, assets = convert_one(r["name"], r["suffix"], r["container"], bytes(r["content"] or b""), options, r["output"], dict(r["pictures"] or []))
                out.append((r["path"], status, output, message, warnings, time.monotonic() - began, said, data, [{"kind": k, "name": n, "content": c} for k, n, c in assets]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(shape)], schema=shape)

    return files.select("path", "name", "suffix", F.col("kind.container").alias("container"), "output", "problem", "pictures", "content").mapInArrow(run, RESULT)


PDF_ROWS = "source string, stem string, page_no int, seq int, kind string, text string, size double, bold boolean, top double, bottom double, content binary"


def _convert_pdf(files: DataFrame, options: Options) -> DataFrame:
    """PDF files by the layout operators: lines and pictures as rows, then headings, lists and paragraphs from their places."""
    shape = to_arrow_schema(StructType.fromDDL(PDF_ROWS))

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(frames):
            out = []
            for r in rows:
                stem, content = r["output"] or r["name"].rsplit(".", 1)[0], bytes(r["content"] or b"")
                try:
                    found = [(page, seq, "line", *rest, None) for page, seq, *rest in containers.pdf_lines(content)]
                    if options.extract_images:
                        for n, (page, suffix, data) in enumerate(containers.pdf_images(content), 1):
                            found.append((page, 1_000_000 + n, "picture", f"{stem}_images/image{n}.{suffix}", None, None, 1e9, 1e9, data))
                    warned = None if content.startswith(b"%PDF-") else "the file doesn't look like a PDF"
                    found.append((None, None, "read", warned, None, None, None, None, None))
                except Exception as e:  # one bad file is a row, not the end of the batch
                    found = [(None, None, "error", f"{type(e).__name__}: {e}", None, None, None, None, None)]
                out += [(r["path"], stem, *x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(shape)], schema=shape)

    rows = written(files.select("path", "name", "output", "content").mapInArrow(read, PDF_ROWS), "pdf")
    cols = ["doc_id", "page_no", "seq", "text", "top", "bottom"]
    lines = layout.classify(rows.filter("kind = 'line'").withColumnRenamed("source", "doc_id")).select(*cols, "kind", "level")
    link = F.concat(F.lit("![]("), tx.quote_path(F.col("text")), F.lit(")"))
    pictures = rows.filter("kind = 'picture'").select(F.col("source").alias("doc_id"), "page_no", "seq", link.alias("text"), "top", "bottom", F.lit("picture").alias("kind"), F.lit(None).cast("int").alias("level"))
    said = layout.render(lines.unionByName(pictures)).select(F.col("doc_id").alias("source"), "markdown")
    assets = rows.filter("kind = 'picture'").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("text").alias("name"), "content"))).alias("a"))
    whole = rows.filter("kind IN ('read', 'error')").join(said, "source", "left").join(assets, "source", "left")
    text = F.concat("markdown", F.lit("\n"))
    text = tx.add_title(text, F.col("stem")) if options.add_title else text
    failed = (F.col("kind") == "error") | F.col("markdown").isNull()
    empty = "array()"
    return whole.select(
        "source", F.when(failed, "error").otherwise("success").alias("status"), F.when(failed, "").otherwise(F.concat("stem", F.lit(".md"))).alias("output"),
        F.when(F.col("kind") == "error", F.col("text")).when(failed, NO_TEXT).otherwise("").alias("message"),
        F.when(failed | F.col("text").isNull(), F.expr(empty).cast("array<string>")).otherwise(F.array("text")).alias("warnings"), F.lit(0.0).alias("duration"),
        F.when(~failed, text).alias("markdown"), F.lit(None).cast("binary").alias("content"),
        F.coalesce(F.transform("a", lambda x: F.struct(F.lit("image").alias("kind"), x["name"].alias("name"), x["content"].alias("content"))), F.expr(empty).cast("array<struct<kind:string,name:string,content:binary>>")).alias("assets"),
    )


def with_pictures(spark: SparkSession, files: DataFrame, paths: list[str]) -> DataFrame:
    """files with ``pictures``: for each Markdown file the bytes of those that its links name, from below ``paths``."""
    md = files.filter(F.col("suffix").isin(*tx.MARKDOWN) & F.col("content").isNotNull())
    src = F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r"!\[[^\]]*\]\(\s*<?([^)\s>]+)"), F.lit(1))
    named = md.select(F.col("path").alias("md"), F.explode(F.array_distinct(src)).alias("src")).filter(~tx.is_remote(F.col("src"))).withColumn("src", F.url_decode(F.replace("src", F.lit("+"), F.lit("%2B"))))
    named = named.withColumn("at", F.concat(F.regexp_extract("md", r"\A(.*/)", 1), F.regexp_replace("src", r"\A\./", "")))
    hadoop = spark._jsc.hadoopConfiguration()
    folders = [p for p in paths if (w := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(hadoop).exists(w)]
    if not folders:
        return files.withColumn("pictures", F.lit(None).cast("map<string,binary>"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).select(F.col("path").alias("at"), F.col("content").alias("bytes")).filter(F.lower("at").rlike(r"\.(png|jpe?g|gif|bmp)\z"))
    found = read.join(named, "at").groupBy("md").agg(F.map_from_entries(F.collect_list(F.struct("src", "bytes"))).alias("pictures"))
    return files.join(found, files["path"] == found["md"], "left").drop("md")


def extract_results(results: DataFrame, options: Options) -> DataFrame:
    """Results of the sections that ``options`` name, of each document converted to Markdown: one file for all of them, or
    one each. Unknown ids make an error row, sections without text a skipped one."""
    docs = written(results.filter("status = 'success' AND markdown IS NOT NULL").select(F.col("source").alias("doc_id"), "markdown", F.regexp_replace("output", r"\.md\z", "").alias("stem")), "docs")
    tree = written(outline.nodes(docs), "outline")
    wanted = options.sections or ()
    spark = results.sparkSession
    if wanted == ("all",):
        asked = tree.filter("parent_id is null").select("doc_id", "node_id")
    else:
        asked = docs.select("doc_id").join(spark.createDataFrame([(w,) for w in wanted], "node_id string"))
    missing = outline.unknown(asked, tree).groupBy("doc_id").agg(F.concat(F.lit("no such sections: "), F.array_join(F.array_sort(F.collect_list("node_id")), ", ")).alias("message"))
    good = asked.join(missing, "doc_id", "left_anti")
    chosen = tree.join(outline.cover(good, tree), ["doc_id", "node_id"], "left_semi")
    if options.split_sections:
        parts = outline.split_sections(docs, good, tree, options.promote)
        stems = outline.section_stems(chosen, docs.select("doc_id", "stem"), True)
    else:
        parts = outline.extract(docs, good, tree, options.promote).withColumn("node_id", F.lit("all")).join(docs.select("doc_id", F.col("stem").alias("title")), "doc_id")
        stems = outline.section_stems(chosen, docs.select("doc_id", "stem")).groupBy("doc_id").agg(F.min("stem").alias("stem")).withColumn("node_id", F.lit("all"))
    done = outline.section_results(parts, options.add_title).join(stems, ["doc_id", "node_id"])
    names = unique_names(done.select(F.lit("").alias("folder"), "stem", F.lit(".md").alias("ext"), F.concat("doc_id", F.lit(" "), "node_id").alias("ord")))
    done = done.withColumn("ord", F.concat("doc_id", F.lit(" "), "node_id")).join(names.select("ord", "unique"), "ord")
    shape = StructType.fromDDL(RESULT)
    good_rows = done.select(F.col("doc_id").alias("source"), "status", F.when(F.col("status") == "success", F.col("unique")).otherwise("").alias("output"), F.when(F.col("status") == "skipped", "the section is empty").otherwise("").alias("message"), F.col("text").alias("markdown"))
    bad = missing.select(F.col("doc_id").alias("source"), F.lit("error").alias("status"), F.lit("").alias("output"), "message", F.lit(None).cast("string").alias("markdown"))
    every = good_rows.unionByName(bad)
    return every.select(*[F.col(f.name) if f.name in every.columns else (F.expr("array()").cast(f.dataType) if f.name in ("warnings", "assets") else F.lit(0.0) if f.name == "duration" else F.lit(None).cast(f.dataType)).alias(f.name) for f in shape])


def convert_paths(spark: SparkSession, paths: list[str], options: Options = Options(), recursive: bool = True) -> DataFrame:
    """Results of the files below ``paths``: named first, by the listing alone, and read last."""
    named = written(output_names(listing(spark, paths, recursive), options), "files")
    full = with_content(spark, named, paths, recursive)
    if options.extract_images:
        full = with_pictures(spark, full, paths)
    results = convert(full, options)
    return extract_results(results, options) if options.sections else results


def in_input_order(results: DataFrame) -> DataFrame:
    """Results in the order of their files: by lower-cased path."""
    return results.orderBy(F.lower("source"), "output")


def typed_error(message: Column) -> Column:
    """What kind of error a file's message tells of: protected, missing, external (needs a program that is not here) or damaged."""
    low = F.lower(message)
    return F.when(low.rlike("password|encrypt"), "protected").when(low.contains("not found"), "missing").when(low.rlike("external|not available"), "external").when(low != "", "damaged")


def summary(results: DataFrame) -> DataFrame:
    """One row with a count for each status, 0 where there are none."""
    return results.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES])
