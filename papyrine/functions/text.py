"""Scalar functions on text as Column expressions; no Python runs for a row.

Blanks are spelled out: Java's \\s is ASCII only, and trim() strips spaces only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x1c-\x1f\x85\xa0  -     　]"
CONTROL = r"[\x00-\x1f]"

# File suffixes by kind of input, by media type, by program and by the first bytes (in hexadecimal).
WORD, EXCEL, PDF, MARKDOWN = (".docx", ".doc"), (".xlsx", ".xlsm", ".xls"), (".pdf",), (".md", ".markdown")
SUPPORTED = WORD + EXCEL + PDF + MARKDOWN
MIME = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tif", "image/svg+xml": ".svg", "image/webp": ".webp", "image/x-emf": ".emf", "image/emf": ".emf", "image/x-wmf": ".wmf", "image/wmf": ".wmf"}
PROGRAMS = {"acroexch.document": ".pdf", "word.document": ".doc", "word.openxmldocument": ".docx", "excel.sheet": ".xls", "powerpoint.show": ".ppt"}
SIGNATURES = {"255044462D": ".pdf", "504B0304": ".zip", "7B5C7274": ".rtf", "89504E470D0A": ".png", "FFD8FF": ".jpg", "47494638": ".gif", "D0CF11E0": ".bin"}


def strip(c: Column, chars: str = BLANK) -> Column:
    return F.regexp_replace(c, rf"\A(?:{chars})+|(?:{chars})+\z", "")


def slug(title: Column, fallback: str = "section", limit: int = 80) -> Column:
    """A title as a file name: no forbidden characters, single blanks, at most ``limit`` characters."""
    x = F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "")
    x = strip(F.regexp_replace(x, BLANK + "+", " "), r"[ .]")
    x = strip(F.substring(x, 1, limit), r"[ .]")
    return F.coalesce(F.when(x != "", x), F.lit(fallback))


def attachment_name(name: Column, limit: int = 120) -> Column:
    return F.substring(strip(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[ .]"), 1, limit)


def sheet_name(title: Column, fallback: str = "Sheet1") -> Column:
    """A title as a worksheet name, at most 31 characters."""
    x = strip(strip(F.regexp_replace(title, r"[\[\]:*?/\\]", "")), "'")
    x = F.substring(F.regexp_replace(x, BLANK + "+", " "), 1, 31)
    return F.coalesce(F.when(x != "", x), F.lit(fallback))


def clean_pdf(c: Column) -> Column:
    """Control characters other than tabs and line ends to blanks, runs of blanks and tabs to one."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " "), r"[ \t]+", " "))


def clean_docx(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def clean_xlsx(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[\x0b\x0c]", "\n"), r"[\x00-\x08\x0e-\x1f]", "")


def squeeze_blank_lines(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def collapse(c: Column) -> Column:
    """ASCII white space to one blank; no-break spaces stay."""
    return F.regexp_replace(c, r"[ \t\r\n\f\x0B]+", " ")


def wrap(c: Column, marker: str) -> Column:
    """Emphasis marks inside the outer blanks; nothing for blank text."""
    inner = strip(c)
    return F.when(inner == "", c).otherwise(F.concat(F.regexp_extract(c, rf"\A({BLANK}*)", 1), F.lit(marker), inner, F.lit(marker), F.regexp_extract(c, rf"({BLANK}*)\z", 1)))


def indent_lines(c: Column, by: str) -> Column:
    return F.regexp_replace(c, r"(?m)^(?=[^\n])", by)


def escape_cell(c: Column) -> Column:
    """Pipes escaped, line breaks as <br>; a lone carriage return stays."""
    return F.replace(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\r\n"), F.lit("<br>")), F.lit("\n"), F.lit("<br>"))


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def split_row(line: Column) -> Column:
    """Cells of a Markdown table row: split at pipes that no backslash escapes; one blank cell goes at each end."""
    parts = F.split(F.regexp_replace(line, r"\\\|", "\x01"), r"\|", -1)
    parts = F.transform(parts, lambda x: strip(F.replace(x, F.lit("\x01"), F.lit("|"))))
    parts = F.when((F.size(parts) > 0) & (parts[0] == ""), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when((F.size(parts) > 0) & (F.try_element_at(parts, F.lit(-1)) == ""), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\`*_{}\[\]()#+\-.!|~<>])", "$1")


def link_target(c: Column) -> Column:
    """The address of a link, without a title and angle brackets."""
    x = strip(c)
    titled = lambda mark: F.endswith(x, F.lit(mark)) & x.contains(f" {mark}")
    x = F.when(titled('"'), F.substring_index(x, ' "', 1)).when(titled("'"), F.substring_index(x, " '", 1)).otherwise(x)
    return strip(F.when(x.rlike(r"(?s)\A<.*>\z"), F.regexp_replace(x, r"\A<|>\z", "")).otherwise(x))


def quote_path(c: Column) -> Column:
    """Percent encoding that keeps / and ~ and writes a blank as %20."""
    x = F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.replace(F.replace(x, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def base_name(c: Column) -> Column:
    """The last part of a path with either slash."""
    return F.regexp_extract(c, r"([^\\/]+)[\\/]*\z", 1)


def suffix(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"[^./\\](\.[^./\\]+)\z", 1))


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*SUPPORTED) & ~F.startswith(base_name(path), F.lit("~$"))


def output_suffix(source_suffix: Column, target: Column) -> Column:
    """What a file is converted to: Markdown, or from Markdown the asked kind (.docx unless known)."""
    return F.when(~source_suffix.isin(*MARKDOWN), ".md").when(target.isin(".docx", ".xlsx", ".pdf"), target).otherwise(".docx")


def sniff(content: Column, name: Column) -> Column:
    """struct<container, suggested_suffix> by the first bytes; a zip takes the suffix by the declared kind."""
    head = F.hex(F.substring(content, 1, 8))
    declared = suffix(name)
    box = F.when(F.startswith(head, F.lit("504B0304")), "zip").when(head == "D0CF11E0A1B11AE1", "ole").when(F.startswith(head, F.lit("7B5C7274")), "rtf").otherwise("unknown")
    hint = F.when(box != "zip", "").when(declared.isin(*WORD), ".docx").when(declared.isin(*EXCEL), ".xlsx").otherwise("")
    return F.struct(box.alias("container"), hint.alias("suggested_suffix"))


def looks_like_pdf(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 5)) == "255044462D"


def suffix_from_content(data: Column) -> Column:
    """A file suffix by signature, .html by what its first 512 bytes begin with, else .dat."""
    h = F.hex(F.substring(data, 1, 8))
    head = F.lower(F.regexp_replace(F.decode(F.substring(data, 1, 512), "ISO-8859-1"), r"\A\s+", ""))
    known = F.coalesce(*[F.when(F.startswith(h, F.lit(sign)), ext) for sign, ext in SIGNATURES.items()])
    return F.coalesce(known, F.when(F.startswith(head, F.lit("<!doctype html")) | F.startswith(head, F.lit("<html")), ".html"), F.lit(".dat"))


def longest_prefix(key: Column, table: dict[str, str], parts: int = 3) -> Column:
    """Look-up of a dotted name, leaving out trailing parts until it is known."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(*[F.try_element_at(known, F.substring_index(key, ".", n)) for n in range(parts, 0, -1)])


def program_suffix(prog_id: Column) -> Column:
    """What a program's objects are stored as; versions and other trailing parts of its name don't count."""
    return F.coalesce(longest_prefix(F.lower(prog_id), PROGRAMS, 8), F.lit(""))


def image_suffix(mime: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(mime)), F.lit(".png"))


def is_remote(address: Column) -> Column:
    return F.lower(address).rlike(r"\A(https?|data|ftp):")


def add_title(md: Column, title: Column) -> Column:
    return F.when(md.rlike(r"\A\s*# "), md).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), md))


def ellipsize(c: Column, limit: int = 70) -> Column:
    x = strip(F.regexp_replace(c, BLANK + "+", " "))
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, limit - 1)), F.lit("…")))


def plain_notes(notes: Column, limit: int = 700) -> Column:
    """Release notes as plain text: headings end in a colon, bullets are dots, links show their address."""
    x = F.regexp_replace(notes, r"\r\n?", "\n")
    for pattern, to in ((r"(?m)^#{1,6}[ \t]+([^\n]*?)[ \t]*:?[ \t]*$", "$1:"), (r"(?m)^([ \t]*)[-*+][ \t]+", "$1• "), (r"\[([^\]]+)\]\(([^)\s]+)\)", "$1 ($2)"), (r"\*\*([^*]+)\*\*", "$1"), (r"(?<!\w)[*_]([^*_\n]+)[*_](?!\w)", "$1"), (r"`([^`]*)`", "$1")):
        x = F.regexp_replace(x, pattern, to)
    x = squeeze_blank_lines(x)
    cut = F.regexp_replace(F.substring(x, 1, limit), r"\s+\S*\z", "")
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(cut, F.lit("…")))


def version(tag: Column) -> Column:
    """Numbers of a version tag as an array that compares in order; [0] if there are none."""
    core = F.regexp_extract(tag, r"\A\s*[vV]?(\d+(?:\.\d+)*)", 1)
    return F.when(core == "", F.array(F.lit(0))).otherwise(F.transform(F.split(core, r"\."), lambda x: x.cast("int")))


def checksum(c: Column) -> Column:
    word = F.lower(F.regexp_extract(c, r"\A\s*(\S+)", 1))
    return F.when(F.length(word) == 64, word)


def size_text(n: Column) -> Column:
    """A whole number of bytes in megabytes; halves of a tenth go to the even one, where Java's formats go up."""
    x = n / F.lit(1048576.0)
    tenths = F.floor(x) * 10 + F.rint((x - F.floor(x)) * 10).cast("bigint")
    return F.when(n > 0, F.format_string("%d.%d MB", F.floor(tenths / 10), tenths % 10)).otherwise("?")


def pick_language(tags: Column) -> Column:
    """A recogniser's language: for three-letter codes those of vie, eng that exist, joined; for language-region tags the first of vi-VN, vi, en-US, en by equality or prefix; else the first; null for none."""
    short = F.forall(tags, lambda t: t.rlike(r"\A[a-z]{3}\z"))
    both = F.array_intersect(F.array(F.lit("vie"), F.lit("eng")), tags)
    wanted = [F.try_element_at(F.filter(tags, (lambda w: lambda t: (t == w) | F.startswith(t, F.lit(w + "-")))(w)), F.lit(1)) for w in ("vi-VN", "vi", "en-US", "en")]
    first = F.try_element_at(tags, F.lit(1))
    return F.when(F.size(tags) == 0, None).when(short, F.coalesce(F.when(F.size(both) > 0, F.array_join(both, "+")), first)).otherwise(F.coalesce(*wanted, first))


NUMBER = r"\A-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]+)?\z"


def typed_cell(c: Column) -> Column:
    """struct<vtype, int_value, float_value, text_value>: numbers by a strict pattern; 007, 1,5 and 12% stay text."""
    number, whole = c.rlike(NUMBER), ~c.contains(".")
    return F.struct(
        F.when(number & whole, "int").when(number, "float").otherwise("text").alias("vtype"),
        F.when(number & whole, c.try_cast("bigint")).alias("int_value"),
        F.when(number & ~whole, c.try_cast("double")).alias("float_value"),
        F.when(~number, c).alias("text_value"),
    )


def format_double(c: Column) -> Column:
    """Integral doubles without a point; others as shortest decimal text."""
    return F.when(c.isNull() | F.isnan(c), "").when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(F.regexp_replace(c.cast("string"), r"E(-?)", "e$1"))


def format_timestamp(c: Column) -> Column:
    midnight = F.date_format(c, "HH:mm:ss") == "00:00:00"
    return F.when(c.isNull(), "").when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))


def format_bool(c: Column) -> Column:
    return F.when(c.isNull(), "").when(c, "TRUE").otherwise("FALSE")


def format_text(c: Column) -> Column:
    return escape_cell(F.coalesce(strip(c), F.lit("")))


def clean_header(header: Column, position: Column) -> Column:
    """Blank and unnamed headers become numbered columns; headers aren't escaped."""
    x = strip(F.coalesce(header, F.lit("")))
    return F.when((x == "") | F.startswith(x, F.lit("Unnamed:")) | (F.lower(x) == "nan"), F.concat(F.lit("Cột "), position.cast("string"))).otherwise(x)


def alignment(delimiter: Column) -> Column:
    return F.when(delimiter.rlike(r"\A:-+:\z"), "center").when(delimiter.rlike(r"\A-+:\z"), "right").otherwise("")


def lenient_float(c: Column, fallback: float) -> Column:
    return F.coalesce(F.replace(strip(c), F.lit(","), F.lit(".")).try_cast("double"), F.lit(fallback))


def int_or(c: Column, fallback: int) -> Column:
    return F.coalesce(strip(c).try_cast("int"), F.lit(fallback))


def upper_median(values: Column) -> Column:
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def pad(cells: Column, width: Column) -> Column:
    return F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)).cast("int")))


def front_matter(text: Column) -> Column:
    """struct<meta map, body>: flat key: value lines between --- and --- or ... at the top; keys in lower case, the last of a key counts."""
    block = F.regexp_extract(text, r"\A---[ \t]*\n((?s:.*?\n)?)(?:---|\.\.\.)[ \t]*(?:\n|\z)", 1)
    there = text.rlike(r"\A---[ \t]*\n(?s:.*?\n)?(?:---|\.\.\.)[ \t]*(?:\n|\z)")
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"\A[^:\n]+:"))
    entries = F.transform(lines, lambda x: F.struct(F.lower(strip(F.regexp_extract(x, r"\A([^:]+):", 1))).alias("key"), F.regexp_replace(strip(F.regexp_extract(x, r"\A[^:]+:(.*)\z", 1)), r"""\A(["'])(.*)\1\z""", "$2").alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))
    return F.struct(F.when(there, F.map_from_entries(last)).otherwise(F.expr("cast(map() as map<string,string>)")).alias("meta"), F.when(there, F.regexp_replace(text, r"\A---[ \t]*\n(?s:.*?\n)?(?:---|\.\.\.)[ \t]*(?:\n|\z)", "")).otherwise(text).alias("body"))


def strip_field_codes(c: Column) -> Column:
    """Word's fields: the instruction between 0x13 and 0x14 goes, the result stays."""
    return F.regexp_replace(F.regexp_replace(c, r"\x13[^\x14\x15]*(\x14|\x15|\z)", ""), r"[\x14\x15]", "")


RELEASE = "struct<tag_name:string,draft:boolean,body:string,assets:array<struct<name:string,browser_download_url:string,size:bigint>>>"


def release(payload: Column, wanted: list[str], current: Column) -> Column:
    """struct<version, url, size, notes, checksum_url> of a release's JSON: the first of the ``wanted`` assets that it has,
    and the file beside it with the checksum; null for drafts, releases that are not newer, and those without the asset."""
    r = F.from_json(payload, RELEASE)
    by_name = lambda n: F.try_element_at(F.filter(F.coalesce(r["assets"], F.expr("array()").cast("array<struct<name:string,browser_download_url:string,size:bigint>>")), lambda a: a["name"] == n), F.lit(1))
    asset = F.coalesce(*[by_name(F.lit(n)) for n in wanted])
    made = F.struct(
        F.regexp_replace(r["tag_name"], r"\A[vV]+", "").alias("version"), asset["browser_download_url"].alias("url"), F.coalesce(asset["size"], F.lit(0)).cast("long").alias("size"),
        strip(F.coalesce(r["body"], F.lit(""))).alias("notes"), by_name(F.concat(asset["name"], F.lit(".sha256")))["browser_download_url"].alias("checksum_url"),
    )
    return F.when(~F.coalesce(r["draft"], F.lit(False)) & (version(r["tag_name"]) > version(current)) & asset.isNotNull(), made)
