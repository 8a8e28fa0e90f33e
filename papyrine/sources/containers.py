"""Readers for binary containers, as plain functions on bytes: OOXML documents and workbooks, OLE files, Word-97 text,
attachments, and the text of simple PDF files. They raise ValueError; the plans turn that into status rows."""

from __future__ import annotations

import datetime as dt
import io
import re
import struct
import zipfile
import zlib
from html import escape
from xml.etree import ElementTree as ET

from papyrine.functions.text import PROGRAMS, SIGNATURES

# OOXML namespaces, and how paragraph and character styles become elements.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
O = "{urn:schemas-microsoft-com:office:office}"
STYLES = {"title": "h1", "subtitle": "h2", "quote": "blockquote", "intensequote": "blockquote", "code": "pre", "caption": "caption"}
DATE_FORMATS = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47))
OFFICE_STREAMS = (("WordDocument", ".doc"), ("Workbook", ".xls"), ("Book", ".xls"), ("PowerPoint Document", ".ppt"), ("VisioDocument", ".vsd"), ("Package", ".bin"))


def relationships(xml: bytes) -> dict[str, dict[str, str]]:
    return {e.get("Id"): dict(e.attrib) for e in ET.fromstring(xml)} if xml else {}


def _part(z: zipfile.ZipFile, name: str) -> bytes:
    try:
        return z.read(name)
    except KeyError:
        return b""


def _open(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError("the file is damaged or no Office document") from e


def docx_html(content: bytes, image_href=None, attachment_href=None) -> tuple[str, list[str], list[dict]]:
    """(HTML, warnings, assets) of a .docx; assets are dicts kind, name, content in order of appearance.

    image_href(n, name, data) and attachment_href(name, data) give the addresses; without them assets are left out.
    """
    z = _open(content)
    body = ET.fromstring(_part(z, "word/document.xml") or b"<x/>").find(f"{W}body")
    if body is None:
        raise ValueError("the file holds no Word document")
    rels = relationships(_part(z, "word/_rels/document.xml.rels"))
    names = {s.get(f"{W}styleId"): (s.find(f"{W}name").get(f"{W}val") if s.find(f"{W}name") is not None else "") for s in ET.fromstring(_part(z, "word/styles.xml") or b"<x/>").iter(f"{W}style")}
    numbering = ET.fromstring(_part(z, "word/numbering.xml") or b"<x/>")
    abstract = {n.get(f"{W}numId"): n.find(f"{W}abstractNumId").get(f"{W}val") for n in numbering.iter(f"{W}num") if n.find(f"{W}abstractNumId") is not None}
    bullets = {(a.get(f"{W}abstractNumId"), lv.get(f"{W}ilvl")): (lv.find(f"{W}numFmt") is not None and lv.find(f"{W}numFmt").get(f"{W}val") == "bullet") for a in numbering.iter(f"{W}abstractNum") for lv in a.iter(f"{W}lvl")}
    warnings: list[str] = []
    assets: list[dict] = []
    notes: list[tuple[str, str]] = []  # kind and id of foot- and endnotes, as they are referred to

    def target(rid: str | None) -> str:
        t = rels.get(rid or "", {}).get("Target", "")
        return t.lstrip("/") if t.startswith("/") else f"word/{t}"

    def run_html(r) -> str:
        out = ""
        for c in r:
            if c.tag == f"{W}t":
                out += escape(c.text or "", quote=False)
            elif c.tag in (f"{W}br", f"{W}cr"):
                out += "<br>"
            elif c.tag == f"{W}tab":
                out += "\t"
            elif c.tag in (f"{W}footnoteReference", f"{W}endnoteReference"):
                kind = "footnote" if c.tag.endswith("footnoteReference") else "endnote"
                notes.append((kind, c.get(f"{W}id") or ""))
                out += f'<sup><a href="#{kind}-{notes[-1][1]}">[{len(notes)}]</a></sup>'
            elif c.tag == f"{W}drawing" and image_href:
                for blip in c.iter(f"{A}blip"):
                    name = target(blip.get(f"{R}embed"))
                    data = _part(z, name)
                    if data:
                        n = sum(a["kind"] == "image" for a in assets) + 1
                        assets.append({"kind": "image", "name": name.rsplit("/", 1)[-1], "content": data})
                        out += f'<img src="{escape(image_href(n, name, data))}" alt="">'
                    else:
                        warnings.append(f"an image is missing: {name}")
            elif c.tag == f"{W}object" and attachment_href:
                for ole in c.iter(f"{O}OLEObject"):
                    if rels.get(ole.get(f"{R}id") or "", {}).get("TargetMode", "").lower() == "external":  # the file lies elsewhere
                        there = rels[ole.get(f"{R}id")].get("Target", "")
                        out += f'<a href="{escape(there)}">{escape(re.split(r"[\\\\/]", there)[-1] or there)}</a>'
                        continue
                    data = _part(z, target(ole.get(f"{R}id")))
                    try:
                        name, payload = attachment(data, ole.get("ProgID") or "", target(ole.get(f"{R}id")))
                        assets.append({"kind": "attachment", "name": name, "content": payload})
                        out += f'<a href="{escape(attachment_href(name, payload))}">{escape(name)}</a>'
                    except ValueError as e:
                        warnings.append(f"an attachment could not be read: {e}")
        props = r.find(f"{W}rPr")
        if props is None or not out.strip():
            return out
        on = lambda tag: (e := props.find(f"{W}{tag}")) is not None and e.get(f"{W}val") not in ("0", "false", "none")
        style = names.get((props.find(f"{W}rStyle").get(f"{W}val") if props.find(f"{W}rStyle") is not None else ""), "").lower()
        for there, tag in ((style == "code char", "code"), (on("strike"), "s"), (on("i"), "em"), (on("b") or style == "strong", "strong")):
            out = f"<{tag}>{out}</{tag}>" if there else out
        v = props.find(f"{W}vertAlign")
        if v is not None and v.get(f"{W}val") in ("superscript", "subscript"):
            out = f"<{v.get(f'{W}val')[:3]}>{out}</{v.get(f'{W}val')[:3]}>"
        return out

    def inline(p) -> str:
        out = ""
        for c in p:
            if c.tag == f"{W}r":
                out += run_html(c)
            elif c.tag == f"{W}hyperlink":
                href = rels.get(c.get(f"{R}id") or "", {}).get("Target")
                out += f'<a href="{escape(href)}">{inline(c)}</a>' if href else inline(c)
            elif c.tag in (f"{W}ins", f"{W}smartTag", f"{W}sdt", f"{W}sdtContent"):
                out += inline(c)
        return out

    def blocks(parent) -> str:
        out: list[str] = []
        stack: list[str] = []
        code: list[str] = []

        def close(to: int = 0) -> None:
            while len(stack) > to:
                out.append(f"</li></{stack.pop()}>")

        for e in parent:
            if e.tag == f"{W}p":
                props = e.find(f"{W}pPr")
                sid = props.find(f"{W}pStyle").get(f"{W}val") if props is not None and props.find(f"{W}pStyle") is not None else ""
                style = (names.get(sid) or sid).lower()
                said = inline(e)
                kind = STYLES.get(style.replace(" ", ""))
                if kind == "pre":
                    code.append(said)
                    continue
                if code:
                    out.append("<pre>" + "\n".join(code) + "</pre>")
                    code.clear()
                num = props.find(f"{W}numPr") if props is not None else None
                level = int(num.find(f"{W}ilvl").get(f"{W}val")) if num is not None and num.find(f"{W}ilvl") is not None else 0
                listed = num is not None or style.startswith("list ")
                if m := re.match(r"heading (\d)", style):
                    kind, listed = f"h{min(6, int(m[1]))}", False
                if listed and said.strip():
                    nid = num.find(f"{W}numId").get(f"{W}val") if num is not None and num.find(f"{W}numId") is not None else ""
                    bullet = bullets.get((abstract.get(nid, ""), str(level)), "number" not in style)
                    tag = "ul" if bullet else "ol"
                    close(level + 1)
                    if len(stack) == level + 1:
                        if stack[-1] == tag:
                            out.append("</li><li>")
                        else:
                            close(level)
                    while len(stack) < level + 1:
                        stack.append(tag)
                        out.append(f"<{tag}><li>")
                    out.append(said)
                    continue
                close()
                if kind == "caption":
                    out.append(f"<p><em>{said}</em></p>")
                elif said.strip():
                    out.append(f"<{kind or 'p'}>{said}</{kind or 'p'}>")
            elif e.tag == f"{W}tbl":
                close()
                rows = []
                for tr in e.findall(f"{W}tr"):
                    cells = []
                    for tc in tr.findall(f"{W}tc"):
                        down = tc.find(f"{W}tcPr/{W}vMerge")
                        if down is not None and down.get(f"{W}val") != "restart":
                            continue  # goes on with the cell above
                        span = tc.find(f"{W}tcPr/{W}gridSpan")
                        cells.append(f'<td colspan="{span.get(f"{W}val") if span is not None else 1}">{blocks(tc)}</td>')
                    rows.append("<tr>" + "".join(cells) + "</tr>")
                out.append("<table>" + "".join(rows) + "</table>")
            elif e.tag == f"{W}sdt" and e.find(f"{W}sdtContent") is not None:
                close()
                out.append(blocks(e.find(f"{W}sdtContent")))
        if code:
            out.append("<pre>" + "\n".join(code) + "</pre>")
        close()
        return "".join(out)

    said = blocks(body)
    if notes:
        texts = {(kind, n.get(f"{W}id")): n for kind in ("footnote", "endnote") for n in ET.fromstring(_part(z, f"word/{kind}s.xml") or b"<x/>").iter(f"{W}{kind}")}
        said += "<ol>" + "".join(f'<li>{blocks(texts[k]) if k in texts else ""}<p><a href="#{k[0]}-ref-{k[1]}">↑</a></p></li>' for k in list(notes)) + "</ol>"
    return said, warnings, assets


def xlsx_cells(content: bytes) -> list[tuple[int, str, int, int, str | None, str]]:
    """(sheet_no, sheet, row_no, col_no, value as text, vtype) of every sheet; row_no 0 is the first used row."""
    z = _open(content)
    if not _part(z, "xl/workbook.xml"):
        raise ValueError("the file holds no workbook")
    book, rels = ET.fromstring(z.read("xl/workbook.xml")), relationships(_part(z, "xl/_rels/workbook.xml.rels"))
    shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(_part(z, "xl/sharedStrings.xml") or b"<x/>").iter(f"{S}si")]
    styles = ET.fromstring(_part(z, "xl/styles.xml") or b"<x/>")
    own = {n.get("numFmtId"): n.get("formatCode", "") for n in styles.iter(f"{S}numFmt")}
    xfs = styles.find(f"{S}cellXfs")
    dates = [int(x.get("numFmtId", "0")) in DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(x.get("numFmtId"), "")), re.I)) for x in (xfs if xfs is not None else [])]
    base = dt.datetime(1904, 1, 1) if (p := book.find(f"{S}workbookPr")) is not None and p.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
    out = []
    for no, sheet in enumerate(book.iter(f"{S}sheet")):
        path = rels.get(sheet.get(f"{R}id"), {}).get("Target", "")
        root = ET.fromstring(_part(z, path.lstrip("/") if path.startswith("/") else f"xl/{path}") or b"<x/>")
        first = None
        for row in root.iter(f"{S}row"):
            for k, c in enumerate(row.findall(f"{S}c")):
                ref = re.match(r"([A-Z]+)(\d+)", c.get("r") or "")
                col = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(ref[1]))) - 1 if ref else k
                line = int(ref[2]) if ref else int(row.get("r") or 1)
                v, kind = c.find(f"{S}v"), c.get("t", "n")
                raw = v.text if v is not None else None
                if kind == "inlineStr":
                    value, vtype = "".join(t.text or "" for t in c.iter(f"{S}t")), "text"
                elif raw is None:
                    continue
                elif kind == "s":
                    value, vtype = shared[int(raw)], "text"
                elif kind == "b":
                    value, vtype = "TRUE" if raw == "1" else "FALSE", "bool"
                elif kind in ("str", "e"):
                    value, vtype = raw, "text"
                elif int(c.get("s", 0)) < len(dates) and dates[int(c.get("s", 0))]:
                    t = base + dt.timedelta(seconds=round(float(raw) * 86400))
                    value, vtype = t.strftime("%H:%M:%S" if float(raw) < 1 else "%Y-%m-%d" if t.time() == dt.time() else "%Y-%m-%d %H:%M:%S"), "date"
                else:
                    number = float(raw)
                    value, vtype = str(int(number)) if number.is_integer() else repr(number), "number"
                first = line if first is None else first
                out.append((no, sheet.get("name"), line - first, col, value, vtype))
    return out


def xlsx_sheets(content: bytes) -> list[tuple[int, str]]:
    """(sheet_no, sheet) of every sheet, those without a cell too."""
    book = ET.fromstring(_open(content).read("xl/workbook.xml"))
    return [(no, s.get("name")) for no, s in enumerate(book.iter(f"{S}sheet"))]


def ole_streams(content: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name."""
    if content[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
        raise ValueError("no OLE file")
    try:
        shift, mini_shift = struct.unpack_from("<HH", content, 30)
        n_fat, first_dir, _, cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIIIIII", content, 44)
        size = 1 << shift
        sector = lambda k: content[(k + 1) * size : (k + 2) * size]
        difat = list(struct.unpack_from("<109I", content, 76))
        at = first_difat
        for _ in range(n_difat):
            more = struct.unpack(f"<{size // 4}I", sector(at))
            difat += more[:-1]
            at = more[-1]
        fat: list[int] = []
        for k in difat[:n_fat]:
            fat += struct.unpack(f"<{size // 4}I", sector(k))

        def chain(k: int, table: list[int], get) -> bytes:
            out, seen = [], 0
            while k < 0xFFFFFFFA and seen <= len(table):
                out.append(get(k))
                k, seen = table[k], seen + 1
            return b"".join(out)

        directory = chain(first_dir, fat, sector)
        mini_raw = chain(first_mini, fat, sector)
        mini_fat = list(struct.unpack(f"<{len(mini_raw) // 4}I", mini_raw))
        root, found = b"", {}
        for i in range(0, len(directory), 128):
            e = directory[i : i + 128]
            n, kind = struct.unpack_from("<H", e, 64)[0], e[66]
            start, length = struct.unpack_from("<II", e, 116)
            name = e[: max(0, n - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                root = chain(start, fat, sector)
            elif kind == 2:
                small = length < cutoff
                data = chain(start, mini_fat, lambda k: root[k << mini_shift : (k + 1) << mini_shift]) if small else chain(start, fat, sector)
                found[name] = data[:length]
        return found
    except (struct.error, IndexError) as e:
        raise ValueError("a damaged OLE file") from e


def ole10_native(blob: bytes) -> tuple[str, bytes]:
    """(name, payload) of an Ole10Native record; the Unicode label is preferred, then the Unicode path, label, path."""
    try:
        at = 4
        if struct.unpack_from("<H", blob, at)[0] != 2:
            raise ValueError("not an embedded file")
        at += 2

        def asciiz() -> str:
            nonlocal at
            end = blob.index(b"\0", at)
            said, at = blob[at:end].decode("cp1252", "replace"), end + 1
            return said

        label, path = asciiz(), asciiz()
        at += 4
        n = struct.unpack_from("<I", blob, at)[0]
        at += 4 + n
        n = struct.unpack_from("<I", blob, at)[0]
        at += 4
        payload = blob[at : at + n]
        if not n or len(payload) < n:
            raise ValueError("an empty or cut payload")
        at += n
        wide = []
        for _ in range(3):
            if at + 4 > len(blob):
                break
            k = struct.unpack_from("<I", blob, at)[0]
            if at + 4 + 2 * k > len(blob):
                break
            wide.append(blob[at + 4 : at + 4 + 2 * k].decode("utf-16-le", "replace").rstrip("\0"))
            at += 4 + 2 * k
    except (struct.error, ValueError, IndexError) as e:
        raise ValueError(str(e) or "a damaged record") from e
    named = [wide[1] if len(wide) > 1 else "", wide[2] if len(wide) > 2 else "", label, path]
    name = next((x for x in named if x), "attachment")
    return re.split(r"[\\/]", name)[-1], payload


def suffix_of_program(prog_id: str) -> str:
    """As the native ``program_suffix``, for one name at hand."""
    parts = prog_id.lower().split(".")
    return next((PROGRAMS[name] for n in range(len(parts), 0, -1) if (name := ".".join(parts[:n])) in PROGRAMS), "")


def suffix_of_content(data: bytes) -> str:
    """As the native ``suffix_from_content``, for bytes at hand."""
    head = data[:512].lstrip().lower()
    known = next((ext for sign, ext in SIGNATURES.items() if data.startswith(bytes.fromhex(sign))), None)
    return known or (".html" if head.startswith((b"<!doctype html", b"<html")) else ".dat")


def attachment(data: bytes, prog_id: str, part: str) -> tuple[str, bytes]:
    """(name, bytes) of an embedded part: an Ole10Native record, an Office stream, CONTENTS, or the part itself."""
    name = part.rsplit("/", 1)[-1]
    if not data:
        raise ValueError("no such part")
    if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
        return name, data
    streams = ole_streams(data)
    if "\x01Ole10Native" in streams:
        return ole10_native(streams["\x01Ole10Native"])
    for stream, suffix in OFFICE_STREAMS:
        if stream in streams:
            return name.rsplit(".", 1)[0] + suffix, streams["Package"] if stream == "Package" else data
    if "CONTENTS" in streams:
        return name.rsplit(".", 1)[0] + (suffix_of_program(prog_id) or suffix_of_content(streams["CONTENTS"])), streams["CONTENTS"]
    raise ValueError(f"an unknown kind of object ({prog_id})")


def doc_text(content: bytes) -> str:
    """The text of a Word-97 file by its piece table, paragraphs a blank line apart; field instructions are left out."""
    streams = ole_streams(content)
    fib = streams.get("WordDocument", b"")
    try:
        flags, length = struct.unpack_from("<H", fib, 10)[0], struct.unpack_from("<I", fib, 76)[0]
        if flags & 0x100:
            raise ValueError("the document is encrypted")
        clx_at, clx_n = struct.unpack_from("<II", fib, 0x1A2)
        clx = streams.get("1Table" if flags & 0x200 else "0Table", b"")[clx_at : clx_at + clx_n]
        at = 0
        while clx[at] == 1:
            at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
        n = struct.unpack_from("<I", clx, at + 1)[0]
        plc = clx[at + 5 : at + 5 + n]
        pieces = (n - 4) // 12
        cps = struct.unpack_from(f"<{pieces + 1}I", plc)
        out = ""
        for k in range(pieces):
            where = struct.unpack_from("<I", plc, 4 * (pieces + 1) + 8 * k + 2)[0]
            count = min(cps[k + 1], length) - cps[k]
            if count > 0:
                out += fib[(where & 0x3FFFFFFF) // 2 :][:count].decode("cp1252", "replace") if where & 0x40000000 else fib[where : where + 2 * count].decode("utf-16-le", "replace")
    except (struct.error, IndexError) as e:
        raise ValueError("a damaged Word document") from e
    out = re.sub(r"\x13[^\x14\x15]*(?:\x14|\x15|$)", "", out).replace("\x14", "").replace("\x15", "")
    out = out.replace("\x07", "\t").replace("\x0b", "\n").replace("\x0c", "\r").replace("\xa0", " ").replace("\x1e", "-")
    parts = (re.sub(r"[\x00-\x08\x0e-\x1f]", "", p).strip() for p in out.split("\r"))
    return "\n\n".join(p for p in parts if p)


REFERENCE = rb"(\d+)\s+\d+\s+R"
SPACE = -180  # thousandths of the font's size between letters that stand for a blank


def _pdf_stream(body: bytes) -> bytes:
    """An object's stream, inflated if it says so; predictors of such streams are taken back."""
    head, _, rest = body.partition(b"stream")
    data = re.sub(rb"\r?\nendstream\s*\Z", b"", re.sub(rb"\A\r?\n", b"", rest))
    if b"FlateDecode" not in head:
        return data
    data = zlib.decompressobj().decompress(data)
    if (m := re.search(rb"/Predictor\s+(\d+)", head)) and int(m[1]) >= 10:
        wide = int(m[1]) if (m := re.search(rb"/Columns\s+(\d+)", head)) else 1
        rows, above = [], bytes(wide)
        for k in range(0, len(data) - wide, wide + 1):
            row = bytearray(data[k + 1 : k + 1 + wide])
            if data[k] == 2:
                row = bytearray((x + y) & 255 for x, y in zip(row, above))
            elif data[k] == 1:
                for j in range(1, wide):
                    row[j] = (row[j] + row[j - 1]) & 255
            rows.append(bytes(row))
            above = rows[-1]
        data = b"".join(rows)
    return data


def _code_map(cmap: bytes) -> dict[int, str]:
    """Character codes to text, of a font's own table."""
    said = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {int(c, 16): said(t) for c, t in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for lo, hi, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[[^\]]*\])", part):
            if to[:1] == b"[":
                texts = [said(t) for t in re.findall(rb"<([0-9A-Fa-f]*)>", to)]
            else:
                first = said(to[1:-1])
                texts = [first[:-1] + chr(ord(first[-1]) + k) for k in range(int(hi, 16) - int(lo, 16) + 1)] if first else []
            out |= {int(lo, 16) + k: t for k, t in enumerate(texts)}
    return out


def _pdf_fonts(page: bytes, objects: dict[int, bytes]) -> dict[bytes, tuple[dict[int, str] | None, int, bool]]:
    """By name a font's table (None: Latin-1), bytes a character, and whether it is bold."""
    res = re.search(rb"/Resources\s+" + REFERENCE, page)
    scope = page + (objects.get(int(res[1]), b"") if res else b"")
    if m := re.search(rb"/Font\s+" + REFERENCE, scope):
        scope = b"/Font " + objects.get(int(m[1]), b"")
    m = re.search(rb"/Font\s*<<(.*?)>>", scope, re.S)
    out = {}
    for name, k in re.findall(rb"/([^\s/<>]+)\s+" + REFERENCE, m[1] if m else b""):
        body = objects.get(int(k), b"")
        table = re.search(rb"/ToUnicode\s+" + REFERENCE, body)
        wide = 2 if re.search(rb"/Subtype\s*/Type0\b", body) else 1
        out[name] = _code_map(_pdf_stream(objects.get(int(table[1]), b""))) if table else None, wide, bool(re.search(rb"/BaseFont\s*/\S*(?:bold|black|heavy)", body, re.I))
    return out


def pdf_runs(content: bytes) -> list[tuple[int, str, float, float, float, bool]]:
    """(page_no, text, x, y, size, bold) of the text that a PDF file shows: plain or inflated streams, objects in streams,
    fonts with a table of their own or in one byte. Files with encryption raise."""
    if content[:5] != b"%PDF-":
        raise ValueError("no PDF file")
    if b"/Encrypt" in content:
        raise ValueError("the file is protected by a password")
    objects = _pdf_objects(content)
    out = []
    for no, page in enumerate((b for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)), 1):
        fonts = _pdf_fonts(page, objects)
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        code = b"\n".join(_pdf_stream(objects.get(int(k), b"")) for k in re.findall(REFERENCE, m[1])) if m else b""
        x = y = lx = ly = 0.0
        size, scale, lead, args, font = 12.0, 1.0, 0.0, [], (None, 1, False)

        def said(tok: bytes) -> str:
            if tok[:1] == b"(":
                raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda q: bytes([int(q[1], 8) & 255]) if q[1].isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b""}.get(q[1], q[1]), tok[1:-1], flags=re.S)
            else:
                digits = re.sub(rb"\s", b"", tok[1:-1])
                raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            table, wide, _ = font
            if table is None:
                return raw.decode("latin-1")
            return "".join(table.get(int.from_bytes(raw[k : k + wide], "big"), "") for k in range(0, len(raw), wide))

        for t in re.finditer(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", code, re.S):
            tok = t[0]
            number = re.fullmatch(rb"[-+]?\d*\.?\d+", tok)
            if tok[:1] in b"(<[]/" or number:
                args.append(float(tok) if number else tok)
                continue
            num = [a for a in args if isinstance(a, float)]
            if tok == b"BT":
                x = y = lx = ly = 0.0
                scale = 1.0
            elif tok == b"Tf" and num:
                size = num[-1]
                font = next((fonts[a[1:]] for a in args if isinstance(a, bytes) and a[1:] in fonts), (None, 1, False))
            elif tok == b"TL" and num:
                lead = num[-1]
            elif tok in (b"Td", b"TD") and len(num) >= 2:
                lx, ly = lx + num[-2] * scale, ly + num[-1] * scale
                x, y = lx, ly
                lead = -num[-1] if tok == b"TD" else lead
            elif tok == b"Tm" and len(num) >= 6:
                lx, ly, scale = num[-2], num[-1], abs(num[-3]) or 1.0
                x, y = lx, ly
            elif tok in (b"T*", b"'", b'"'):
                ly -= lead * scale
                x, y = lx, ly
            if tok in (b"Tj", b"TJ", b"'", b'"'):
                text = "".join(" " if isinstance(a, float) and tok == b"TJ" and a < SPACE else said(a) if isinstance(a, bytes) and a[:1] in b"(<" else "" for a in args)
                if text.strip():
                    out.append((no, text, x, y, size * scale, font[2]))
            args = []
    return out


def _pdf_objects(content: bytes) -> dict[int, bytes]:
    """Objects by number, those that are packed into streams too."""
    out = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content, re.S)}
    for body in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body):
            data = _pdf_stream(body)
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            numbers = list(map(int, data[:first].split()))
            places = sorted(zip(numbers[1::2], numbers[::2]))
            for (at, k), (end, _) in zip(places, [*places[1:], (len(data) - first, 0)]):
                out.setdefault(k, data[first + at : first + end])
    return out


def pdf_lines(content: bytes) -> list[tuple[int, int, str, float, bool, float, float]]:
    """(page_no, seq, text, size, bold, top, bottom): text shown at one height, in order, is a line; heights from the top."""
    box = re.compile(rb"/MediaBox\s*\[\s*[-\d.]+\s+[-\d.]+\s+[-\d.]+\s+([-\d.]+)\s*\]")
    runs, objects = pdf_runs(content), _pdf_objects(content)
    shared = next((float(m[1]) for body in objects.values() if (m := box.search(body))), 842.0)
    heights = [float(m[1]) if (m := box.search(b)) else shared for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]
    out: list[list] = []
    for page, text, _, y, size, bold in runs:
        top = heights[page - 1] - y - size
        said = " ".join(text.split())
        if out and out[-1][0] == page and abs(out[-1][5] - top) < 0.3 * size:
            out[-1][2] += " " + said
            out[-1][3], out[-1][4] = max(out[-1][3], size), out[-1][4] and bold
        elif said:
            out.append([page, len(out), said, size, bold, top, top + size])
    return [tuple(x) for x in out]


def pdf_images(content: bytes) -> list[tuple[int, str, bytes]]:
    """(page_no, suffix, bytes) of pictures, in the order of pages and objects: JPEG as it is, plain 8-bit grey and RGB
    as PNG; those of other kinds are left out."""
    objects = _pdf_objects(content)
    pages = [b for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]

    def reach(body: bytes, seen: set[int]) -> set[int]:
        """Objects that a page's resources name."""
        for k in map(int, re.findall(rb"(\d+)\s+\d+\s+R", re.sub(rb"/(?:Parent|Contents|Annots)\s*(?:\[[^\]]*\]|\d+\s+\d+\s+R)", b"", body.split(b"stream")[0]))):
            if k in objects and k not in seen:
                seen.add(k)
                if not re.search(rb"/Type\s*/Pages?\b", objects[k]):
                    reach(objects[k], seen)
        return seen

    out, done = [], set()
    for no, page in enumerate(pages, 1):
        for k in sorted(reach(page, set())):
            head, _, rest = objects[k].partition(b"stream")
            if k in done or not re.search(rb"/Subtype\s*/Image\b", head):
                continue
            done.add(k)
            data = re.sub(rb"\r?\nendstream\s*\Z", b"", re.sub(rb"\A\r?\n", b"", rest))
            size = [int(m[1]) if (m := re.search(rb"/" + n + rb"\s+(\d+)", head)) else 0 for n in (b"Width", b"Height", b"BitsPerComponent")]
            if b"DCTDecode" in head:
                out.append((no, "jpg", data))
            elif b"FlateDecode" in head and size[2] == 8 and (kind := re.search(rb"/ColorSpace\s*/Device(RGB|Gray)", head)) and b"Predictor" not in head:
                out.append((no, "png", png(zlib.decompress(data), size[0], size[1], 3 if kind[1] == b"RGB" else 1)))
    return out


def png(samples: bytes, width: int, height: int, channels: int) -> bytes:
    """A PNG of 8-bit samples, rows from the top."""
    row = width * channels
    raw = b"".join(b"\0" + samples[k * row : k * row + row].ljust(row, b"\0") for k in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
