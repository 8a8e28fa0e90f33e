"""Writers for office files: Markdown blocks to .docx, cells to .xlsx; only the standard library's zip and text.

Pictures come from a finder, a function from a link's path to bytes; without one, or where it finds nothing, their text
or address stands in their place.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from papyrine.operators import markdown as md
from papyrine.sources.pictures import Finder, found

XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
# Namespaces and content types of the formats.
NS_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
NS_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
NS_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
NS_P = "http://schemas.openxmlformats.org/package/2006/relationships"
NS_T = "http://schemas.openxmlformats.org/package/2006/content-types"
OFFICE = "application/vnd.openxmlformats-officedocument."
NS_D = "http://schemas.openxmlformats.org/drawingml/2006/"
FORMATS = ("decimal", "lowerLetter", "lowerRoman")
# Paper in twentieths of a point, margins, the font of code and how much smaller it is, a picture's largest
# size in a sheet and a pixel in points and in the formats' units.
PAPER = {"A4": (11906, 16838), "Letter": (12240, 15840), "Legal": (12240, 20160)}
MARGIN, CODE_FONT, CODE_RATIO, FONT, POINTS, SPACING = 1440, "Consolas", 0.85, "Times New Roman", 13.0, 1.15
BOX, PIXEL, UNITS = (640, 480), 0.75, 9525
BAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text if isinstance(text, bytes) else XML + text)
    return out.getvalue()


def docx(text: str, stem: str = "document", font: str | None = None, points: float | None = None, toc: bool = False, page_break_h1: bool = False, add_title: bool = True, page: str = "A4", spacing: float | None = None, finder: Finder | None = None, warnings: list[str] | None = None) -> bytes:
    """A .docx of Markdown: headings, styled runs, links, pictures, lists (a numbering each), tables with a repeated head, code, quotes."""
    warnings = warnings if warnings is not None else []
    wide, high = PAPER.get(page, PAPER["A4"])
    font, points, spacing = font or FONT, points or POINTS, spacing or SPACING
    pictures: list[tuple[bytes, str]] = []
    blocks, meta = md.parse(text)
    if add_title and not (blocks and blocks[0]["kind"] == "heading" and blocks[0]["level"] == 1):
        blocks.insert(0, {"kind": "heading", "level": 1, "text": meta.get("title") or stem})
    rels: list[str] = []
    lists: list[tuple[bool, int]] = []

    def runs(said: str) -> str:
        out = ""
        for s in md.inline(said):
            if s["kind"] == "image":
                if picture := found(s["src"], finder, warnings):
                    out += drawing(s["text"], *picture)
                    continue
                s = {**s, "kind": "text", "text": f"{s['text']} ({s['src']})" if s["text"] else s["src"], "href": None}
            p = "".join(x for on, x in ((s["code"], '<w:rStyle w:val="CodeChar"/>'), (s["bold"], "<w:b/>"), (s["italic"], "<w:i/>"), (s["strike"], "<w:strike/>"), (s["vertical"], f'<w:vertAlign w:val="{"superscript" if s["vertical"] == "sup" else "subscript"}"/>')) if on)
            body = "<w:br/>" if s["kind"] == "break" else f'<w:t xml:space="preserve">{escape(BAD.sub("", s["text"]))}</w:t>'
            r = f"<w:r>{f'<w:rPr>{p}</w:rPr>' if p else ''}{body}</w:r>"
            if s["href"]:
                rels.append(s["href"])
                r = f'<w:hyperlink r:id="rLink{len(rels)}">{r}</w:hyperlink>'
            out += r
        return out

    def drawing(alt: str, data: bytes, suffix: str, width: int, height: int) -> str:
        pictures.append((data, suffix))
        n, room = len(pictures), (wide - 2 * MARGIN) * 635  # a twentieth of a point in the format's units
        cx, cy = width * UNITS, height * UNITS
        cx, cy = (room, cy * room // cx) if cx > room else (cx, cy)
        return (
            f'<w:r><w:drawing><wp:inline><wp:extent cx="{cx}" cy="{cy}"/><wp:docPr id="{n}" name="Picture {n}" descr={quoteattr(BAD.sub("", alt))}/><a:graphic><a:graphicData uri="{NS_D}picture"><pic:pic><pic:nvPicPr><pic:cNvPr id="{n}" name="image{n}.{suffix}"/><pic:cNvPicPr/></pic:nvPicPr>'
            f'<pic:blipFill><a:blip r:embed="rPic{n}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
        )

    def para(inner: str, style: str = "", extra: str = "") -> str:
        p = (f'<w:pStyle w:val="{style}"/>' if style else "") + extra
        return f"<w:p>{f'<w:pPr>{p}</w:pPr>' if p else ''}{inner}</w:p>"

    def write(bs: list[dict], depth: int = 0, style: str = "") -> str:
        out = ""
        for b in bs:
            kind = b["kind"]
            if kind == "heading":
                out += para(runs(b["text"]), f"Heading{b['level']}", "<w:pageBreakBefore/>" if page_break_h1 and b["level"] == 1 and out else "")
            elif kind == "paragraph":
                out += para(runs(b["text"]), style)
            elif kind == "code":
                out += "".join(para(f'<w:r><w:t xml:space="preserve">{escape(BAD.sub("", ln))}</w:t></w:r>', "Code") for ln in b["text"].split("\n"))
            elif kind == "quote":
                out += write(b["blocks"], depth, "Quote")
            elif kind == "rule":
                out += para("", "", '<w:pBdr><w:bottom w:val="single" w:sz="6" w:space="1" w:color="auto"/></w:pBdr>')
            elif kind == "table":
                rows = [b["header"], *b["rows"]]
                out += '<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/></w:tblPr>' + "".join(
                    "<w:tr>" + ("<w:trPr><w:tblHeader/></w:trPr>" if k == 0 else "") + "".join(f"<w:tc>{para(runs(c), '', f'<w:jc w:val={quoteattr(a)}/>' if a else '')}</w:tc>" for c, a in zip(r, b["alignments"])) + "</w:tr>" for k, r in enumerate(rows)
                ) + "</w:tbl>"
            elif kind == "list":
                lists.append((b["ordered"], b["start"] if depth == 0 else 1))
                number = len(lists)
                for item in b["items"]:
                    inner = item["blocks"]
                    if inner and inner[0]["kind"] == "list" and item["checked"] is None:
                        out += write(inner, depth)  # an item that only holds a list has no bullet of its own
                        continue
                    mark = {True: "☒ ", False: "☐ ", None: ""}[item["checked"]]
                    said = inner[0]["text"] if inner and inner[0]["kind"] == "paragraph" else ""
                    out += para((f"<w:r><w:t>{mark}</w:t></w:r>" if mark else "") + runs(said), "", f'<w:numPr><w:ilvl w:val="{min(depth, 8)}"/><w:numId w:val="{number}"/></w:numPr>')
                    out += write(inner[1:] if said else inner, depth + 1)
        return out

    body = write(blocks)
    if toc:
        body = para('<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>TOC \\o "1-3" \\h</w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>') + body
    face = lambda name: f'<w:rFonts w:ascii={quoteattr(name)} w:hAnsi={quoteattr(name)} w:cs={quoteattr(name)} w:eastAsia={quoteattr(name)}/>'
    half = lambda p: f'<w:sz w:val="{round(p * 2)}"/><w:szCs w:val="{round(p * 2)}"/>'
    style = lambda sid, name, kind="paragraph", more="": f'<w:style w:type="{kind}" w:styleId="{sid}"><w:name w:val="{name}"/>{more}</w:style>'
    code = f"<w:rPr>{face(CODE_FONT)}{half(points * CODE_RATIO)}</w:rPr>"
    styles = (
        f"<w:docDefaults><w:rPrDefault><w:rPr>{face(font)}{half(points)}</w:rPr></w:rPrDefault></w:docDefaults>"
        + f'<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/><w:pPr><w:spacing w:after="160" w:line="{round(spacing * 240)}" w:lineRule="auto"/></w:pPr><w:rPr>{face(font)}{half(points)}</w:rPr></w:style>'
        + "".join(style(f"Heading{k}", f"heading {k}", more=f'<w:basedOn w:val="Normal"/><w:pPr><w:keepNext/><w:outlineLvl w:val="{k - 1}"/></w:pPr><w:rPr>{face(font)}<w:b/>{half(points + max(1, 6 - k))}</w:rPr>') for k in range(1, 7))
        + style("Code", "Code", more=f'<w:basedOn w:val="Normal"/><w:pPr><w:spacing w:before="0" w:after="0"/><w:ind w:left="240"/></w:pPr>{code}') + style("CodeChar", "Code Char", "character", code) + style("Quote", "Quote", more='<w:basedOn w:val="Normal"/><w:pPr><w:ind w:left="360"/></w:pPr><w:rPr><w:i/></w:rPr>')
        + style("TableGrid", "Table Grid", "table", "<w:tblPr><w:tblBorders>" + "".join(f'<w:{side} w:val="single" w:sz="4" w:space="0" w:color="auto"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV")) + "</w:tblBorders></w:tblPr>")
    )
    section = f'<w:sectPr><w:pgSz w:w="{wide}" w:h="{high}"/><w:pgMar w:top="{MARGIN}" w:right="{MARGIN}" w:bottom="{MARGIN}" w:left="{MARGIN}" w:header="720" w:footer="720" w:gutter="0"/></w:sectPr>'
    levels = lambda ordered: "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{FORMATS[k % 3] if ordered else "bullet"}"/><w:lvlText w:val="{f"%{k + 1}." if ordered else "•◦‣"[k % 3]}"/><w:pPr><w:ind w:left="{720 * (k + 1)}" w:hanging="360"/></w:pPr></w:lvl>' for k in range(9))
    numbering = f'<w:abstractNum w:abstractNumId="0">{levels(False)}</w:abstractNum><w:abstractNum w:abstractNumId="1">{levels(True)}</w:abstractNum>' + "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{int(o)}"/>' + (f'<w:lvlOverride w:ilvl="0"><w:startOverride w:val="{s}"/></w:lvlOverride>' if o else "") + "</w:num>" for n, (o, s) in enumerate(lists, 1))
    core = {"title": "dc:title", "author": "dc:creator", "subject": "dc:subject", "keywords": "cp:keywords", "description": "dc:description", "category": "cp:category"}
    props = "".join(f"<{tag}>{escape(meta[k])}</{tag}>" for k, tag in core.items() if meta.get(k))
    links = "".join(f'<Relationship Id="rLink{k}" Type="{NS_R}/hyperlink" Target={quoteattr(t)} TargetMode="External"/>' for k, t in enumerate(rels, 1))
    links += "".join(f'<Relationship Id="rPic{n}" Type="{NS_R}/image" Target="media/image{n}.{suffix}"/>' for n, (_, suffix) in enumerate(pictures, 1))
    kinds = "".join(f'<Default Extension="{x}" ContentType="image/{x}"/>' for x in sorted({x for _, x in pictures}))
    return _zip({
        "[Content_Types].xml": f'<Types xmlns="{NS_T}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}' + "".join(f'<Override PartName="/word/{p}.xml" ContentType="{OFFICE}wordprocessingml.{t}+xml"/>' for p, t in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering"))) + '<Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{NS_P}"><Relationship Id="r1" Type="{NS_R}/officeDocument" Target="word/document.xml"/><Relationship Id="r2" Type="{NS_P}/metadata/core-properties" Target="docProps/core.xml"/></Relationships>',
        "docProps/core.xml": f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">{props}</cp:coreProperties>',
        "word/document.xml": f'<w:document xmlns:w="{NS_W}" xmlns:r="{NS_R}" xmlns:wp="{NS_D}wordprocessingDrawing" xmlns:a="{NS_D}main" xmlns:pic="{NS_D}picture"><w:body>{body}{section}</w:body></w:document>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{NS_P}"><Relationship Id="r1" Type="{NS_R}/styles" Target="styles.xml"/><Relationship Id="r2" Type="{NS_R}/numbering" Target="numbering.xml"/>{links}</Relationships>',
        "word/styles.xml": f'<w:styles xmlns:w="{NS_W}">{styles}</w:styles>',
        "word/numbering.xml": f'<w:numbering xmlns:w="{NS_W}">{numbering}</w:numbering>',
        **{f"word/media/image{n}.{suffix}": data for n, (data, suffix) in enumerate(pictures, 1)},
    })


def column_name(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


# A workbook's styles, by the kind of a cell: font, fill, whether text wraps.
LOOKS = {"plain": (0, 0), "heading": (1, 0), "head": (1, 2), "code": (2, 0), "link": (3, 0), "caption": (4, 0), "quote": (4, 0)}
FONTS = '<font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="{head}"/><name val="Calibri"/></font><font><sz val="10"/><name val="Consolas"/></font><font><u/><sz val="11"/><color rgb="FF0563C1"/><name val="Calibri"/></font><font><i/><sz val="10"/><name val="Calibri"/></font>'
FILLS = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFDDEBF7"/></patternFill></fill>'


def xlsx(sheets: list[tuple[str, list[dict]]], finder: Finder | None = None, warnings: list[str] | None = None) -> bytes:
    """A workbook of (name, cells); cells are dicts row_no (from 1), col_no (from 0), value, kind, and perhaps href and
    align. Numbers by a strict pattern in tables; cells that are links; pictures on rows of their own, made as tall."""
    warnings = warnings if warnings is not None else []
    number = re.compile(r"-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]+)?")
    sides = ("", "left", "center", "right")
    looks = {(kind, side): n for n, (kind, side) in enumerate((k, s) for k in LOOKS for s in sides)}
    xfs = "".join(f'<xf fontId="{LOOKS[k][0]}" fillId="{LOOKS[k][1]}" borderId="0" numFmtId="0" applyFont="1" applyFill="1" applyAlignment="1"><alignment vertical="top" wrapText="1"{f" horizontal={quoteattr(s)}" if s else ""}/></xf>' for k, s in looks)
    parts: dict[str, str | bytes] = {}
    media: list[tuple[bytes, str]] = []
    drawn: list[int] = []
    for n, (_, cells) in enumerate(sheets, 1):
        rows: dict[int, list[str]] = {}
        heights: dict[int, float] = {}
        widths: dict[tuple[int, bool], int] = {}
        links, anchors, rels = [], [], []
        heads = {c["row_no"] for c in cells if c["kind"] == "table" and c.get("head")}
        for c in sorted(cells, key=lambda c: (c["row_no"], c["col_no"])):
            ref, kind, href = f"{column_name(c['col_no'])}{c['row_no']}", c["kind"], c.get("href")
            if kind == "image":
                if picture := found(href or "", finder, warnings):
                    data, suffix, w, h = picture
                    ratio = min(1.0, BOX[0] / max(1, w), BOX[1] / max(1, h))
                    w, h = max(1, int(w * ratio)), max(1, int(h * ratio))
                    media.append((data, suffix))
                    anchors.append((c["row_no"] - 1, len(media), w, h))
                    heights[c["row_no"]] = max(15.0, h * PIXEL)
                    rows.setdefault(c["row_no"], [])
                    continue
                kind, href = "plain", None
            v = BAD.sub("", c["value"])[:32767]
            table = kind == "table"
            key = (c["col_no"], table)
            widths[key] = max(widths.get(key, 8), max(map(len, v.split("\n"))) + 2)
            look = looks["head" if c["row_no"] in heads else "link" if href else kind if kind in LOOKS else "plain", c.get("align") or ""]
            if href:
                links.append((ref, href))
            rows.setdefault(c["row_no"], []).append(f'<c r="{ref}" s="{look}"><v>{v}</v></c>' if table and number.fullmatch(v) else f'<c r="{ref}" s="{look}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
        first = min(cells, key=lambda c: c["row_no"], default=None)
        freeze = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>' if first and first["kind"] == "table" else ""
        final: dict[int, int] = {}
        for (col, table), w in widths.items():
            final[col] = max(final.get(col, 8), min(w, 60 if table or (col, True) in widths else 90))
        cols = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{w}" customWidth="1"/>' for k, w in sorted(final.items()))
        tall = lambda r: f' ht="{heights[r]:g}" customHeight="1"' if r in heights else ""
        rels += [f'<Relationship Id="rLink{k}" Type="{NS_R}/hyperlink" Target={quoteattr(t)} TargetMode="External"/>' for k, (_, t) in enumerate(links, 1)]
        tail = "<hyperlinks>" + "".join(f'<hyperlink ref="{ref}" r:id="rLink{k}"/>' for k, (ref, _) in enumerate(links, 1)) + "</hyperlinks>" if links else ""
        if anchors:
            drawn.append(n)
            tail += '<drawing r:id="rDraw"/>'
            rels.append(f'<Relationship Id="rDraw" Type="{NS_R}/drawing" Target="../drawings/drawing{n}.xml"/>')
            shape = lambda row, k, w, h: f'<xdr:oneCellAnchor><xdr:from><xdr:col>0</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{row}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from><xdr:ext cx="{w * UNITS}" cy="{h * UNITS}"/><xdr:pic><xdr:nvPicPr><xdr:cNvPr id="{k}" name="Picture {k}"/><xdr:cNvPicPr/></xdr:nvPicPr><xdr:blipFill><a:blip r:embed="rPic{k}"/><a:stretch><a:fillRect/></a:stretch></xdr:blipFill><xdr:spPr><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></xdr:spPr></xdr:pic><xdr:clientData/></xdr:oneCellAnchor>'
            parts[f"xl/drawings/drawing{n}.xml"] = f'<xdr:wsDr xmlns:xdr="{NS_D}spreadsheetDrawing" xmlns:a="{NS_D}main" xmlns:r="{NS_R}">' + "".join(shape(*a) for a in anchors) + "</xdr:wsDr>"
            parts[f"xl/drawings/_rels/drawing{n}.xml.rels"] = f'<Relationships xmlns="{NS_P}">' + "".join(f'<Relationship Id="rPic{k}" Type="{NS_R}/image" Target="../media/image{k}.{media[k - 1][1]}"/>' for _, k, _, _ in anchors) + "</Relationships>"
        if rels:
            parts[f"xl/worksheets/_rels/sheet{n}.xml.rels"] = f'<Relationships xmlns="{NS_P}">{"".join(rels)}</Relationships>'
        parts[f"xl/worksheets/sheet{n}.xml"] = f'<worksheet xmlns="{NS_S}" xmlns:r="{NS_R}">{freeze}{f"<cols>{cols}</cols>" if cols else ""}<sheetData>' + "".join(f'<row r="{r}"{tall(r)}>{"".join(cs)}</row>' for r, cs in sorted(rows.items())) + f"</sheetData>{tail}</worksheet>"
    ids = range(1, len(sheets) + 1)
    kinds = "".join(f'<Default Extension="{x}" ContentType="image/{x}"/>' for x in sorted({x for _, x in media}))
    overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{OFFICE}spreadsheetml.worksheet+xml"/>' for n in ids) + "".join(f'<Override PartName="/xl/drawings/drawing{n}.xml" ContentType="{OFFICE}drawing+xml"/>' for n in drawn)
    return _zip({
        "[Content_Types].xml": f'<Types xmlns="{NS_T}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}<Override PartName="/xl/workbook.xml" ContentType="{OFFICE}spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{OFFICE}spreadsheetml.styles+xml"/>{overrides}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{NS_P}"><Relationship Id="r1" Type="{NS_R}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{NS_S}" xmlns:r="{NS_R}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="r{n}"/>' for n, (name, _) in zip(ids, sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{NS_P}">' + "".join(f'<Relationship Id="r{n}" Type="{NS_R}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in ids) + f'<Relationship Id="rStyle" Type="{NS_R}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{NS_S}"><fonts count="5">{FONTS.format(head=14)}</fonts><fills count="3">{FILLS}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(looks)}">{xfs}</cellXfs></styleSheet>',
        **parts,
        **{f"xl/media/image{k}.{suffix}": data for k, (data, suffix) in enumerate(media, 1)},
    })
