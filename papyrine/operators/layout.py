"""Page layout from characters, words and lines with coordinates: fonts, headings, paragraphs, lists, tables, columns.

chars(doc_id, page_no, line_no, char_no, char, size, font, top, bottom); words(doc_id, page_no, word_no, text, x0, x1, top,
bottom); lines(doc_id, page_no, seq, text, size, bold, top, bottom); boxes(doc_id, page_no, box_no, x0, top, x1, bottom).
Items are lines with a kind, or tables (kind "table", rows array<array<string>>). Windows and folds run within a page or
a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import clean_pdf, strip
from papyrine.sources.scratch import written

# What a list item or a numbered heading begins with, what no heading ends with, ratios and limits.
BULLET = r"\A([•●▪◦‣⁃*+]|[-–—])\s+(.+)\z"
ORDERED = r"\A(\d{1,3})[.)]\s+(.+)\z"
NUMBERED = r"\A(\d{1,3}(?:\.\d{1,3})+)\s+\S"
MARKER = r"\A([•●▪◦‣⁃*+]|[-–—]|\d{1,3}[.)])\z"
SENTENCE_END = r"[.,;:]\z"
HEADING_WORDS, HEADING_RATIO, PARAGRAPH_GAP = 20, 1.04, 1.55
GAP_RATIO, ROW_RATIO, LANE_SHARE, TABLE_ROWS = 1.2, 0.6, 0.6, 3
CROP_PADDING, CROP_LEAST, LONGEST = 3, 4, 10_000
PAGE = ["doc_id", "page_no"]


def lines_from_chars(chars: DataFrame) -> DataFrame:
    """Lines of characters: the largest size to a tenth, bold if most characters' fonts are; blank ones go."""
    heavy = F.lower("font").rlike("bold|black|heavy")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_no", "char"))), lambda c: c["char"]), "")
    per = chars.groupBy(*PAGE, F.col("line_no").alias("seq")).agg(
        clean_pdf(text).alias("text"), F.max(F.bround("size", 1)).alias("size"), (2 * F.count_if(heavy) > F.count(F.lit(1))).alias("bold"), F.min("top").alias("top"), F.max("bottom").alias("bottom")
    )
    return per.filter("text != ''")


def doc_sizes(lines: DataFrame) -> DataFrame:
    """(doc_id, body, levels): the size, to a tenth, that most letters have, of equals the one seen first; and the
    levels of clearly larger sizes, largest first, six at most. One row a document from one pass over the lines."""
    per = lines.groupBy("doc_id", F.bround("size", 1).alias("s")).agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page_no", "seq")).alias("first"))
    docs = per.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "s")).alias("best"), F.sort_array(F.collect_set("s"), False).alias("sizes"))
    large = F.filter("sizes", lambda s: s >= F.col("best.s") * HEADING_RATIO)
    return docs.select("doc_id", F.col("best.s").alias("body"), F.map_from_arrays(large, F.transform(large, lambda s, k: F.least(F.lit(6), k + 1))).alias("levels"))


def body_size(lines: DataFrame) -> DataFrame:
    return doc_sizes(lines).select("doc_id", "body")


def heading_sizes(lines: DataFrame) -> DataFrame:
    """(doc_id, size, level)"""
    return doc_sizes(lines).select("doc_id", F.explode("levels").alias("size", "level"))


def classify(lines: DataFrame) -> DataFrame:
    """lines plus kind (bullet, heading, ordered, text) and level; the first that fits counts. A heading is short and of
    a larger size, or bold without a sentence's end; numbers before it deepen it."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    short = words <= HEADING_WORDS
    by_size = F.try_element_at("levels_", F.bround("size", 1))
    deepest = F.coalesce(F.array_max(F.map_values("levels_")), F.lit(0))
    run_in = F.coalesce("bold", F.lit(False)) & short & ~F.col("text").rlike(SENTENCE_END)
    level = F.coalesce(by_size, F.when(run_in, F.least(F.lit(6), deepest + 1)))
    number = F.regexp_extract("text", NUMBERED, 1)
    depth = F.when(number != "", F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1))
    kind = F.when(F.col("text").rlike(BULLET), "bullet").when(level.isNotNull() & short, "heading").when(F.col("text").rlike(ORDERED), "ordered").otherwise("text")
    told = lines.join(doc_sizes(lines).select("doc_id", F.col("levels").alias("levels_")), "doc_id").withColumn("kind", kind)
    return told.withColumn("level", F.when(F.col("kind") == "heading", F.greatest(level, F.coalesce(depth, F.lit(1)))).cast("int")).drop("levels_")


def paragraphs(items: DataFrame) -> DataFrame:
    """items(doc_id, page_no, seq, kind, text, top, bottom) plus para: text lines of a page that follow closely share a number."""
    order = Window.partitionBy(*PAGE).orderBy("seq")
    height = F.greatest(F.lit(1.0), F.lag("bottom").over(order) - F.lag("top").over(order))
    gap = F.col("top") - F.lag("bottom").over(order)
    new = (F.col("kind") != "text") | F.lag("kind").over(order).isNull() | (F.lag("kind").over(order) != "text") | (gap > PARAGRAPH_GAP * height)
    return items.withColumn("new", new.cast("int")).withColumn("para", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new")


def list_blocks(items: DataFrame) -> DataFrame:
    """items plus list_no: neighbouring list items share a list, across pages too."""
    order = Window.partitionBy("doc_id").orderBy("page_no", "seq")
    item = F.col("kind").isin("bullet", "ordered")
    new = item & ~F.coalesce(F.lag("kind").over(order).isin("bullet", "ordered"), F.lit(False))
    return items.withColumn("new", new.cast("int")).withColumn("list_no", F.when(item, F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))).drop("new")


def table_markdown(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: the first row is the header, rows are padded, pipes escaped."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)), "\n")


def render(items: DataFrame) -> DataFrame:
    """(doc_id, markdown) of items with kind and level (tables with ``text``): a blank line between blocks."""
    kinds = list_blocks(paragraphs(items))
    head = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")
    number = F.regexp_extract("text", ORDERED, 1).cast("int").cast("string")
    shown = F.when(F.col("kind") == "heading", head).when(F.col("kind") == "bullet", F.concat(F.lit("- "), F.regexp_extract("text", BULLET, 2))).when(F.col("kind") == "ordered", F.concat(number, F.lit(". "), F.regexp_extract("text", ORDERED, 2))).otherwise(F.col("text"))
    key = F.when(F.col("list_no").isNotNull(), F.struct(F.lit(-1).alias("p"), F.col("list_no").alias("k"))).otherwise(F.struct(F.col("page_no").alias("p"), F.col("para").alias("k")))
    parts = kinds.withColumn("shown", shown).groupBy("doc_id", key.alias("key")).agg(F.array_sort(F.collect_list(F.struct("page_no", "seq", "shown"))).alias("l"))
    shown = F.transform("l", lambda x: x["shown"])
    text = F.when(F.col("key.p") < 0, F.array_join(shown, "\n")).otherwise(F.array_join(shown, " "))
    blocks = parts.select("doc_id", F.struct(F.col("l")[0]["page_no"].alias("p"), F.col("l")[0]["seq"].alias("s"), text.alias("t")).alias("b")).filter(strip(F.col("b.t")) != "")
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["t"]), "\n\n").alias("markdown"))


def blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, markdown): lines as Markdown blocks in reading order."""
    return render(classify(lines))


def with_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Items of classified lines and tables(doc_id, page_no, top, rows): by place on the page, a line before a table at the same height."""
    kinds = lines.select(*PAGE, "seq", "text", "kind", "level", "top", "bottom", F.lit(0).alias("rank"))
    extra = tables.select(*PAGE, F.lit(0).cast(lines.schema["seq"].dataType).alias("seq"), table_markdown(F.col("rows")).alias("text"), F.lit("table").alias("kind"), F.lit(None).cast("int").alias("level"), F.col("top").cast(lines.schema["top"].dataType).alias("top"), F.col("top").cast(lines.schema["bottom"].dataType).alias("bottom"), F.lit(1).alias("rank"))
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("top", "rank", "seq"))
    return kinds.unionByName(extra).withColumn("seq", order).drop("rank")


def ruled_tables(words: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page_no, box_no, top, rows) of tables(doc_id, page_no, box_no, x0, top, x1, bottom, bounds) that rule
    their columns but not their rows: the words inside, by their middles, on rows that each word's own height closes."""
    w, b = words.alias("w"), tables.filter(F.size("bounds") >= 3).alias("b")
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    inside = (F.col("w.doc_id") == F.col("b.doc_id")) & (F.col("w.page_no") == F.col("b.page_no")) & x.between(F.col("b.x0") - 1, F.col("b.x1") + 1) & y.between(F.col("b.top") - 1, F.col("b.bottom") + 1)
    placed = w.join(b, inside).select("w.doc_id", "w.page_no", "b.box_no", F.col("b.top").alias("box_top"), F.col("b.bounds").alias("bounds"), "w.word_no", "w.text", "w.x0", "w.x1", "w.top", "w.bottom")
    rows = printed_rows(placed, own_height=True, key=[*PAGE, "box_no"])
    column = ruled_column((F.col("x0") + F.col("x1")) / 2, F.col("bounds"))
    return _cells(rows.withColumn("col", column).withColumn("width", F.size("bounds") - 1), [*PAGE, "box_no"], "box_top")


def _cells(words: DataFrame, key: list[str], top: str, by: tuple[str, ...] = ("mid", "x0", "word_no")) -> DataFrame:
    """(key, top, rows) of words with row_no, col (null: in no column) and width, in order ``by``; wrapped rows folded."""
    said = lambda cells, k: strip(F.array_join(F.transform(F.filter(cells, lambda c: c["col"] == k), lambda c: c["text"]), " "))
    each = words.groupBy(*key, "row_no").agg(F.array_sort(F.collect_list(F.struct(*by, "col", "text"))).alias("cells"), F.first("width").alias("width"), F.min(top).alias("top"))
    rows = each.select(*key, "row_no", "top", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: said(F.col("cells"), k)).alias("cells"))
    folded = merge_wrapped(rows.withColumnRenamed("top", "top_"), key)
    return folded.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("own", "cells"))), lambda r: r["cells"]).alias("rows")).join(rows.groupBy(*key).agg(F.min("top").alias("top")), key)


def read_items(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, tables) of recognised words: runs of rows with gaps that share lanes are tables, all other rows lines.

    lines have no weight, and the upper median of their words' heights as size; tables(doc_id, page_no, run, top, rows).
    """
    rows = written(printed_rows(words), "rows")  # read by each of the steps below
    gaps = written(row_gaps(rows), "gaps")
    every = rows.select(*PAGE, "row_no").distinct().join(gaps.select(*PAGE, "row_no", F.lit(True).alias("has_gap")).distinct(), [*PAGE, "row_no"], "left").withColumn("has_gap", F.coalesce("has_gap", F.lit(False)))
    runs = table_runs(every).filter("run is not null").select(*PAGE, "row_no", "run")
    lanes = shared_lanes(gaps.join(runs, [*PAGE, "row_no"]), runs).groupBy(*PAGE, "run").agg(F.array_sort(F.collect_list("lane")).alias("lanes"))
    told = written(rows.join(runs.join(lanes, [*PAGE, "run"]), [*PAGE, "row_no"], "left"), "placed")
    lane = lane_column((F.col("x0") + F.col("x1")) / 2, F.col("lanes"))
    tables = _cells(told.filter("run is not null").withColumn("col", lane).withColumn("width", F.size("lanes") + 1).withColumn("top_", F.col("top")), [*PAGE, "run"], "top_", ("x0", "mid", "word_no"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("x0", "mid", "word_no", "text"))), lambda w: w["text"])
    heights = F.array_sort(F.collect_list(F.greatest(F.lit(1.0), F.col("bottom") - F.col("top"))))
    lines = told.filter("run is null").groupBy(*PAGE, F.col("row_no").alias("seq")).agg(clean_pdf(F.array_join(in_order, " ")).alias("text"), F.element_at(heights, (F.floor(F.size(heights) / 2) + 1).cast("int")).alias("size"), F.lit(False).alias("bold"), F.min("top").alias("top"), F.max("bottom").alias("bottom")).filter("text != ''")
    return lines, tables


def read_markdown(words: DataFrame) -> DataFrame:
    """(doc_id, markdown) of recognised words: lines with their sizes put into bands, tables in their places."""
    lines, tables = read_items(words)
    return render(with_tables(classify(quantise(lines)), tables))


def crops(rows: DataFrame, scale: float = 1.0, width: int | None = None, height: int | None = None) -> DataFrame:
    """(doc_id, page_no, row_no, crop, left, top, right, bottom, words) in pixels: a row's words up to the next wide gap,
    with a margin, cut to the picture; those a recogniser could not read (under four pixels) have no box."""
    row = [*PAGE, "row_no"]
    order = Window.partitionBy(*row).orderBy("x0", "word_no")
    told = rows.join(row_height(rows), row)
    new = F.coalesce(F.col("x0") - F.lag("x1").over(order) > GAP_RATIO * F.col("h"), F.lit(False))
    told = told.withColumn("new", new.cast("int")).withColumn("crop", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    pixel = lambda c: (c * F.lit(scale)).cast("int")
    edge = lambda c, most: F.least(c, F.lit(most)) if most is not None else c
    per = told.groupBy(*row, "crop").agg(
        F.greatest(F.lit(0), pixel(F.min("x0") - CROP_PADDING)).alias("left"), F.greatest(F.lit(0), pixel(F.min("top") - CROP_PADDING)).alias("top"),
        edge(pixel(F.max("x1") + CROP_PADDING), width).alias("right"), edge(pixel(F.max("bottom") + CROP_PADDING), height).alias("bottom"),
        F.array_sort(F.collect_list(F.struct("x0", "word_no", "text", "x1", F.col("top").alias("word_top"), F.col("bottom").alias("word_bottom")))).alias("words"),
    )
    large = (F.col("right") - F.col("left") >= CROP_LEAST) & (F.col("bottom") - F.col("top") >= CROP_LEAST)
    return per.select(*row, "crop", *[F.when(large, F.col(c)).alias(c) for c in ("left", "top", "right", "bottom")], "words")


def respell(crops: DataFrame) -> DataFrame:
    """(doc_id, page_no, row_no, crop, place, text, x0, x1, top, bottom) of crops with ``reading``, a second reading.

    A list marker is kept from the first reading. As many words as before keep their boxes; otherwise one box takes
    the whole reading. Without a reading, or with a blank one, words stay.
    """
    w = F.col("words")
    marker = w[0]["text"]
    said = strip(F.coalesce("reading", F.lit("")))
    rest = F.when(F.startswith(said, marker), F.substring(said, F.length(marker) + 1, F.length(said))).otherwise(said)
    text = F.when(said == "", "").when(marker.rlike(MARKER), F.concat(marker, F.lit(" "), F.ltrim(rest))).otherwise(said)
    new = F.split(F.trim(text), r"\s+")
    box = lambda text, g: F.struct(text.alias("text"), g["x0"].alias("x0"), g["x1"].alias("x1"), g["word_top"].alias("top"), g["word_bottom"].alias("bottom"))
    whole = F.array(F.struct(text.alias("text"), F.array_min(F.transform(w, lambda g: g["x0"])).alias("x0"), F.array_max(F.transform(w, lambda g: g["x1"])).alias("x1"), F.array_min(F.transform(w, lambda g: g["word_top"])).alias("top"), F.array_max(F.transform(w, lambda g: g["word_bottom"])).alias("bottom")))
    out = F.when(text == "", F.transform(w, lambda g: box(g["text"], g))).when(F.size(new) == F.size(w), F.transform(F.arrays_zip(new.alias("t"), w.alias("g")), lambda x: box(x["t"], x["g"]))).otherwise(whole)
    return crops.select(*PAGE, "row_no", "crop", F.posexplode(out).alias("place", "b")).select(*PAGE, "row_no", "crop", "place", "b.*")


def refine(words: DataFrame, readings: DataFrame) -> DataFrame:
    """words(doc_id, page_no, word_no, text, x0, x1, top, bottom) as a second reader spells them: readings(doc_id, page_no,
    row_no, crop, reading) of the pictures that ``crops`` cuts out; where there is none, words stay."""
    key = [*PAGE, "row_no", "crop"]
    read = respell(crops(printed_rows(words)).join(readings.select(*key, "reading"), key, "left"))
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("row_no", "crop", "place")) - 1
    return read.select(*PAGE, number.alias("word_no"), "text", "x0", "x1", "top", "bottom")


def fill_scanned(pages: DataFrame, lines: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, tables): those pages that hold next to no text take what a recogniser read on them, if it read anything."""
    found, tables = read_items(words.join(blank_pages(pages, lines), PAGE, "left_semi"))
    done = found.select(*PAGE).unionByName(tables.select(*PAGE)).distinct()
    kept = lines.join(done, PAGE, "left_anti").select(*PAGE, "seq", "text", "size", "bold", "top", "bottom")
    return kept.unionByName(quantise(found).select(*kept.columns)), tables


def outside_boxes(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose centre is in no box of their page (borders count as inside)."""
    w, b = words.alias("w"), boxes.alias("b")
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    return w.join(b, (F.col("w.doc_id") == F.col("b.doc_id")) & (F.col("w.page_no") == F.col("b.page_no")) & x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.top"), F.col("b.bottom")), "left_anti")


def column_bounds(rules: DataFrame) -> DataFrame:
    """(doc_id, page_no, bounds): distinct edges to a tenth, in order, where there are three or more."""
    return rules.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_set(F.bround("x", 1))).alias("bounds")).filter(F.size("bounds") >= 3)


def ruled_column(centre: Column, bounds: Column) -> Column:
    """The first closed interval of bounds that holds the centre, from 0; null outside."""
    spans = F.sequence(F.lit(1), F.size(bounds) - 1)
    return F.try_element_at(F.filter(spans, lambda k: centre.between(F.element_at(bounds, k), F.element_at(bounds, k + 1))), F.lit(1)) - 1


def lane_column(centre: Column, lanes: Column) -> Column:
    return F.size(F.filter(lanes, lambda c: c <= centre))


def printed_rows(words: DataFrame, ratio: float = ROW_RATIO, own_height: bool = False, key: list[str] | None = None) -> DataFrame:
    """words plus mid and row_no: a row takes words while their middle is near that of its first word, by the height of
    that word or (``own_height``) of the word itself. A fold finds where rows start; the words travel with it."""
    key = key or PAGE
    rest = [c for c in words.columns if c not in (*key, "x0", "word_no")]
    item = F.struct(((F.col("top") + F.col("bottom")) / 2).alias("mid"), "x0", "word_no", *rest)
    pages = words.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("w"))
    height = lambda x: F.greatest(F.lit(1.0), x["bottom"] - x["top"])
    start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("mid"), F.lit(-1.0).alias("h"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["h"] < 0) | (x["mid"] - acc["mid"] > F.lit(ratio) * (height(x) if own_height else acc["h"]))
        return F.struct((acc["k"] + 1).alias("k"), F.when(new, x["mid"]).otherwise(acc["mid"]).cast("double").alias("mid"), F.when(new, height(x)).otherwise(acc["h"]).cast("double").alias("h"), F.when(new, F.array_append(acc["starts"], acc["k"])).otherwise(acc["starts"]).alias("starts"))

    found = pages.withColumn("starts", F.aggregate("w", start, step, lambda a: a["starts"]))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("w")))
    rows = F.transform(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b")), lambda r: F.slice("w", r["a"] + 1, r["b"] - r["a"]))
    return found.select(*key, F.posexplode(rows).alias("row_no", "row")).select(*key, "row_no", F.explode("row").alias("word_")).select(*key, "word_.*", "row_no")


def row_height(rows: DataFrame) -> DataFrame:
    """(doc_id, page_no, row_no, h): the upper median of the heights of a row's words."""
    heights = F.array_sort(F.collect_list(F.greatest(F.lit(1.0), F.col("bottom") - F.col("top"))))
    return rows.groupBy(*PAGE, "row_no").agg(heights.alias("hs")).select(*PAGE, "row_no", F.element_at("hs", (F.floor(F.size("hs") / 2) + 1).cast("int")).alias("h"))


def row_gaps(words: DataFrame, ratio: float = GAP_RATIO) -> DataFrame:
    """(doc_id, page_no, row_no, left, right): gaps wider than 1.2 times the row's upper median height."""
    row = [*PAGE, "row_no"]
    order = Window.partitionBy(*row).orderBy("x0", "word_no")
    return words.withColumn("next", F.lead("x0").over(order)).join(row_height(words), row).filter(F.col("next") - F.col("x1") > ratio * F.col("h")).select(*row, F.col("x1").alias("left"), F.col("next").alias("right"))


def shared_lanes(gaps: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, page_no, run, lane): middles of stretches that gaps of enough rows of a table run cover.

    Gap ends are +1 and -1 in a sweep along x; stretches with at least max(2, round(0.6 * rows)) are merged.
    """
    key = ["doc_id", "page_no", "run"]
    need = rows.groupBy(*key).agg(F.countDistinct("row_no").alias("n")).select(*key, F.greatest(F.lit(2), F.bround(LANE_SHARE * F.col("n"))).alias("need"))
    ends = gaps.select(*key, F.explode(F.array(F.struct(F.col("left").alias("x"), F.lit(1).alias("d")), F.struct(F.col("right").alias("x"), F.lit(-1).alias("d")))).alias("e")).groupBy(*key, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy(*key).orderBy("x")
    sweep = ends.withColumn("c", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("x").over(order)).join(need, key)
    on = sweep.withColumn("on", (F.col("c") >= F.col("need")) & F.col("to").isNotNull())
    on = on.withColumn("new", (F.col("on") & ~F.coalesce(F.lag("on").over(order), F.lit(False))).cast("int")).withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return on.filter("on").groupBy(*key, "k").agg(((F.min("x") + F.max("to")) / 2).alias("lane")).drop("k")


def table_runs(rows: DataFrame) -> DataFrame:
    """rows(doc_id, page_no, row_no, has_gap) plus run: runs of three or more rows with gaps; null elsewhere. Whether a run
    is a table is for its lanes to say."""
    order = Window.partitionBy("doc_id", "page_no").orderBy("row_no")
    new = F.col("has_gap") & ~F.coalesce(F.lag("has_gap").over(order), F.lit(False))
    run = rows.withColumn("new", new.cast("int")).withColumn("run", F.when(F.col("has_gap"), F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")))
    return run.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page_no", "run"))).withColumn("run", F.when(F.col("n") >= TABLE_ROWS, F.col("run"))).drop("n", "new")


def merge_wrapped(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """rows(doc_id, table_no, row_no, cells): a row with an empty first cell and some text joins the row above, cell by cell."""
    key = key or ["doc_id", "table_no"]
    order = Window.partitionBy(*key).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    wrapped = (F.col("cells")[0] == "") & F.exists("cells", lambda c: c != "")
    own = rows.withColumn("own", F.sum(F.when(wrapped, 0).otherwise(1)).over(order).cast("int"))
    whole = own.groupBy(*key, "own").agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("r"))
    said = lambda k: F.array_join(F.filter(F.transform("r", lambda x: F.get(x["cells"], k)), lambda c: c.isNotNull() & (c != "")), "\n")
    return whole.select(*key, "own", F.transform(F.sequence(F.lit(0), F.size(F.col("r")[0]["cells"]) - 1), said).alias("cells"))


def median_height(lines: DataFrame) -> DataFrame:
    """(doc_id, median): the smallest size with half of all letters at or below it."""
    order = Window.partitionBy("doc_id").orderBy("size")
    per = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n"))
    run = per.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy("doc_id")))
    return run.filter(2 * F.col("upto") >= F.col("all")).groupBy("doc_id").agg(F.min("size").alias("median"))


def quantise(lines: DataFrame) -> DataFrame:
    """lines with sizes of recognised text put into bands: up to 1.2 medians is the median, else steps of a quarter."""
    band = 0.25 * F.col("median")
    return lines.join(median_height(lines), "doc_id").withColumn("size", F.when(F.col("size") <= 1.2 * F.col("median"), F.col("median")).otherwise(F.bround(F.col("size") / band) * band)).drop("median")


def blank_pages(pages: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """Pages whose items hold fewer than 12 characters: candidates for recognition."""
    sums = items.groupBy("doc_id", "page_no").agg(F.sum(F.length("text")).alias("n"))
    return pages.join(sums, ["doc_id", "page_no"], "left").filter(F.coalesce("n", F.lit(0)) < least).select("doc_id", "page_no")


def collapsed(rows: Column) -> Column:
    return F.exists(rows, lambda r: F.exists(r, lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) >= 2))


def picture_scale(width: Column, height: Column, dpi: float = 300.0) -> Column:
    """Pixels a point of a page's picture; the longest side has at most 10 000 pixels."""
    scale = F.lit(dpi / 72)
    return F.least(scale, F.lit(float(LONGEST)) / F.greatest(width, height))


def tesseract_words(pages: DataFrame, least_confidence: float = 10.0) -> DataFrame:
    """(doc_id, page_no, word_no, text, x0, x1, top, bottom) of pages(doc_id, page_no, tsv, scale): words of level 5 with
    text and enough confidence, pixels over scale; a page whose header lacks a column has no rows."""
    need = ["level", "left", "top", "width", "height", "conf", "text"]
    head = F.split(F.regexp_replace(F.substring_index("tsv", "\n", 1), "\r", ""), "\t", -1)
    fields = pages.withColumn("head", head).filter(F.size(F.array_except(F.array(*[F.lit(x) for x in need]), F.col("head"))) == 0).select("*", F.posexplode(F.split("tsv", "\r?\n", -1)).alias("word_no", "line")).filter("word_no > 0").withColumn("f", F.split("line", "\t", -1))
    get = lambda name: F.try_element_at("f", F.array_position("head", F.lit(name)).cast("int"))
    values = fields.filter(F.size("f") >= F.size("head")).select("doc_id", "page_no", "word_no", "scale", F.trim(get("text")).alias("text"), get("level").alias("level"), *[get(n).try_cast("double").alias(n) for n in ("conf", "left", "top", "width", "height")])
    good = values.filter((F.col("level") == "5") & (F.col("conf") >= least_confidence) & (F.col("text") != "") & F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull())
    return good.select("doc_id", "page_no", "word_no", "text", (F.col("left") / F.col("scale")).alias("x0"), ((F.col("left") + F.col("width")) / F.col("scale")).alias("x1"), (F.col("top") / F.col("scale")).alias("top"), ((F.col("top") + F.col("height")) / F.col("scale")).alias("bottom"))
