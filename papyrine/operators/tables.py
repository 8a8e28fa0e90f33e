"""Workbooks, sheets, cells and Markdown tables; cells are rows (doc_id, sheet_no, sheet, row_no, col_no, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import clean_header, escape_cell, table_row

SHEET = ["doc_id", "sheet_no"]


def drop_empty(cells: DataFrame) -> DataFrame:
    """Without rows and then columns that hold nothing but nulls; the header row (row_no 0) doesn't count."""
    data = (F.col("row_no") > 0) & F.col("value").isNotNull()
    rows = Window.partitionBy(*SHEET, "row_no")
    kept = cells.withColumn("n", F.count(F.when(data, 1)).over(rows)).filter((F.col("row_no") == 0) | (F.col("n") > 0)).drop("n")
    cols = Window.partitionBy(*SHEET, "col_no")
    return kept.withColumn("n", F.count(F.when(data, 1)).over(cols)).filter("n > 0").drop("n")


def sheet_markdown(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet_no, sheet, markdown) of text cells; row 0 is the header. Columns are numbered after the empty ones went."""
    kept = drop_empty(cells)
    place = F.dense_rank().over(Window.partitionBy(*SHEET).orderBy("col_no"))
    kept = kept.withColumn("place", place)
    text = F.when(F.col("row_no") == 0, clean_header(F.col("value"), F.col("place"))).otherwise(escape_cell(F.coalesce("value", F.lit(""))))
    rows = kept.groupBy(*SHEET, "sheet", "row_no").agg(table_row(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda c: c["t"])).alias("line"), F.count(F.lit(1)).alias("width"))
    rule = table_row(F.array_repeat(F.lit("---"), F.col("width").cast("int")))
    line = F.when(F.col("row_no") == 0, F.concat("line", F.lit("\n"), rule)).otherwise(F.col("line"))
    return rows.groupBy(*SHEET, "sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("t")))), lambda r: r["t"]), "\n").alias("markdown"))


# Fixed value: what stands in place of an empty sheet.
EMPTY_SHEET = "> Sheet không có dữ liệu."


def workbook_markdown(cells: DataFrame, sheets: DataFrame | None = None, level: int = 2) -> DataFrame:
    """(doc_id, markdown): a heading and a table, or a note that there is none, for each sheet, in order.

    ``sheets`` (doc_id, sheet_no, sheet) names those without any cell too; by default they are those of the cells.
    """
    every = (cells if sheets is None else sheets).select(*SHEET, "sheet").distinct()
    said = every.join(sheet_markdown(cells).select(*SHEET, "markdown"), SHEET, "left")
    part = F.concat(F.lit("#" * max(1, min(6, level)) + " "), F.col("sheet"), F.lit("\n\n"), F.coalesce("markdown", F.lit(EMPTY_SHEET)))
    return said.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_no", part.alias("t")))), lambda s: s["t"]), "\n\n").alias("markdown"))


def split_level(blocks: DataFrame) -> DataFrame:
    """(doc_id, level): the shallowest heading level, or the next one if that occurs once and there is a next."""
    per = blocks.filter("kind = 'heading'").groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))
    levels = per.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("level", "n"))).alias("l"))
    return levels.select("doc_id", F.when((F.col("l")[0]["n"] == 1) & (F.size("l") > 1), F.try_element_at("l", F.lit(2))["level"]).otherwise(F.col("l")[0]["level"]).alias("level"))


def split_sheets(blocks: DataFrame, fallback: str = "Sheet1") -> DataFrame:
    """blocks(doc_id, seq, kind, level, text) plus sheet_no and sheet title; a sheet starts at each heading up to the
    split level, and sheets without a block besides their heading go."""
    at = split_level(blocks).withColumnRenamed("level", "cut")
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.col("kind") == "heading") & (F.col("level") <= F.col("cut"))
    cutting = blocks.join(at, "doc_id", "left").withColumn("starts", F.coalesce(starts, F.lit(False))).withColumn("sheet_no", F.sum(F.col("starts").cast("int")).over(order).cast("int"))
    whole = Window.partitionBy("doc_id", "sheet_no")
    titled = cutting.withColumn("title", F.coalesce(F.max(F.when(F.col("starts"), F.col("text"))).over(whole), F.lit(fallback))).withColumn("n", F.count(F.when(~F.col("starts"), 1)).over(whole))
    return titled.filter("n > 0").drop("n", "cut", "starts")


def column_widths(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet_no, col_no, width): the longest line plus 2 within 8 and 60, or 90 for prose without a table in the column."""
    longest = F.array_max(F.transform(F.split(F.coalesce("value", F.lit("")), "\n"), lambda x: F.length(x)))
    table = F.col("kind") == "table"
    per = cells.groupBy("doc_id", "sheet_no", "col_no").agg(F.max(F.when(table, longest)).alias("t"), F.max(F.when(~table, longest)).alias("p"))
    clamp = lambda c, cap: F.when(c.isNotNull(), F.greatest(F.least(c + 2, cap), F.lit(8)))
    return per.select("doc_id", "sheet_no", "col_no", F.greatest(clamp(F.col("t"), F.lit(60)), clamp(F.col("p"), F.when(F.col("t").isNull(), 90).otherwise(60))).alias("width"))


def fit_image(width: Column, height: Column) -> Column:
    """struct<width, height, row_height>: scaled down into 640 x 480; the row takes three quarters of a point a pixel, 15 at least."""
    ratio = F.least(F.lit(1.0), F.lit(640.0) / width, F.lit(480.0) / height)
    w, h = F.greatest(F.lit(1), F.floor(width * ratio)), F.greatest(F.lit(1), F.floor(height * ratio))
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"), F.greatest(F.lit(15.0), h * 0.75).alias("row_height"))


def freeze_rows(blocks: DataFrame) -> DataFrame:
    """(doc_id, sheet_no, freeze): whether the sheet's first block is a table."""
    return blocks.groupBy("doc_id", "sheet_no").agg((F.min_by("kind", "seq") == "table").alias("freeze"))
