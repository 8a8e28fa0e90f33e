"""Headings, outline trees and section extraction.

Documents are (doc_id, markdown); nodes are one row each with parent, level, title and a half-open range of lines.
Trees are built in one pass over a document's text, behind mapInArrow, so they need no shuffle; all else on them are
DataFrame expressions. As folds in expressions they took time with the square of a document's headings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from papyrine.functions.text import quote_path, slug, squeeze_blank_lines, strip
from papyrine.sources.scratch import written

HEADING_OR_FENCE = re.compile(r"^(?:[ \t]*(```|~~~)|(#{1,6})[ \t]+(.*))", re.M)
NODE = [("node_id", pa.string()), ("parent_id", pa.string()), ("level", pa.int32()), ("title", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
ROWS, CHARS = 10_000, 1 << 24  # of a batch that goes back


def unified(markdown: str | None) -> str:
    return re.sub(r"\r\n?", "\n", markdown or "")


def following(fence: str, mark: str) -> str:
    """The open fence after a mark; a fence closes with its own mark only and an open one ends with the text."""
    return mark if not fence else "" if fence == mark else fence


def heads(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(offset, line, level, title) of headings at column 0 outside fences; trailing # stay in the title."""
    fence, line, seen = "", 0, 0
    for m in HEADING_OR_FENCE.finditer(text):
        if m[1]:
            fence = following(fence, m[1])
        elif not fence:
            line, seen = line + text.count("\n", seen, m.start()), m.start()
            yield m.start(), line, len(m[2]), m[3].strip()


def tree_of(text: str) -> list[list]:
    """Nodes of a text, as NODE says, in one pass with the headings that are still open."""
    size, out, roots = text.count("\n") + 1, [], 0
    first = next(heads(text), None)
    if text[: first[0] if first else len(text)].strip():
        out.append(["1", None, 0, "", 0, first[1] if first else size])
        roots = 1
    open_: list[list] = []  # node, number of its children
    for _, line, level, title in heads(text):
        while open_ and open_[-1][0][2] >= level:
            open_.pop()[0][5] = line
        if open_:
            open_[-1][1] += 1
            up = open_[-1][0][0]
            node = [f"{up}.{open_[-1][1]}", up, level, title, line, size]
        else:
            roots += 1
            node = [str(roots), None, level, title, line, size]
        out.append(node)
        open_.append([node, 0])
    return out


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, node_id, parent_id, level, title, start, end).

    The parent is the nearest earlier heading of a smaller level, the end the next one of the same or a smaller level.
    A document is read once, in time and memory in proportion to its length. Text before the first heading is a node of
    level 0. Ids count siblings from 1, joined by dots.
    """
    schema = StructType([docs.schema["doc_id"], *from_arrow_schema(pa.schema(NODE))])
    names = ["doc_id", *[n for n, _ in NODE]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, tree = [], []
            for k, text in enumerate(b.column(1), 1):
                found = tree_of(unified(text.as_py()))
                tree += found
                owners += [k - 1] * len(found)
                if tree and (len(tree) >= ROWS or k == b.num_rows):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owners)), *[pa.array(c, t) for c, (_, t) in zip(zip(*tree), NODE)]], names)
                    owners, tree = [], []

    return docs.select("doc_id", "markdown").mapInArrow(run, schema)


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line, level, title) of headings at column 0 outside fences; trailing # stay in the title."""
    return nodes(docs).filter("level > 0").select("doc_id", F.col("start").alias("line"), "level", "title")


def promoted_text(text: str, shift: int | None) -> str:
    """Text with headings outside fences moved up by ``shift`` levels, not above 1."""
    fence = ""

    def up(m: re.Match) -> str:
        nonlocal fence
        if m[1]:
            fence = following(fence, m[1])
        return m[0] if m[1] or fence else "#" * max(1, len(m[2]) - shift) + " " + m[3]

    return HEADING_OR_FENCE.sub(up, text) if shift and shift > 0 else text


def section_texts(docs: DataFrame, chosen: DataFrame, shift: Column | None = None) -> DataFrame:
    """chosen (with doc_id, start, end) plus text: its lines, promoted, without outer and repeated blank lines.

    A document meets all its sections in one row, so that its text is moved and split once, not once a section.
    """
    given = [c for c in chosen.columns if c != "doc_id"]
    ask = F.struct(F.struct(*given).alias("row"), F.col("start").cast("int").alias("from"), F.col("end").cast("int").alias("to"), (shift if shift is not None else F.lit(0)).cast("int").alias("shift"))
    asked = chosen.groupBy("doc_id").agg(F.collect_list(ask).alias("asked"))
    schema = StructType([docs.schema["doc_id"], *[chosen.schema[c] for c in given], StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted, ends = b.column(2).values, b.column(2).offsets.to_pylist()
            rows, (a, z, up) = wanted.field("row").flatten(), (wanted.field(c) for c in ("from", "to", "shift"))
            owners, places, texts, chars = [], [], [], 0
            for k, text in enumerate(b.column(1)):
                lines = unified(text.as_py()).split("\n")
                for n in range(ends[k], ends[k + 1]):
                    texts.append(promoted_text("\n".join(lines[a[n].as_py() : z[n].as_py()]), up[n].as_py()))
                    owners.append(k)
                    places.append(n)
                    chars += len(texts[-1])
                    if len(texts) >= ROWS or chars >= CHARS or n == ends[-1] - 1:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owners)), *[r.take(pa.array(places)) for r in rows], pa.array(texts, pa.string())], schema.names)
                        owners, places, texts, chars = [], [], [], 0

    found = docs.select("doc_id", "markdown").join(asked, "doc_id").mapInArrow(run, schema)
    return found.withColumn("text", squeeze_blank_lines(F.regexp_replace("text", r"\A\n+|\n+\z", "")))


def cover(selected: DataFrame, known: DataFrame) -> DataFrame:
    """The selected known nodes that no selected ancestor covers: ancestors are exploded, so it is an equi anti join."""
    have = selected.select("doc_id", "node_id").distinct().join(known.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi")
    parts = F.split("node_id", r"\.")
    ups = have.select("doc_id", "node_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("up")).filter("up != node_id")
    covered = ups.join(have.select("doc_id", F.col("node_id").alias("up")), ["doc_id", "up"], "left_semi").select("doc_id", "node_id").distinct()
    return have.join(covered, ["doc_id", "node_id"], "left_anti")


def extract(docs: DataFrame, selected: DataFrame, tree: DataFrame | None = None, promoted: bool = True) -> DataFrame:
    """(doc_id, text): the covering sections in order of the document, moved up together so that the highest is level 1."""
    tree = tree if tree is not None else nodes(docs)
    chosen = tree.join(cover(selected, tree), ["doc_id", "node_id"], "left_semi")
    least = F.min(F.when(F.col("level") > 0, F.col("level"))).over(Window.partitionBy("doc_id"))
    chosen = chosen.withColumn("shift", F.coalesce(least - 1, F.lit(0)) if promoted else F.lit(0))
    texts = section_texts(docs, chosen, F.col("shift"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda s: s["text"]), "\n\n")
    return texts.filter("text != ''").groupBy("doc_id").agg(joined.alias("text"))


def split_sections(docs: DataFrame, selected: DataFrame, tree: DataFrame | None = None, promoted: bool = True) -> DataFrame:
    """(doc_id, node_id, title, text): each covering section on its own, moved up by its own level."""
    tree = tree if tree is not None else nodes(docs)
    chosen = tree.join(cover(selected, tree), ["doc_id", "node_id"], "left_semi").withColumn("shift", F.greatest(F.col("level") - 1, F.lit(0)) if promoted else F.lit(0))
    return section_texts(docs, chosen, F.col("shift")).select("doc_id", "node_id", "title", "text")


def listing(tree: DataFrame) -> DataFrame:
    """(doc_id, node_id, line): a printable outline."""
    wide = F.concat("node_id", F.repeat(F.lit(" "), F.greatest(F.lit(10) - F.length("node_id"), F.lit(0))))
    depth = F.size(F.split("node_id", r"\.")) - 1
    tag = F.when(F.col("level") > 0, F.concat(F.lit("H"), F.col("level").cast("string"))).otherwise("—")
    return tree.select("doc_id", "node_id", F.concat(wide, F.repeat(F.lit("  "), depth), F.col("title"), F.lit("  ["), tag, F.lit(", "), (F.col("end") - F.col("start")).cast("string"), F.lit(" dòng]")).alias("line"))


def visible(tree: DataFrame, needle: str) -> DataFrame:
    """Nodes whose title holds the needle, whatever the case, and their ancestors."""
    hit = tree.filter(F.lower("title").contains(needle.lower()))
    parts = F.split("node_id", r"\.")
    ids = hit.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("node_id")).distinct()
    return tree.join(ids, ["doc_id", "node_id"], "left_semi")


def locked(tree: DataFrame, checked: DataFrame) -> DataFrame:
    """Nodes below a checked one."""
    parts = F.split("node_id", r"\.")
    ups = tree.filter("parent_id is not null").select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("up"))
    return ups.join(checked.select("doc_id", F.col("node_id").alias("up")), ["doc_id", "up"], "left_semi").drop("up").distinct()


def asset_links(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, folder, name) of links and images to a file in a folder, decoded."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("markdown", F.lit(r"\]\(([^()\s/]+/[^()\s/]+)\)"), F.lit(1))).alias("ord", "href"))
    return found.select("doc_id", "ord", F.url_decode(F.substring_index("href", "/", 1)).alias("folder"), F.url_decode(F.substring_index("href", "/", -1)).alias("name"))


def relocate_assets(sections: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, used) of sections(doc_id, stem, text, ...) and assets(doc_id, folder, name, suffix): links to known
    assets point to the folder ``stem`` + suffix; other links stay. used(doc_id, stem, folder, name, target) is what has to be copied."""
    key = ["doc_id", "stem"]
    hrefs = sections.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\]\(([^()\s]+)\)"), F.lit(1)))).alias("href")).filter(F.col("href").contains("/"))
    linked = hrefs.select(*key, "href", F.substring_index("href", "/", 1).alias("folder"), F.url_decode(F.regexp_replace(F.regexp_replace("href", r"\A[^/]*/", ""), r"\+", "%2B")).alias("name"))
    found = linked.join(assets, ["doc_id", "folder", "name"]).withColumn("target", F.concat("stem", "suffix"))
    base = F.regexp_extract("name", r"([^/]+)\z", 1)
    moves = found.groupBy(*key).agg(F.collect_list(F.struct(F.concat(F.lit("]("), "href", F.lit(")")).alias("old"), F.concat(F.lit("]("), quote_path(F.concat("target", F.lit("/"), base)), F.lit(")")).alias("new"))).alias("moves"))
    # one pass over the text, split at its links, so that a new address is never taken for an old one
    parts = F.regexp_extract_all("text", F.lit(r"(?s)(\]\([^()\s]+\)|\]|[^\]]+)"), F.lit(1))
    new = lambda p: F.coalesce(F.try_element_at(F.map_from_entries("moves"), p), p)
    rewritten = F.when(F.col("moves").isNull(), F.col("text")).otherwise(F.array_join(F.transform(parts, new), ""))
    return sections.join(moves, key, "left").withColumn("text", rewritten).drop("moves"), found.select(*key, "folder", "name", "target").distinct()


def section_stems(chosen: DataFrame, documents: DataFrame, split: bool = False) -> DataFrame:
    """(doc_id, node_id, stem) of the file each of chosen(doc_id, node_id, title), which no other covers, goes to: its
    title's when sections are split or there is but one, else the document's, documents(doc_id, stem)."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("doc_id")) == 1
    return chosen.withColumn("alone", alone | F.lit(split)).join(documents.withColumnRenamed("stem", "own"), "doc_id").select("doc_id", "node_id", F.when(F.col("alone"), slug_or("title", "own")).otherwise(F.col("own")).alias("stem"))


def slug_or(title: str, fallback: str) -> Column:
    s = slug(F.col(title), "\x00")
    return F.when(s == "\x00", F.col(fallback)).otherwise(s)


def section_results(sections: DataFrame, add_title: bool = True) -> DataFrame:
    """(doc_id, node_id, status, text) of sections(doc_id, node_id, title, text): blank ones are skipped, others get their
    title as a heading unless they begin with one."""
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    headed = F.when(F.startswith(F.ltrim("text"), F.lit("#")) | ~F.lit(add_title), F.col("text")).otherwise(F.concat(F.lit("# "), "title", F.lit("\n\n"), "text"))
    return sections.select("doc_id", "node_id", F.when(blank, "skipped").otherwise("success").alias("status"), F.when(~blank, F.concat(F.regexp_replace(headed, r"\s+\z", ""), F.lit("\n"))).alias("text"))


def unknown(selected: DataFrame, tree: DataFrame) -> DataFrame:
    """The selected (doc_id, node_id) that the outline doesn't have."""
    return selected.join(tree.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")


def running_number(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows plus ``number``: from 1 within ``keys`` in ``order``. Rows are dealt by ranges of keys and order together, so
    that one very large group spreads over many tasks; each task's counts add up along the ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *keys, order).sortWithinPartitions(*keys, order)
    local = F.row_number().over(Window.partitionBy("part_", *keys).orderBy(order))
    # written: ranges come from a sample, which another run might draw otherwise
    numbered = written(dealt.withColumn("part_", F.spark_partition_id()).withColumn("local_", local), "numbered")
    sums = numbered.groupBy("part_", *keys).agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.join(sums.select("part_", *keys, before.alias("before_")), ["part_", *keys]).withColumn("number", F.col("before_") + F.col("local_")).drop("part_", "local_", "before_").select(*rows.columns, "number")


def unique_names(files: DataFrame, folder: str = "folder", stem: str = "stem", ext: str = "ext", order: str = "ord", taken: DataFrame | None = None) -> DataFrame:
    """files plus ``unique``: "stem", else "stem (n)" with the lowest free n, within a folder whatever the case.

    Only names that agree but for numbers in brackets, a family, can meet. Where all names of a family are one, the n-th
    file gets n - 1, by a running number. Families with several names, or with ``taken`` ones (folder, name), are folded
    in order, each in one task, with the next number to try for each name.
    """
    family = lambda name: F.lower(F.regexp_replace(name, r"( \(\d+\))+(?=(\.[^.]*)?$)", ""))
    whole = F.concat(F.col(stem), F.col(ext))
    named = files.withColumn("f_", F.coalesce(F.col(folder), F.lit(""))).withColumn("low_", F.lower(whole)).withColumn("family_", family(whole))
    kinds = named.groupBy("f_", "family_").agg((F.min("low_") != F.max("low_")).alias("mixed_"))
    if taken is not None:
        there = taken.select(F.coalesce(F.col("folder"), F.lit("")).alias("f_"), family(F.col("name")).alias("family_"), F.lower("name").alias("low_"))
        kinds = kinds.join(there.select("f_", "family_", F.lit(True).alias("there_")).distinct(), ["f_", "family_"], "left").select("f_", "family_", (F.col("mixed_") | F.coalesce("there_", F.lit(False))).alias("mixed_"))
    mixed = kinds.filter("mixed_").select("f_", "family_")
    plain = running_number(named.join(mixed, ["f_", "family_"], "left_anti").select(*named.columns), ["f_", "low_"], order)
    own = F.when(F.col("number") == 1, whole).otherwise(F.concat(F.col(stem), F.lit(" ("), (F.col("number") - 1).cast("string"), F.lit(")"), F.col(ext)))
    out = plain.withColumn("unique", own).select(*files.columns, "unique")
    rest = named.join(mixed, ["f_", "family_"], "left_semi").select("f_", "family_", F.lit(1).alias("turn_"), "low_", *[F.col(c) for c in files.columns])
    if taken is not None:
        before = there.join(mixed, ["f_", "family_"], "left_semi").select("f_", "family_", F.lit(0).alias("turn_"), "low_", *[F.lit(None).cast(files.schema[c].dataType).alias(c) for c in files.columns])
        rest = rest.unionByName(before)
    schema = StructType([*files.schema.fields, StructField("unique", StringType())])
    at, given = {c: k for k, c in enumerate(rest.columns)}, [*files.columns, "unique"]

    def fold(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("turn_", "ascending"), ("order_", "ascending")]).drop_columns(["order_"])
        used, following, names = set(), {}, []
        for turn, low, s, e in zip(*(rows.column(at[c]).to_pylist() for c in ("turn_", "low_", stem, ext))):
            name, n = (low if turn == 0 else f"{s}{e}"), following.get(low, 1)
            while turn and name.lower() in used:
                name, n = f"{s} ({n}){e}", n + 1
            following[low] = n
            used.add(name.lower())
            names.append(name)
        kept = rows.append_column("unique", pa.array(names, pa.string())).filter(pc.field("turn_") == 1)
        return kept.select(given)

    place = rest.select("*", F.col(order).alias("order_")) if not isinstance(files.schema[order].dataType, StructType) else rest.select("*", F.to_json(order).alias("order_"))
    return out.unionByName(place.groupBy("f_", "family_").applyInArrow(fold, schema))
