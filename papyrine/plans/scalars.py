"""Queries of the scalar functions and of the smaller operators, each over a whole table, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import text as tx
from papyrine.operators import html, layout, markdown, outline, tables
from papyrine.plans.catalog import ITEMS, LINES, TREE, WORDS, big, geography, items, order_lines, order_words, query, read, region_docs
from papyrine.sources.files import first_spelling


def part(spark: SparkSession, d: str, **columns) -> DataFrame:
    """p_partkey and the given columns over the table part; text is a Spark SQL expression."""
    return read(spark, d, "part").select("p_partkey", *[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


# --- names and text --------------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, substr(regexp_replace(regexp_replace(' .' || p_name || ' <' || p_type || '>:*' || chr(7) || '. ', '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 120) AS name FROM part""")
def attachment_names(spark, d):
    return part(spark, d, x="concat(' .', p_name, ' <', p_type, '>:*', char(7), '. ')").select("p_partkey", tx.attachment_name(F.col("x")).alias("name"))


@query(r"""WITH x AS (SELECT p_partkey, ' ' || p_name || chr(1) || chr(9) || '  ' || chr(12) || p_type || chr(11) || 'z' || chr(10) AS t FROM part)
    SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS pdf, regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS docx,
        regexp_replace(regexp_replace(t, '[\x0b\x0c]', chr(10), 'g'), '[\x00-\x08\x0e-\x1f]', '', 'g') AS xlsx FROM x""")
def clean_controls(spark, d):
    t = F.col("t")
    rows = part(spark, d, t="concat(' ', p_name, char(1), char(9), '  ', char(12), p_type, char(11), 'z', char(10))")
    return rows.select("p_partkey", tx.clean_pdf(t).alias("pdf"), tx.clean_docx(t).alias("docx"), tx.clean_xlsx(t).alias("xlsx"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE repeat(' ', p_size % 3) || '**' || p_brand || '**' || repeat(' ', CAST(p_partkey % 2 AS INT)) END AS bold FROM part""")
def emphasis_wrap(spark, d):
    return part(spark, d, x="CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE concat(repeat(' ', p_size % 3), p_brand, repeat(' ', cast(p_partkey % 2 as int))) END").select("p_partkey", tx.wrap(F.col("x"), "**").alias("bold"))


@query("""SELECT p_partkey, '    ' || p_name || chr(10) || chr(10) || '    ' || p_type || chr(10) || '    x' AS indented FROM part""")
def indent_lines(spark, d):
    return part(spark, d, x="concat(p_name, '\n\n', p_type, '\nx')").select("p_partkey", tx.indent_lines(F.col("x"), "    ").alias("indented"))


@query(r"""SELECT p_partkey, '*' || p_name || '_\a#<' || p_type || '>\"' AS plain FROM part""")
def unescape_marks(spark, d):
    x = F.concat(F.lit("\\*"), "p_name", F.lit("\\_\\a\\#\\<"), "p_type", F.lit('\\>\\"'))
    return part(spark, d, x=x).select("p_partkey", tx.unescape(F.col("x")).alias("plain"))


@query("""SELECT p_partkey, p_brand || CASE p_partkey % 4 WHEN 1 THEN ' b' ELSE '.md' END AS target FROM part""")
def link_targets(spark, d):
    x = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(' ', p_brand, '.md \"t x\"') WHEN 1 THEN concat('<', p_brand, ' b>') WHEN 2 THEN concat(p_brand, '.md ''t \"q\" y''') ELSE concat(p_brand, '.md') END")
    return part(spark, d, x=x).select("p_partkey", tx.link_target(F.col("x")).alias("target"))


@query("""SELECT p_partkey, replace(p_type, ' ', '%20') || '/%C3%BC~%2A%26%2B.png' AS quoted FROM part""")
def quote_paths(spark, d):
    return part(spark, d, x="concat(p_type, '/ü~*&+.png')").select("p_partkey", tx.quote_path(F.col("x")).alias("quoted"))


@query("""SELECT p_partkey, p_name || '.txt' AS base FROM part""")
def base_names(spark, d):
    x = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("C:\\d r\\")).when(F.col("p_partkey") % 3 == 1, F.lit("/a/b/")).otherwise(F.lit("")), "p_name", F.lit(".txt"), F.when(F.col("p_partkey") % 2 == 0, F.lit("/")).otherwise(F.lit("")))
    return part(spark, d, x=x).select("p_partkey", tx.base_name(F.col("x")).alias("base"))


HEADS = ["255044462D312E", "504B03041400", "7B5C727466", "89504E470D0A1A", "FFD8FFE0", "474946383961", "D0CF11E0A1B1", "20200A3C21444F43545950452068746D6C3E", "3C48544D4C3E", "746578743C68746D6C3E", "2550444600"]


@query("""SELECT p_partkey, ['.pdf', '.zip', '.rtf', '.png', '.jpg', '.gif', '.bin', '.html', '.html', '.dat', '.dat'][p_partkey % 11 + 1] AS suffix, p_partkey % 11 = 0 AS pdf FROM part""")
def content_suffix(spark, d):
    data = F.unhex(F.element_at(F.array(*map(F.lit, HEADS)), (F.col("p_partkey") % 11 + 1).cast("int")))
    return part(spark, d, x=data).select("p_partkey", tx.suffix_from_content(F.col("x")).alias("suffix"), tx.looks_like_pdf(F.col("x")).alias("pdf"))


@query("""SELECT p_partkey, ['.pdf', '.doc', '.docx', '.xls', '.ppt', ''][p_partkey % 6 + 1] AS suffix FROM part""")
def program_suffixes(spark, d):
    x = F.expr("concat(element_at(array('AcroExch.Document', 'WORD.Document', 'Word.OpenXMLDocument', 'Excel.Sheet', 'PowerPoint.Show', 'Visio'), cast(p_partkey % 6 + 1 as int)), '.', p_size, CASE WHEN p_size % 2 = 0 THEN '.x' ELSE '' END)")
    return part(spark, d, x=x).select("p_partkey", tx.program_suffix(F.col("x")).alias("suffix"))


@query("""SELECT p_partkey, ['.png', '.jpg', '.tif', '.emf', '.wmf', '.svg', '.png'][p_partkey % 7 + 1] AS suffix FROM part""")
def image_suffixes(spark, d):
    x = F.expr("element_at(array('image/png', 'IMAGE/JPEG', 'image/tiff', 'image/x-emf', 'image/wmf', 'image/svg+xml', 'image/what'), cast(p_partkey % 7 + 1 as int))")
    return part(spark, d, x=x).select("p_partkey", tx.image_suffix(F.col("x")).alias("suffix"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' ELSE '# ' || p_brand || chr(10) || chr(10) END || CASE p_partkey % 3 WHEN 0 THEN chr(10) || '# ' WHEN 1 THEN '## ' ELSE '' END || p_name AS titled FROM part""")
def titled(spark, d):
    return part(spark, d, p_brand="p_brand", x="concat(CASE p_partkey % 3 WHEN 0 THEN '\n# ' WHEN 1 THEN '## ' ELSE '' END, p_name)").select("p_partkey", tx.add_title(F.col("x"), F.col("p_brand")).alias("titled"))


@query(r"""WITH x AS (SELECT p_partkey, regexp_replace(p_name || ' ' || p_type || ' ' || repeat(p_brand || ' ', p_size % 9) || 'z', '\s+', ' ', 'g') AS t FROM part) SELECT p_partkey, CASE WHEN length(t) <= 70 THEN t ELSE rtrim(substr(t, 1, 69)) || '…' END AS short FROM x""")
def ellipsized(spark, d):
    return part(spark, d, x="concat(' ', p_name, '  ', p_type, '\n', repeat(concat(p_brand, '  '), p_size % 9), 'z ')").select("p_partkey", tx.ellipsize(F.col("x")).alias("short"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN sha256(p_name) END AS checksum FROM part""")
def checksums(spark, d):
    x = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper(F.sha2("p_name", 256)), F.lit("  file.zip\n"))).otherwise(F.concat(F.sha2("p_name", 256), F.lit("0 x")))
    return part(spark, d, x=x).select("p_partkey", tx.checksum(F.col("x")).alias("checksum"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '?' ELSE printf('%.1f MB', (p_size * 100000 + p_partkey) / 1048576.0) END AS size FROM part""")
def size_texts(spark, d):
    return part(spark, d, x="CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size * 100000 + p_partkey END").select("p_partkey", tx.size_text(F.col("x")).alias("size"))


@query("""SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE -p_size END AS BIGINT) AS n, CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN 9.0 WHEN 2 THEN 9.0 ELSE p_size * 1.0 END::DOUBLE AS f FROM part""")
def lenient_numbers(spark, d):
    rows = part(spark, d, i="CASE p_partkey % 4 WHEN 0 THEN concat(' ', p_size, '\n') WHEN 1 THEN 'x' WHEN 2 THEN '' ELSE concat('-', p_size) END", f="CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ',5 ') WHEN 1 THEN 'x' WHEN 2 THEN '' ELSE concat(' ', p_size) END")
    return rows.select("p_partkey", tx.int_or(F.col("i"), 1).cast("bigint").alias("n"), tx.lenient_float(F.col("f"), 9.0).alias("f"))


@query("""SELECT p_partkey, ['center', 'right', '', ''][p_partkey % 4 + 1] AS side FROM part""")
def alignments(spark, d):
    return part(spark, d, x="concat(CASE WHEN p_partkey % 4 IN (0, 3) THEN ':' ELSE '' END, repeat('-', p_size), CASE WHEN p_partkey % 4 < 2 THEN ':' ELSE '' END)").select("p_partkey", tx.alignment(F.col("x")).alias("side"))


@query("""SELECT p_partkey, p_brand || '~' || p_type || repeat('~', CAST(greatest(p_size % 5 - 1, 1) - 1 AS INT)) AS cells, CAST(list_sort([p_size, CAST(p_partkey % 7 AS INT), 20, CAST(p_partkey % 30 AS INT)])[3] AS BIGINT) AS median FROM part""")
def padded_rows(spark, d):
    rows = part(spark, d, cells="array(p_brand, p_type)", width="p_size % 5", v="array(p_size, cast(p_partkey % 7 as int), 20, cast(p_partkey % 30 as int))")
    return rows.select("p_partkey", F.array_join(tx.pad(F.col("cells"), F.col("width")), "~").alias("cells"), tx.upper_median(F.col("v")).cast("bigint").alias("median"))


@query("""SELECT p_partkey, p_partkey % 5 < 4 AS remote FROM part""")
def remote_images(spark, d):
    return part(spark, d, x="concat(element_at(array('HTTP://', 'https://', 'data:', 'ftp://', 'img/http:'), cast(p_partkey % 5 + 1 as int)), p_brand)").select("p_partkey", tx.is_remote(F.col("x")).alias("remote"))


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS collapsed FROM part""")
def collapsed_tables(spark, d):
    return part(spark, d, rows="array(array(p_name, 'a\nb'), array(concat('x\ny', CASE WHEN p_partkey % 2 = 0 THEN '\n' ELSE ' ' END), p_type))").select("p_partkey", layout.collapsed(F.col("rows")).alias("collapsed"))


@query("""SELECT p_partkey, '| ' || p_name || ' | k\\|1 |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || p_type || ' |  |  |' || chr(10) || '| a | b | ' || p_size || ' |' AS markdown FROM part""")
def table_text(spark, d):
    rows = F.array(F.array(F.col("p_name"), F.lit("k|1")), F.array(F.col("p_type")), F.array(F.lit("a"), F.lit("b"), F.col("p_size").cast("string")))
    return part(spark, d, rows=rows).select("p_partkey", layout.table_markdown(F.col("rows")).alias("markdown"))


RELEASE = """'{"tag_name": "v2.' || p_size || '", "draft": ' || (p_partkey % 5 = 0) || ', "body": " fixes\\n", "assets": [' || CASE WHEN p_partkey % 3 = 0 THEN '{"name": "tool.tar.gz", "browser_download_url": "http://x/' || p_partkey || '.gz", "size": ' || p_partkey || '}, {"name": "tool.tar.gz.sha256", "browser_download_url": "http://x/s"}, ' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '{"name": "tool", "browser_download_url": "http://x/t", "size": 5}, ' END || '{"name": "other", "size": 1}]}'"""


@query("""SELECT p_partkey, '2.' || p_size AS version, CASE WHEN p_partkey % 3 = 0 THEN 'http://x/' || p_partkey || '.gz' ELSE 'http://x/t' END AS url, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE 5 END::BIGINT AS size, 'fixes' AS notes, CASE WHEN p_partkey % 3 = 0 THEN 'http://x/s' END AS checksum_url FROM part WHERE p_partkey % 5 <> 0 AND p_size > 20 AND (p_partkey % 3 = 0 OR p_partkey % 7 <> 0)""")
def release_assets(spark, d):
    found = part(spark, d, json=RELEASE.replace("||", "||").replace("\\n", "\\\\n")).select("p_partkey", tx.release(F.col("json"), ["tool.tar.gz", "tool"], F.lit("v2.20")).alias("r"))
    return found.filter("r is not null").select("p_partkey", "r.*")


# --- files and outlines ----------------------------------------------------------------------------------------------


@query("""SELECT ord, path FROM (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'Dir/' ELSE 'dir/' END || o_custkey || '.MD' AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""")
def file_spellings(spark, d):
    paths = read(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.expr("concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Dir/' ELSE 'dir/' END, o_custkey, '.MD')").alias("path"), F.col("o_custkey").alias("resolved"))
    return first_spelling(paths).select("ord", "path")


@query(f"""WITH {TREE}, c AS (SELECT doc_id, node_id FROM tree WHERE title LIKE '%A%' AND level <= 2) SELECT CAST(doc_id AS BIGINT) AS doc_id, node_id FROM tree t WHERE EXISTS (SELECT 1 FROM c WHERE c.doc_id = t.doc_id AND starts_with(t.node_id, c.node_id || '.'))""")
def locked_nodes(spark, d):
    tree = outline.nodes(region_docs(spark, d))
    return outline.locked(tree, tree.filter("title LIKE '%A%' AND level <= 2")).select("doc_id", "node_id")


@query(f"""WITH {TREE} SELECT CAST(doc_id AS BIGINT) AS doc_id, node_id || '.9' AS node_id FROM tree WHERE level = 3""")
def unknown_ids(spark, d):
    tree = outline.nodes(region_docs(spark, d))
    asked = tree.select("doc_id", "node_id").unionByName(tree.filter("level = 3").select("doc_id", F.concat("node_id", F.lit(".9")).alias("node_id")))
    return outline.unknown(asked, tree)


@query(f"""WITH {TREE}, c AS (SELECT doc_id, node_id, title, count(*) OVER (PARTITION BY doc_id) AS n FROM tree WHERE level = 2 AND title LIKE '%U%')
    SELECT CAST(doc_id AS BIGINT) AS doc_id, node_id, CASE WHEN n = 1 THEN title ELSE 'doc' || doc_id END AS stem FROM c""")
def section_stems(spark, d):
    tree = outline.nodes(region_docs(spark, d))
    chosen = tree.filter("level = 2 AND title LIKE '%U%'")
    return outline.section_stems(chosen, tree.select("doc_id").distinct().select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("stem")))


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN 'skipped' ELSE 'success' END AS status, CASE p_partkey % 3 WHEN 1 THEN '## ' || p_name || chr(10) WHEN 2 THEN '# ' || p_brand || chr(10) || chr(10) || p_name || chr(10) END AS text FROM part""")
def section_results(spark, d):
    s = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("1").alias("node_id"), F.col("p_brand").alias("title"), F.expr("CASE p_partkey % 3 WHEN 0 THEN ' \n' WHEN 1 THEN concat('## ', p_name, '\n \n') ELSE p_name END").alias("text"))
    return outline.section_results(s).select("doc_id", "status", "text")


MOVED = "'![a](d_images/' || p_size || '%20x.png) [b](d_files/q.pdf) [c](e/f.md) [d](http://x.y/z) ![a](d_images/' || p_size || '%20x.png)'"


@query("""SELECT p_partkey AS doc_id, '![a](s' || p_partkey || '_images/' || p_size || '%20x.png) [b](' || CASE WHEN p_partkey % 2 = 0 THEN 's' || p_partkey || '_files/q.pdf' ELSE 'd_files/q.pdf' END || ') [c](e/f.md) [d](http://x.y/z) ![a](s' || p_partkey || '_images/' || p_size || '%20x.png)' AS text FROM part""")
def asset_relocate(spark, d):
    p = read(spark, d, "part")
    sections = p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("stem"), F.expr(MOVED).alias("text"))
    pictures = p.select(F.col("p_partkey").alias("doc_id"), F.lit("d_images").alias("folder"), F.concat(F.col("p_size").cast("string"), F.lit(" x.png")).alias("name"), F.lit("_images").alias("suffix"))
    files = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("doc_id"), F.lit("d_files").alias("folder"), F.lit("q.pdf").alias("name"), F.lit("_files").alias("suffix"))
    return outline.relocate_assets(sections, pictures.unionByName(files))[0].select("doc_id", "text")


@query("""SELECT CAST(1 + n_regionkey AS BIGINT) AS sheet_no, bool_or(k = 0 AND n_nationkey % 2 = 0 AND f) AS freeze FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, k) = 1 AS f FROM nation, (VALUES (0), (1)) v(k)) GROUP BY n_regionkey""")
def frozen_sheets(spark, d):
    rows = geography(spark, d).filter("seq >= 0").select("doc_id", (F.col("doc_id") + 1).alias("sheet_no"), "seq", F.when((F.col("seq") % 2 == 0) & (F.col("seq") % 4 == 0), "table").otherwise("paragraph").alias("kind"))
    return tables.freeze_rows(rows).select(*big("sheet_no"), "freeze")


# --- layout ----------------------------------------------------------------------------------------------------------

GAPS = WORDS + """, g AS (SELECT doc_id, top, x1 AS lef, lead(x0) OVER (PARTITION BY doc_id, top ORDER BY x0, word_no) AS rig FROM w),
    rows AS (SELECT doc_id, top, dense_rank() OVER (PARTITION BY doc_id ORDER BY top) - 1 AS row_no, coalesce(bool_or(rig - lef > 9.6), false) AS has_gap FROM g GROUP BY doc_id, top),
    isl AS (SELECT *, row_no - row_number() OVER (PARTITION BY doc_id, has_gap ORDER BY row_no) AS k FROM rows),
    runs AS (SELECT doc_id, row_no, top, CASE WHEN has_gap AND count(*) OVER (PARTITION BY doc_id, has_gap, k) >= 3 THEN k END AS k FROM isl)"""


@query(f"""WITH {GAPS} SELECT doc_id, CAST(row_no AS BIGINT) AS row_no, k IS NOT NULL AS in_table FROM runs""")
def table_runs(spark, d):
    rows = layout.printed_rows(order_words(spark, d))
    gaps = layout.row_gaps(rows).select("doc_id", "page_no", "row_no").distinct().withColumn("has_gap", F.lit(True))
    every = rows.select("doc_id", "page_no", "row_no").distinct().join(gaps, ["doc_id", "page_no", "row_no"], "left").withColumn("has_gap", F.coalesce("has_gap", F.lit(False)))
    return layout.table_runs(every).select("doc_id", *big("row_no"), F.col("run").isNotNull().alias("in_table"))


@query(f"""WITH {WORDS}, g AS (SELECT doc_id, top, x1 AS lef, lead(x0) OVER (PARTITION BY doc_id, top ORDER BY x0, word_no) AS rig FROM w), gap AS (SELECT * FROM g WHERE rig - lef > 9.6), need AS (SELECT doc_id, greatest(2, round_even(0.6 * count(DISTINCT top), 0)) AS need FROM w GROUP BY doc_id),
    e AS (SELECT doc_id, lef AS x FROM gap UNION SELECT doc_id, rig FROM gap), s AS (SELECT doc_id, x AS a, lead(x) OVER (PARTITION BY doc_id ORDER BY x) AS b FROM e),
    c AS (SELECT s.doc_id, a, b, count(DISTINCT gap.top) >= any_value(need) AS cover FROM s JOIN need USING (doc_id) LEFT JOIN gap ON gap.doc_id = s.doc_id AND (a + b) / 2 BETWEEN lef AND rig WHERE b IS NOT NULL GROUP BY s.doc_id, a, b),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) - row_number() OVER (PARTITION BY doc_id, cover ORDER BY a) AS k FROM c)
    SELECT doc_id, CAST((min(a) + max(b)) / 2 AS DOUBLE) AS lane FROM k WHERE cover GROUP BY doc_id, k""")
def column_lanes(spark, d):
    """Each page as one run of rows."""
    rows = layout.printed_rows(order_words(spark, d))
    run = F.lit(0).alias("run")
    return layout.shared_lanes(layout.row_gaps(rows).select("*", run), rows.select("*", run)).select("doc_id", F.col("lane").cast("double").alias("lane"))


BLOCKS = LINES + """, b AS (SELECT doc_id, size AS body FROM (SELECT doc_id, size, sum(length(text)) AS n, min(page_no * 100 + seq) AS f FROM l GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1),
    s AS (SELECT DISTINCT l.doc_id, size FROM l JOIN b USING (doc_id) WHERE size >= body * 1.04), r AS (SELECT *, least(6, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC)) AS level FROM s),
    k AS (SELECT l.*, level FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND r.size = l.size), g AS (SELECT *, lag(bottom) OVER w AS pb, lag(top) OVER w AS pt, lag(level) OVER w AS pl, row_number() OVER w AS i FROM k WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY seq)),
    f AS (SELECT *, sum(CASE WHEN level IS NOT NULL OR i = 1 OR pl IS NOT NULL OR top - pb > 1.55 * greatest(1.0, pb - pt) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS para FROM g),
    t AS (SELECT doc_id, page_no, para, any_value(CASE WHEN level IS NOT NULL THEN repeat('#', CAST(level AS INT)) || ' ' ELSE '' END) || string_agg(text, ' ' ORDER BY seq) AS text FROM f GROUP BY doc_id, page_no, para)"""


@query(f"""WITH {BLOCKS} SELECT CAST(doc_id AS BIGINT) AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no, para) AS markdown FROM t GROUP BY doc_id""")
def page_blocks(spark, d):
    return layout.blocks(order_lines(spark, d))


@query(f"""WITH {ITEMS}, x AS (SELECT DISTINCT l_orderkey, round_even(l_suppkey % 6 * 50.04, 1) AS x FROM li) SELECT l_orderkey AS doc_id, array_to_string(list_sort(list(CAST(x AS INT))), '~') AS bounds FROM x GROUP BY l_orderkey HAVING count(*) >= 3""")
def column_rules(spark, d):
    rules = items(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("l_suppkey") % 6 * 50.04).alias("x"))
    return layout.column_bounds(rules).select("doc_id", F.array_join(F.transform("bounds", lambda x: x.cast("int").cast("string")), "~").alias("bounds"))


@query(f"""WITH {WORDS}, g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, top ORDER BY x0, word_no) > 9.6 AS new, dense_rank() OVER (PARTITION BY doc_id ORDER BY top) - 1 AS row_no FROM w), c AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, top ORDER BY x0, word_no) AS crop FROM g)
    SELECT doc_id, CAST(row_no AS BIGINT) AS row_no, CAST(crop AS BIGINT) AS crop, CAST(greatest(0, trunc((min(x0) - 3) * 2.5)) AS BIGINT) AS box_left, CAST(greatest(0, trunc((min(top) - 3) * 2.5)) AS BIGINT) AS box_top, CAST(least(1000, trunc((max(x1) + 3) * 2.5)) AS BIGINT) AS box_right, CAST(trunc((max(bottom) + 3) * 2.5) AS BIGINT) AS box_bottom FROM c
    GROUP BY doc_id, row_no, crop HAVING least(1000, trunc((max(x1) + 3) * 2.5)) - greatest(0, trunc((min(x0) - 3) * 2.5)) >= 4""")
def reading_crops(spark, d):
    words = order_words(spark, d).withColumn("text", F.col("l_returnflag"))
    boxes = layout.crops(layout.printed_rows(words), 2.5, 1000).filter(F.col("left").isNotNull())
    return boxes.select("doc_id", *big("row_no", "crop"), *[F.col(c).cast("bigint").alias(f"box_{c}") for c in ("left", "top", "right", "bottom")])


@query("""WITH b AS (SELECT p_partkey, p_partkey % 4 AS k, p_brand, p_size * 1.0 AS s FROM part) SELECT p_partkey AS doc_id, CAST(v.i AS BIGINT) AS place, v.t AS text, CAST(v.a AS DOUBLE) AS x0, CAST(v.z AS DOUBLE) AS x1 FROM b, LATERAL (VALUES (0, 0, '-', 0.0, 5.0), (0, 1, p_brand, 10.0, 10.0 + s), (1, 0, '- neu ' || p_brand || ' da', 0.0, 10.0 + s), (2, 0, '-', 0.0, 5.0), (2, 1, 'word', 10.0, 10.0 + s), (3, 0, '-', 0.0, 5.0), (3, 1, p_brand, 10.0, 10.0 + s)) v(m, i, t, a, z) WHERE v.m = k""")
def respelled_words(spark, d):
    word = lambda x0, no, text, x1: F.struct(F.lit(x0).alias("x0"), F.lit(no).alias("word_no"), text.alias("text"), x1.alias("x1"), F.lit(0.0).alias("word_top"), F.lit(9.0).alias("word_bottom"))
    crops = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(0).alias("row_no"), F.lit(0).alias("crop"), F.array(word(0.0, 0, F.lit("-"), F.lit(5.0)), word(10.0, 1, F.expr("CASE WHEN p_partkey % 4 = 2 THEN 'wrod' ELSE p_brand END"), 10.0 + F.col("p_size"))).alias("words"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('neu ', p_brand, ' da') WHEN 2 THEN '-word' ELSE ' ' END").alias("reading"))
    return layout.respell(crops).select("doc_id", *big("place"), "text", "x0", "x1")


@query("""SELECT p_partkey AS doc_id, p_brand AS text, CAST(12 + p_size % 3 AS DOUBLE) AS size, 2 * (length(p_brand) // 2 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) > length(p_brand) AS bold FROM part""")
def char_lines(spark, d):
    """A line of each part's brand, some letters bold, the last one larger."""
    chars = read(spark, d, "part").select("p_partkey", "p_size", "p_brand", F.posexplode(F.split("p_brand", "")).alias("char_no", "char")).filter("char <> ''")
    half = F.floor(F.length("p_brand") / 2)
    font = F.when(F.col("char_no") < half + F.when(F.col("p_size") % 2 == 0, 1).otherwise(0), "Some-BoldMT").otherwise("Some")
    rows = chars.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(1).alias("line_no"), "char_no", "char", font.alias("font"), F.when(F.col("char_no") == F.length("p_brand") - 1, 12.04 + F.col("p_size") % 3).otherwise(9.0).alias("size"), F.lit(0.0).alias("top"), F.lit(9.0).alias("bottom"))
    return layout.lines_from_chars(rows).select("doc_id", "text", F.col("size").cast("double").alias("size"), "bold")


@query(f"""WITH {WORDS}, c AS (SELECT *, CASE WHEN (x0 + x1) / 2 BETWEEN 0 AND 200 THEN 0 WHEN (x0 + x1) / 2 BETWEEN 200 AND 480 THEN 1 END AS col FROM w WHERE (x0 + x1) / 2 <= 481), r AS (SELECT doc_id, top, coalesce(string_agg('w' || word_no, ' ' ORDER BY x0, word_no) FILTER (WHERE col = 0), '') AS a, coalesce(string_agg('w' || word_no, ' ' ORDER BY x0, word_no) FILTER (WHERE col = 1), '') AS b FROM c GROUP BY doc_id, top),
    o AS (SELECT *, sum(CASE WHEN a = '' AND b <> '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY top) AS own FROM r), m AS (SELECT doc_id, own, coalesce(string_agg(a, chr(10) ORDER BY top) FILTER (WHERE a <> ''), '') || '~' || coalesce(string_agg(b, chr(10) ORDER BY top) FILTER (WHERE b <> ''), '') AS cells FROM o GROUP BY doc_id, own)
    SELECT doc_id, string_agg(cells, '^' ORDER BY own) AS rows FROM m GROUP BY doc_id""")
def ruled_rows(spark, d):
    """Words of a page between three column rules that leave the rows to the words."""
    words = order_words(spark, d).withColumn("text", F.concat(F.lit("w"), F.col("word_no").cast("string")))
    page = words.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(0).alias("box_no"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), F.lit(480.0).alias("x1"), F.lit(900.0).alias("bottom"), F.array(*map(F.lit, (0.0, 200.0, 480.0))).alias("bounds"))
    found = layout.ruled_tables(words, page)
    return found.select("doc_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, "~")), "^").alias("rows"))


@query()
def read_pages(spark, d):
    """Words of a recogniser to Markdown, tables and all; pytest compares it with plain Python."""
    return layout.read_markdown(order_words(spark, d).withColumn("text", F.concat(F.lit("w"), F.col("word_no").cast("string"))))


@query(f"""WITH {LINES}, b AS (SELECT doc_id, page_no FROM l GROUP BY ALL HAVING sum(length(text)) < 12) SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(page_no AS BIGINT) AS page_no, text, CAST(size AS DOUBLE) AS size FROM l WHERE (doc_id, page_no) NOT IN (SELECT (doc_id, page_no) FROM b)
    UNION ALL SELECT CAST(doc_id AS BIGINT), CAST(page_no AS BIGINT), 's' || seq, 12.0::DOUBLE FROM l WHERE (doc_id, page_no) IN (SELECT (doc_id, page_no) FROM b)""")
def scanned_pages(spark, d):
    """Pages with hardly any text take a recogniser's words, one a row."""
    lines = order_lines(spark, d)
    words = lines.select("doc_id", "page_no", F.col("seq").alias("word_no"), F.concat(F.lit("s"), F.col("seq").cast("string")).alias("text"), F.lit(0.0).alias("x0"), F.lit(10.0).alias("x1"), "top", (F.col("top") + 12.0).alias("bottom"))
    found, _ = layout.fill_scanned(lines.select("doc_id", "page_no").distinct(), lines, words)
    return found.select("doc_id", *big("page_no"), "text", F.col("size").cast("double").alias("size"))


@query(r"""SELECT p_partkey, 'a' || p_name || 'b' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'rest' END AS plain FROM part""")
def field_codes(spark, d):
    """Word's fields without their instructions."""
    x = F.expr("concat('a', char(19), ' HYPERLINK ', p_brand, char(20), p_name, char(21), 'b', CASE WHEN p_partkey % 2 = 0 THEN concat(char(19), 'PAGE') ELSE concat(char(19), 'x', char(21), 'rest') END)")
    return part(spark, d, x=x).select("p_partkey", tx.strip_field_codes(F.col("x")).alias("plain"))


@query("""SELECT p_partkey, least(300 / 72.0::DOUBLE, 10000.0::DOUBLE / greatest(p_size * 100.0, p_partkey % 3000)) AS scale FROM part""")
def picture_scales(spark, d):
    return part(spark, d, w="cast(p_size * 100 as double)", h="cast(p_partkey % 3000 as double)").select("p_partkey", layout.picture_scale(F.col("w"), F.col("h")).alias("scale"))


@query("""SELECT p_partkey, ['protected', 'missing', 'external', 'damaged', NULL][p_partkey % 5 + 1] AS kind FROM part""")
def error_kinds(spark, d):
    from papyrine.plans.convert import typed_error

    said = F.element_at(F.array(*map(F.lit, ("ValueError: the file is protected by a Password", "the file was not found", "old Office files need an external converter, which is not available", "BadZipFile: x", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return part(spark, d, m=said).select("p_partkey", typed_error(F.col("m")).alias("kind"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 4 = 1 THEN 'stem' END AS title FROM part""")
def injected_titles(spark, d):
    """The heading a document gets where its first block is none of the first level: its own title, else the file's name."""
    text = F.expr("concat(CASE p_partkey % 4 WHEN 2 THEN '# own' WHEN 3 THEN 'own\\n===' ELSE 'text' END, '\\n\\n## x')")
    blocks = markdown.md_blocks(part(spark, d, markdown=text).withColumnRenamed("p_partkey", "doc_id"))
    first = blocks.filter("block_id = 0").select(F.col("doc_id").alias("p_partkey"), ((F.col("kind") == "heading") & (F.col("level") == 1)).alias("has"))
    meta = part(spark, d, title="CASE WHEN p_partkey % 2 = 0 THEN p_brand END")
    return meta.join(first, "p_partkey").select("p_partkey", F.when(~F.col("has"), F.coalesce("title", F.lit("stem"))).alias("title"))


# --- grammars --------------------------------------------------------------------------------------------------------

GRAMMAR = """p_name
===

## p_brand ##

1. one
2) two

   more

* [ ] open
* [x] done p_size
  - inner

> quote *p_type*
lazy
> > deep

    code p_size

~~~sql
select `1`
```
~~~

***

p_brand
---
| a | b\\|c | d |
|:-:|--:|---|
| p_name | p_size
long
"""
# Block, parent, order, depth, kind, level, text, ordered, start, checked; text in terms of the part.
TOLD = [
    (0, -1, 0, 0, "heading", 1, "p_name", None, None, None), (1, -1, 1, 0, "heading", 2, "p_brand", None, None, None), (2, -1, 2, 0, "list", None, None, True, 1, None), (3, 2, 0, 1, "item", None, None, None, None, None), (4, 3, 0, 2, "paragraph", None, "one", None, None, None),
    (5, 2, 1, 1, "item", None, None, None, None, None), (6, 5, 0, 2, "paragraph", None, "two", None, None, None), (7, 5, 1, 2, "paragraph", None, "more", None, None, None), (8, -1, 3, 0, "list", None, None, False, 1, None), (9, 8, 0, 1, "item", None, None, None, None, False), (10, 9, 0, 2, "paragraph", None, "open", None, None, None),
    (11, 8, 1, 1, "item", None, None, None, None, True), (12, 11, 0, 2, "paragraph", None, "done p_size", None, None, None), (13, 11, 1, 2, "list", None, None, False, 1, None), (14, 13, 0, 3, "item", None, None, None, None, None), (15, 14, 0, 4, "paragraph", None, "inner", None, None, None),
    (16, -1, 4, 0, "quote", None, None, None, None, None), (17, 16, 0, 1, "paragraph", None, "quote *p_type* lazy", None, None, None), (18, 16, 1, 1, "quote", None, None, None, None, None), (19, 18, 0, 2, "paragraph", None, "deep", None, None, None),
    (20, -1, 5, 0, "code", None, "code p_size", None, None, None), (21, -1, 6, 0, "code", None, "select `1`\n```", None, None, None), (22, -1, 7, 0, "rule", None, None, None, None, None), (23, -1, 8, 0, "heading", 2, "p_brand", None, None, None), (24, -1, 9, 0, "table", None, None, None, None, None), (25, -1, 10, 0, "paragraph", None, "long", None, None, None),
]


def of_part(text: str, glue: str, cast: str) -> str:
    """An SQL expression of a text in which p_name, p_brand, p_type and p_size stand for the part's."""
    for name in ("p_name", "p_brand", "p_type", "p_size"):
        text = text.replace(name, f"' {glue} CAST({name} AS {cast}) {glue} '")
    return "'" + text.replace("\n", f"' {glue} chr(10) {glue} '") + "'"


def literal(x: object) -> str:
    return "NULL" if x is None else of_part(x, "||", "VARCHAR") if isinstance(x, str) else str(x).lower()


@query("SELECT p_partkey AS doc_id, CAST(v.a AS BIGINT) AS block_id, CAST(v.b AS BIGINT) AS parent_id, CAST(v.c AS BIGINT) AS seq, CAST(v.d AS BIGINT) AS depth, v.e AS kind, CAST(v.f AS BIGINT) AS level, v.g AS text, v.h AS ordered, CAST(v.i AS BIGINT) AS start, v.j AS checked FROM part, LATERAL (VALUES " + ", ".join("(" + ", ".join(map(literal, t)) + ")" for t in TOLD) + ") v(a, b, c, d, e, f, g, h, i, j)")
def md_grammar(spark, d):
    """Every kind of block, nested, in one document a part."""
    docs = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(of_part(GRAMMAR.replace("\\", "\\\\"), "||", "STRING").replace("chr(10)", "char(10)")).alias("markdown"))
    found = markdown.md_blocks(docs)
    return found.select("doc_id", *big("block_id", "parent_id", "seq", "depth"), "kind", *big("level"), "text", "ordered", *big("start"), "checked")


SPANS = "a ***p_name*** __p_brand__ _i_ x_y_z ~~s p_size~~ `c * d` H<sub>2</sub> \\*no\\* <http://x.y/p_size> [l **p_type**](u.md \"t\") ![alt](i.png)<br>e"
# Kind, text, bold, italic, code, strike, above or below the line, link, picture.
STYLED = [
    ("text", "a ", 0, 0, 0, 0, None, None, None), ("text", "p_name", 1, 1, 0, 0, None, None, None), ("text", " ", 0, 0, 0, 0, None, None, None), ("text", "p_brand", 1, 0, 0, 0, None, None, None), ("text", " ", 0, 0, 0, 0, None, None, None), ("text", "i", 0, 1, 0, 0, None, None, None), ("text", " x_y_z ", 0, 0, 0, 0, None, None, None),
    ("text", "s p_size", 0, 0, 0, 1, None, None, None), ("text", " ", 0, 0, 0, 0, None, None, None), ("text", "c * d", 0, 0, 1, 0, None, None, None), ("text", " H", 0, 0, 0, 0, None, None, None), ("text", "2", 0, 0, 0, 0, "sub", None, None), ("text", " *no* ", 0, 0, 0, 0, None, None, None), ("text", "http://x.y/p_size", 0, 0, 0, 0, None, "http://x.y/p_size", None),
    ("text", " ", 0, 0, 0, 0, None, None, None), ("text", "l ", 0, 0, 0, 0, None, "u.md", None), ("text", "p_type", 1, 0, 0, 0, None, "u.md", None), ("text", " ", 0, 0, 0, 0, None, None, None), ("image", "alt", 0, 0, 0, 0, None, None, "i.png"), ("break", "", 0, 0, 0, 0, None, None, None), ("text", "e", 0, 0, 0, 0, None, None, None),
]


@query("SELECT p_partkey AS doc_id, CAST(v.n AS BIGINT) AS pos, v.a AS kind, v.b AS text, v.c = 1 AS bold, v.d = 1 AS italic, v.e = 1 AS code, v.f = 1 AS strike, v.g AS vertical, v.h AS href, v.i AS src FROM part, LATERAL (VALUES " + ", ".join(f"({n}, " + ", ".join(map(literal, t)) + ")" for n, t in enumerate(STYLED)) + ") v(n, a, b, c, d, e, f, g, h, i)")
def md_spans(spark, d):
    """Every kind of span."""
    t = F.expr(of_part(SPANS.replace("\\", "\\\\"), "||", "STRING")).alias("t")
    return read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), t).select("doc_id", F.posexplode(markdown.md_inline("t")).alias("pos", "s")).select("doc_id", *big("pos"), "s.*")


@query("""SELECT p_partkey AS doc_id, CAST(v.r AS BIGINT) AS row_no, v.t AS value, v.w AS warned FROM part, LATERAL (VALUES (1, '=' || p_name, false), (2, repeat('x', 32767), true)) v(r, t, w)""")
def cell_safety(spark, d):
    docs = read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("="), "p_name", F.lit("\n\n"), F.repeat(F.lit("x"), F.lit(32800))).alias("markdown"))
    return markdown.md_cells(docs).select("doc_id", *big("row_no"), "value", F.col("warning").isNotNull().alias("warned"))


PAGE = "<h2>p_name<br>x</h2><p>a <b> b </b><i>c</i><s>d</s><code>e</code><sup>2</sup><a href=\"u\">p_brand</a><a href=\"v\"></a><img src=\"i.png\" alt=\" t \"></p><ol><li>one<ul><li>in</li></ul></li><li></li><li><p>p_size</p><p>y</p></li></ol><blockquote><p>q</p><p>r</p></blockquote><pre>k  l\nm</pre><hr><table><tr><th>p|q</th><th colspan=\"2\">w</th></tr><tr><td>x<br>y</td></tr></table><div><b>f</b> <i>g</i></div>tail &amp; p_type</p>"
SAID = "## p_name  \nx\n\na  **b** *c*~~d~~`e`<sup>2</sup>[p_brand](u)<v>![t](i.png)\n\n1. one\n   - in\n3. p_size\n\n   y\n\n> q\n>\n> r\n\n```\nk  l\nm\n```\n\n---\n\n| p\\|q | w |   |\n| --- | --- | --- |\n| x<br>y |   |   |\n\n**f***g*\n\ntail & p_type\n"


@query(f"SELECT p_partkey AS doc_id, {of_part(SAID, '||', 'VARCHAR')} AS markdown FROM part")
def html_grammar(spark, d):
    """Every kind of element."""
    page = F.expr(of_part(PAGE.replace('"', '\\"'), "||", "STRING").replace("chr(10)", "char(10)"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), html.html_to_md(page).alias("markdown"))


# --- whole files -----------------------------------------------------------------------------------------------------

WORD_TEXT = "# p_name\n\nSome **p_brand** of [p_type](http://x.y/z), *i* ~~s~~ `c`.\n\n- one\n  - two p_size\n- three\n\n1. x\n2. y\n\n| k | v |\n| --- | --- |\n| p_name | a\\|p_size |\n\n> quote p_type\n\n```\ncode  p_size\nmore\n```\n"
SHEET_TEXT = "# p_brand\n\n| k | v |\n| --- | --- |\n| p_name | p_size |\n| 007 | 1.5 |\n"


def there_and_back(spark: SparkSession, d: str, text: str, suffix: str) -> DataFrame:
    """(doc_id, markdown): a Markdown file a part, written as an office file by the conversion plan, and read again by it."""
    from papyrine.plans.convert import Options, convert

    o = Options(target=suffix, add_title=False)
    kind = lambda container: F.struct(F.lit(container).alias("container"), F.lit("").alias("suggested_suffix")).alias("kind")
    body = F.expr(of_part(text.replace("\\", "\\\\"), "||", "STRING").replace("chr(10)", "char(10)"))
    path = F.col("p_partkey").cast("string")
    texts = read(spark, d, "part").select(path.alias("path"), F.concat(path, F.lit(".md")).alias("name"), F.lit(".md").alias("suffix"), kind("unknown"), F.encode(body, "UTF-8").alias("content"))
    texts = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # the table is one small file
    made = convert(texts, o).select(F.col("source").alias("path"), F.col("output").alias("name"), F.lit(suffix).alias("suffix"), kind("zip"), "content")
    return convert(made, o).select(F.col("source").cast("bigint").alias("doc_id"), "markdown")


@query(f"SELECT p_partkey AS doc_id, {of_part(WORD_TEXT, '||', 'VARCHAR')} AS markdown FROM part")
def word_round_trip(spark, d):
    return there_and_back(spark, d, WORD_TEXT, ".docx")


@query(f"SELECT p_partkey AS doc_id, {of_part('#' + SHEET_TEXT, '||', 'VARCHAR')} AS markdown FROM part")
def workbook_round_trip(spark, d):
    return there_and_back(spark, d, SHEET_TEXT, ".xlsx")
