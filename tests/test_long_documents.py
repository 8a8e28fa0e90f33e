"""Documents of many headings: the work grows with their length, not with its square. Limits leave ten times what it takes."""

import time

import pytest
from pyspark.sql import functions as F

from papyrine.operators import outline

CHAPTERS, SECTIONS = 20, 300


@pytest.fixture(scope="module")
def long(spark):
    """(docs, tree): a document of 20 chapters of 300 sections, and a short one."""
    parts = [f"## C{c}\n" + "".join(f"### S{c}-{s}\n```\n# no\n```\n" for s in range(SECTIONS)) for c in range(CHAPTERS)]
    docs = spark.createDataFrame([(1, "# D\n" + "".join(parts)), (2, "# E\n## C1\n")], "doc_id long, markdown string")
    return docs, outline.nodes(docs)


def rows(df, limit: float = 20):
    began = time.time()
    found = df.collect()
    assert time.time() - began < limit
    return found


def test_locked(long):
    docs, tree = long
    got = rows(outline.locked(tree, tree.filter("title = 'C1'")))
    assert {(r.doc_id, r.node_id) for r in got} == {(1, f"1.2.{s}") for s in range(1, SECTIONS + 1)} and len(got) == SECTIONS


def test_visible(long):
    _, tree = long
    got = {(r.doc_id, r.node_id) for r in rows(outline.visible(tree, "s3-29"))}
    assert got == {(1, "1"), (1, "1.4"), (1, "1.4.30"), *[(1, f"1.4.{s}") for s in range(291, 301)]}


def test_cover(long):
    _, tree = long
    got = {(r.doc_id, r.node_id) for r in rows(outline.cover(tree.filter("title LIKE 'S%' OR title = 'C1'"), tree))}
    assert got == {(2, "1.1"), (1, "1.2"), *[(1, f"1.{c}.{s}") for c in range(1, CHAPTERS + 1) if c != 2 for s in range(1, SECTIONS + 1)]}


def test_unknown(long):
    _, tree = long
    asked = tree.select("doc_id", "node_id").unionByName(tree.filter("title LIKE 'S%-7'").select("doc_id", F.concat("node_id", F.lit(".9")).alias("node_id")))
    assert {(r.doc_id, r.node_id) for r in rows(outline.unknown(asked, tree))} == {(1, f"1.{c}.8.9") for c in range(1, CHAPTERS + 1)}


def test_extract(long):
    docs, tree = long
    got = {r.doc_id: r.text for r in rows(outline.extract(docs, tree.filter("title = 'C1' OR title LIKE 'S3-%' OR title LIKE 'S1-%'"), tree))}
    # chapter 1 is of level 2, the sections of chapter 3 of level 3: all move up by one
    want = "# C1\n" + "".join(f"## S1-{s}\n```\n# no\n```\n" for s in range(SECTIONS)) + "\n" + "\n\n".join(f"## S3-{s}\n```\n# no\n```" for s in range(SECTIONS))
    assert got == {1: want, 2: "# C1"}


def test_split(long):
    docs, tree = long
    got = {(r.doc_id, r.node_id, r.title): r.text for r in rows(outline.split_sections(docs, tree.filter("title LIKE 'C%'"), tree))}
    want = {(1, f"1.{c + 1}", f"C{c}"): f"# C{c}\n" + "\n".join(f"## S{c}-{s}\n```\n# no\n```" for s in range(SECTIONS)) for c in range(CHAPTERS)}
    assert got == {**want, (2, "1.1", "C1"): "# C1"}


def test_split_keeps_columns_and_repeats(spark):
    docs = spark.createDataFrame([("a", "x\r\n# A\n~~~\n## no\n```\n~~~\n## B \n\n\n\n  ###### C\n###### D"), ("b", None), ("c", "# A")], "doc_id string, markdown string")
    chosen = spark.createDataFrame([("a", 1, 12, 1, [1]), ("a", 6, 12, 5, None), ("a", 1, 1, None, []), ("b", 0, 1, 0, [2]), ("z", 0, 1, 0, [3])], "doc_id string, start int, end int, up int, more array<int>")
    got = {(r.doc_id, r.start, r.end, r.up, None if r.more is None else tuple(r.more)): r.text for r in outline.section_texts(docs, chosen, F.col("up")).collect()}
    assert got == {
        ("a", 1, 12, 1, (1,)): "# A\n~~~\n## no\n```\n~~~\n# B \n\n  ###### C\n##### D", ("a", 6, 12, 5, None): "# B \n\n  ###### C\n# D", ("a", 1, 1, None, ()): "", ("b", 0, 1, 0, (2,)): ""
    }
