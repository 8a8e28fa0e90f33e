"""A training corpus from ``documents``: five stages, each a table written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from papyrine.llm import bpe, jaccard, lines, mixing, quality
from papyrine.llm.common import fresh, table, written
from papyrine.llm.queries import pattern, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier gives 0.7 or more; it learns from the labels of training rows.

    Null and empty texts get the score of an empty passage; repeated rows share a fate; rows with null doc_id are
    judged but never learned from; of an empty table nothing is left; columns of any other name pass through.
    """
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of lines; rows of which nothing is left go. A number column n_chars follows the text.

    Null, empty and blank texts stay as they are; rows that repeat doc_id and text are one document, so they keep the
    same lines; a row with a null doc_id comes after all others; of an empty table nothing is left; columns of any name
    pass through.
    """
    done = lines.dedup_passages(docs)
    removed = done.columns[-1]
    left = done.filter(~((F.col(removed) > 0) & (F.col("text") == "")) | F.col("text").isNull())
    return left.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" and isinstance(docs.schema[c].dataType, NumericType) else F.col(f"`{c}`") for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates; of several
    texts with that doc_id, the one with the smallest hash.

    Null and empty texts are in no group and stay; rows that repeat doc_id and text are one document and share its fate;
    a row that repeats a doc_id with another text is judged by its own text; null doc_ids come after all others; of an empty table nothing is left; columns of any name pass through.
    """
    found = written(jaccard.near_duplicates(docs.select("doc_id", "text"), keep=True).filter("root is not null"), "near")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = found.groupBy("root").agg(F.min(key).alias("first"), F.max(key).alias("last")).filter("first != last").select("root", "first")
    out = written(found.join(written(first, "first"), "root").filter(key != F.col("first")).select("doc_id", "h").distinct(), "copies")
    d, h = fresh(docs.columns, "d"), fresh(docs.columns, "h")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h))
    return docs.join(out.select(F.col("doc_id").alias(d), F.col("h").alias(h)), same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it (0, 1 or 2 times), those with null or repeated doc_ids too.

    Rows get a key, written with them, so that each keeps its own decision. It starts with a hash of the row, so that
    the order of rows decides between equal rows only. Null and empty texts have no words and stay once; null sources
    are a source; of an empty table nothing is left; columns of any name pass through.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.struct(F.xxhash64(*columns).alias("h"), F.monotonically_increasing_id().alias("i")).alias("key"))
    rows = written(rows, "mix-rows")
    copies = mixing.mix(rows.select("row.doc_id", "row.text", "row.source", "key"), keep=("key",)).filter("copies > 0").select("key", "copies")
    return rows.join(copies, "key").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of token ids and decoded bytes of every row's text.

    Null text counts as empty and has 0 tokens; repeated rows and null doc_ids give a row each; an empty table gives an
    empty result; other columns are not read.
    """
    return bpe.encode_digests(docs, vocabulary(), pattern())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

# SQL can't express the classifier, the content-defined chunks and the tokenizer; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
