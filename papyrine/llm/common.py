"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE, SLICE_BYTES = 512, 4 << 20
BATCH_BYTES = "8m"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# What modules keep between the rows of a task; emptied at the task's end, since workers live on with other tasks.
CACHES: list[Callable[[], None]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a one-machine session (master ``local[...]``) without that setting gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="papyrine-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back; cuts the lineage, so lost executors cost no recomputation.

    Results may still read the table, so it goes when the application ends; ``dropped`` takes it away before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _at(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()} if t is not None else ():
            files, where = _at(t.sparkSession, path)
            files.delete(where, True)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as remainder 0."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus, F.lit(0)).cast("int")


def fresh(columns: list[str], wanted: str) -> str:
    """``wanted``, or with underscores after it until no column has that name, whatever the case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def hash_sample(df: DataFrame, key: str, stratum: str, cap: int) -> DataFrame:
    """About ``cap`` rows (all, if fewer) of each value of ``stratum``, chosen by a hash of ``key``.

    The choice depends on keys and counts alone, so reruns agree. Nothing is collected: counts, one row a value, are
    written and joined to the rows; Spark knows that table's size and broadcasts it if it is small.
    """
    share = written(df.groupBy(F.col(stratum).alias("stratum_")).agg((F.lit(float(cap)) / F.count(F.lit(1))).alias("share_")), "shares")
    unit = (F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    return df.join(share, F.col(stratum) == F.col("stratum_")).filter(unit < F.col("share_")).select(*df.columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, cap: int) -> DataFrame:
    """(doc_id, text, label) of about ``cap`` training documents per label value; held-out remainders never enter.

    A document with several labels takes the largest; one with several texts gives each of them. Labels are 0 and 1
    here (above 0 or not), so the sample holds about 2 * cap ids, which Spark may broadcast by its own size check.
    """
    known = (
        labels.select(F.col("doc_id").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    picked = written(hash_sample(known, "doc_id", "label", cap), "sample")
    return docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "text", "label")


def bounded(spark: SparkSession) -> None:
    """Arrow batches by bytes, not only by rows, unless the session says otherwise: texts may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") == "1":
        spark.conf.set(key, BATCH_BYTES)


def tidy() -> None:
    """At a task's end: empties caches and gives free memory back, as the worker stays for other tasks."""
    for clear in CACHES:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of SLICE rows and about SLICE_BYTES bytes, so that a worker holds few texts as Python objects at a time."""
    for b in batches:
        rows = max(1, min(SLICE, int(SLICE_BYTES * b.num_rows / max(1, b.nbytes))))
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def map_columns(df: DataFrame, fn: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with columns as Python lists: fn gets an iterator of {column: list} and yields such dicts."""

    out = to_arrow_schema(StructType.fromDDL(schema))
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in slices(batches))
        try:
            for rows in fn(read):
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in out], schema=out)
        finally:
            tidy()

    return df.mapInArrow(run, schema)


BLOCK_ROWS = "k int, near int, part binary"


def block_rows(whole: np.ndarray, block: int) -> dict[str, list]:
    """BLOCK_ROWS of one task's array: its blocks that are not all zero."""
    used = [k for k in range(0, len(whole), block) if whole[k : k + block].any()]
    near = TaskContext.get().partitionId() // 64
    return {"k": [k // block for k in used], "near": [near] * len(used), "part": [whole[k : k + block].tobytes() for k in used]}


def merged_blocks(rows: DataFrame, length: int, kind: type, block: int) -> np.ndarray:
    """The sum (of numbers) or union (of bits, for uint8) of the tasks' arrays in BLOCK_ROWS, of fixed ``length``.

    Blocks meet on the executors, first those of 64 neighbouring tasks, then those sums, so the driver gets ``length``
    numbers, whatever the number of rows or tasks.
    """

    def met(key: tuple, part: pa.Table) -> pa.Table:
        total = None
        for x in part.column("part"):
            a = np.frombuffer(x.as_buffer(), kind)
            total = a.copy() if total is None else total | a if kind is np.uint8 else total + a
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(length, kind)
    some = rows.groupBy("k", "near").applyInArrow(met, "k int, part binary")
    for k, part in some.groupBy("k").applyInArrow(met, "k int, part binary").collect():
        a = np.frombuffer(part, kind)
        out[k * block : k * block + len(a)] = a
    return out


def bitmap(places: DataFrame, bits: int, block: int = 1 << 16) -> np.ndarray:
    """2**bits bits, packed; those of the column ``place`` are on."""

    def marked(batches: Iterator[dict]) -> Iterator[dict]:
        on = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            mark(on, np.array(b["place"], np.int64))
        yield block_rows(on, block)

    return merged_blocks(map_columns(places, marked, BLOCK_ROWS), 1 << (bits - 3), np.uint8, block)


def mark(on: np.ndarray, place: np.ndarray) -> None:
    np.bitwise_or.at(on, place >> 3, (np.uint8(1) << (place & 7).astype(np.uint8)))


def marked_at(on: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each place is on; the packed bits are read as they are."""
    return (on[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def bits_for(n: int, least: int = 20, most: int = 27) -> int:
    """Bits of a bitmap for n marks, about 16 places a mark; at most 2**27 places (16 MB), beyond which more false hits come."""
    return max(least, min(most, (16 * max(1, n)).bit_length()))
