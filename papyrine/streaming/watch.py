"""An extension: watch a folder and convert new files as they come, with the batch plan in each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrine.functions.text import base_name, is_supported, sniff, suffix
from papyrine.plans.convert import Options, convert, output_names
from papyrine.sources.scratch import written

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Results as Parquet below ``out``; a file is known by path, time and size, so a changed file is converted again,
    under a name that no earlier result has."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(folder)
    files = files.filter(is_supported(F.col("path"))).withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["path", "modificationTime", "length"])

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = df.withColumn("name", base_name(F.col("path"))).withColumn("suffix", suffix(F.col("name"))).withColumn("kind", sniff(F.col("content"), F.col("name"))).withColumn("problem", F.lit(None).cast("string"))
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(out)
        there = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(target)
        taken = None
        if there:  # names that earlier batches gave, not those of a first try of this one
            old = df.sparkSession.read.schema("output string, batch long").parquet(out).filter(F.col("batch") != batch_id)
            taken = old.filter("output != ''").select(F.lit("").alias("folder"), F.col("output").alias("name"))
        named = output_names(written(rows.select("path", "name", "suffix", "problem"), "files"), options, taken)
        convert(rows.join(named.select("path", "output"), "path"), options).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
