"""Files as rows: discovery and output names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions.text import base_name, is_supported, sniff, suffix
from papyrine.sources.scratch import written


LISTED = "path string, name string, suffix string, length long, modified timestamp, problem string"


def listing(spark: SparkSession, paths: list[str], recursive: bool = True) -> DataFrame:
    """LISTED rows of the files below ``paths``, each once, by lower-cased path, without reading them.

    Folders give their supported files; a file named itself is there in any case, with the problem "unsupported" if its
    kind is, and so is a path that does not exist, with "missing". Spark's reader leaves out names that begin with _ or
    a dot.
    """
    hadoop = spark._jsc.hadoopConfiguration()
    there, named, missing = [], [], []
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = where.getFileSystem(hadoop)
        if files.exists(where):
            there.append(p)
            named += [files.makeQualified(where).toString()] if files.getFileStatus(where).isFile() else []
        else:
            missing.append(files.makeQualified(where).toString())
    rows = spark.createDataFrame([(p, None, None, None, None, "missing") for p in missing], LISTED)
    if there:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(there).select("path", F.col("length"), F.col("modificationTime").alias("modified"))
        good = is_supported(F.col("path"))
        found = found.withColumn("problem", F.when(~good, F.lit("unsupported"))).filter(good | F.col("path").isin(named))
        rows = rows.unionByName(found.withColumn("name", F.lit(None).cast("string")).withColumn("suffix", F.lit(None).cast("string")))
    name = F.url_decode(F.regexp_replace(base_name(F.col("path")), r"\+", "%2B"))
    return rows.dropDuplicates(["path"]).withColumn("name", name).withColumn("suffix", suffix(name)).orderBy(F.lower("path"))


def with_content(spark: SparkSession, files: DataFrame, paths: list[str], recursive: bool = True) -> DataFrame:
    """files(path, ...) plus kind and content, null for those without any. The listing is small and joined to the files
    where they are read, if Spark can broadcast it; otherwise each file's bytes are moved once."""
    known = files.filter("problem is null")
    there = [r["path"] for r in known.select("path").limit(1).collect()]
    if not there:
        return files.withColumn("kind", F.lit(None).cast("struct<container:string,suggested_suffix:string>")).withColumn("content", F.lit(None).cast("binary"))
    hadoop = spark._jsc.hadoopConfiguration()
    good = [p for p in paths if (w := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(hadoop).exists(w)]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(good).select("path", "content").filter(is_supported(F.col("path")))
    full = read.join(known, "path")
    sniffed = full.select(*files.columns, sniff(F.col("content"), F.col("name")).alias("kind"), "content")
    bad = files.filter("problem is not null").withColumn("kind", F.lit(None).cast(sniffed.schema["kind"].dataType)).withColumn("content", F.lit(None).cast("binary"))
    return sniffed.unionByName(bad)


def discover(spark: SparkSession, paths: list[str], recursive: bool = True) -> DataFrame:
    """(path, name, suffix, length, modified, problem, kind, content) of the files below ``paths``."""
    return with_content(spark, written(listing(spark, paths, recursive), "files"), paths, recursive)


def first_spelling(paths: DataFrame) -> DataFrame:
    """paths(ord, path, resolved): the first spelling of each resolved path, sorted by lower-cased path."""
    rank = F.row_number().over(Window.partitionBy("resolved").orderBy("ord"))
    return paths.withColumn("r", rank).filter("r = 1").drop("r").orderBy(F.lower("path"))


def write_results(results: DataFrame, folder: str) -> None:
    """Each result's text or bytes as a file named ``output`` below folder, and its assets beside it; rows are written by
    the tasks that hold them, so ``folder`` has to be a path that all executors share. A retried task writes the same."""
    import os

    def put(rows):
        for r in rows:
            if r["status"] != "success" or not r["output"]:
                continue
            data = r["content"] if r["markdown"] is None else r["markdown"].encode("utf-8", "replace")
            for name, body in [(os.path.basename(r["output"]), data), *((a["name"], a["content"]) for a in r["assets"] or [])]:
                path = os.path.join(folder, *[x for x in name.split("/") if x not in ("", ".", "..")])
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(body)

    results.select("status", "output", "markdown", "content", "assets").foreachPartition(put)
