"""The driver's tables as corpora of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stored bytes for each task where a table is dealt out, and under which it isn't.
SHARE, SMALL = 8 << 20, 1 << 20


def _files(spark: SparkSession, sf_dir: str, name: str, path: Column, text: str, even: bool) -> DataFrame:
    """(path, content). even: dealt over all cores where few files hold the table, as Spark cuts no row group: one may be a task's whole work."""
    rows = table(spark, sf_dir, name)
    files = rows.select(path.alias("path"), F.col(text).alias("content"))
    if not even:
        return files
    cores, stored = spark.sparkContext.defaultParallelism, int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if stored < SMALL or len(rows.inputFiles()) >= 2 * cores:
        return files
    return files.repartition(max(3 * cores, -(-stored // SHARE)), "path")


def documents(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    return _files(spark, sf_dir, "documents", F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")), "text", even)


def pages(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    return _files(spark, sf_dir, "pages", F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), "html", even)


def conversations(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    return _files(spark, sf_dir, "conversations", F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("-"), "role", F.lit(".md")), "text", even)
