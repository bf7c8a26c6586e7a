"""Chapters from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a source, as the planner knows it, under which its rows are dealt over all cores without a look at its files; and bytes for each task of a larger one.
SMALL_SOURCE, TASK_BYTES = 256 << 20, 32 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt over all cores unless their files are: a file is read by no more tasks than it has groups of rows, however large it is."""
    size, cores = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), rows.sparkSession.sparkContext.defaultParallelism
    if size < SMALL_SOURCE:
        return rows.repartition(cores)
    # Rows of each task, of which the files' footers tell; no column is read.
    most, total = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return rows if total is None or 2 * cores * most <= total else rows.repartition(cores * -(-size // (cores * TASK_BYTES)))


def document_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chapters: a run for each language, a book for each source."""
    docs = spread(table(spark, folder, "documents"))
    return docs.select(F.col("lang").alias("run"), F.col("source").alias("book"), F.col("doc_id").alias("chapter_id"), "text")


def dialogue_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as chapters: a run for each role, a book for each conversation, a chapter for each turn."""
    rows = spread(table(spark, folder, "conversations"))
    return rows.select(F.col("role").alias("run"), F.col("conv_id").cast("string").alias("book"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chapter_id"), "text")


def labelled_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a quality label as chapters of two runs, good and poor."""
    docs, labels = spread(table(spark, folder, "documents")), table(spark, folder, "labels")
    run = F.when(F.col("quality") == 1, "good").otherwise("poor")
    return docs.join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id").select(run.alias("run"), F.col("source").alias("book"), F.col("doc_id").alias("chapter_id"), "text")
