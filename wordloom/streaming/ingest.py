"""An extension: continuous ingestion of chapters into the token index and running word counts.

Indexing is a function of single rows, so it needs no state; counts are kept by Spark, with a watermark when windowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.functions import text as X

CHAPTER = "run string, book string, chapter_id bigint, text string, arrived timestamp"


def chapter_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Chapters from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(CHAPTER).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def index_stream(chapters: DataFrame) -> DataFrame:
    """A row for each token, with its position in the chapter."""
    zipped = F.posexplode(F.arrays_zip(X.raw_words(F.col("text")).alias("raws"), X.words(F.col("text")).alias("words"))).alias("pos", "t")
    rows = chapters.select("run", "book", "chapter_id", "arrived", zipped)
    return rows.select("run", "book", "chapter_id", "arrived", (F.col("pos") + 1).cast("bigint").alias("chapter_position"), F.col("t.raws").alias("token_text"), F.col("t.words").alias("word"))


def windowed_counts(chapters: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts of words by window of arrival; rows later than the watermark are dropped."""
    rows = chapters.withWatermark("arrived", lateness).select("run", "arrived", F.explode(X.words(F.col("text"))).alias("word"))
    counts = rows.groupBy(F.window("arrived", window).alias("w"), "run", "word").agg(F.count("*").alias("count"))
    return counts.select("run", "word", F.col("w.start").alias("window_start"), "count")


def append_index(chapters: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the index to a Parquet table partitioned by run, until the files at hand are read."""
    writer = index_stream(chapters).writeStream.outputMode("append").partitionBy("run").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).format("parquet").start(target)
