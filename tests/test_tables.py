"""Tables as sources: over how many tasks their rows are dealt."""

from pyspark.sql import functions as F

from wordloom.sources import tables


def _most(rows):
    """Rows, and those of the task that has most."""
    n = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    return sum(n), max(n)


def test_a_large_file_of_one_group_of_rows_is_dealt(spark, tmp_path, monkeypatch):
    """One task read, cut and counted all of a large file that has one group of rows."""
    monkeypatch.setattr(tables, "SMALL_SOURCE", 0)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("b").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plain = tables.table(spark, str(tmp_path), "documents")
    assert _most(plain) == (4000, 4000)
    dealt = tables.document_chapters(spark, str(tmp_path))
    assert _most(dealt) == (4000, 1000)
    assert sorted(r["chapter_id"] for r in dealt.select("chapter_id").collect()) == list(range(4000))


def test_files_that_are_dealt_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SMALL_SOURCE", 0)
    spark.range(4000).repartition(16).write.parquet(f"{tmp_path}/a.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1k")
        rows = tables.table(spark, str(tmp_path), "a")
        assert tables.spread(rows) is rows
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    empty = spark.createDataFrame([], "id bigint")
    assert tables.spread(empty).count() == 0
