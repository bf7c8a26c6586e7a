"""A corpus pipeline of four stages: language ID, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and is the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import language_id, line_dedup, ngram_join, packing
from wordloom.llm._common import new_folder, written

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter, and those that none of the classifier's languages claims, by a margin that is chosen on documents it
    hasn't been fitted on (see language_id.claimed).

    Where no document has a language to learn from, only those without a letter go.
    """
    return language_id.claimed(docs, *language_id.train_with_margin(docs))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated line chunks; documents of which nothing is left go."""
    out = line_dedup.dedup_lines(docs)
    return out.where((F.col("n_removed") == 0) | (F.length("text") > 0)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each class of near-duplicates the row with the smallest doc_id (nulls last), of several such rows one. All columns stay as they
    are: those that are added on the way have names that no column has."""
    row = next(x for x in (f"row{'_' * k}" for k in range(len(docs.columns) + 1)) if x not in docs.columns)
    rows, _ = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # written, so a row keeps its number
    classes = ngram_join.jaccard_classes(rows.select(F.col(row).alias("doc_id"), "text"))
    classes, _ = written(classes.select(F.col("doc_id").alias(row), F.col("component_id").alias("class")), "row-classes")
    ids = rows.select(row, F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col(row).alias("row"))
    large = classes.groupBy("class").count().where("count > 1").select("class")
    several = classes.join(large, "class", "left_semi")
    first = ids.join(several, row).groupBy("class").agg(F.min(order).alias("k")).select(F.col("k.row").alias(row))
    gone, _ = written(several.join(first, row, "left_anti").select(row), "near-duplicates")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("line_dedup", deduplicate_lines), ("ngram_jaccard_join", drop_near_duplicates), ("best_fit_packing", pack_sequences)]

#: No stage can be written in SQL whole; tests/llm compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
