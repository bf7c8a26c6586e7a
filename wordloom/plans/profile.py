"""Composite reports of a run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.functions.lexicon import language_code
from wordloom.operators import context, stats
from wordloom.operators.compare import measured
from wordloom.operators.index import on_counts, token_index
from wordloom.operators.stats import corpus_summary, ngram_frequencies, next_words, ranked, run_words, sentence_categories, word_frequencies
from wordloom.settings import AnalysisSettings
from wordloom.sinks.catalog import Catalog
from wordloom.sources import books


def _listed(top: DataFrame, column: str, between: str, **names: Column) -> DataFrame:
    """The ranked rows of each run as texts, each of the rows of a test; there are some a run."""
    lists = {k: F.array_sort(F.collect_list(F.when(test, F.struct("rank", column)))) for k, test in names.items()}
    return top.groupBy("run").agg(*(F.array_join(c[column], between).alias(k) for k, c in lists.items()))


def corpus_profile(chapters: DataFrame, n: int = 10, min_phrase_count: int = 3, min_phrase_chapters: int = 1) -> DataFrame:
    """Summary, number of books, difficulty, the most frequent content and function words, and the most frequent phrases (of two to
    five words, with content words at both ends, the longest only) of each run. Texts are scanned twice, for words and for phrases."""
    # Both uses of the words read all their columns, so the exchange is made once.
    table = run_words(chapters).where(on_counts((F.col("document_count") >= 0) & (F.least("documents", "sentence_count", "token_count") >= 0)))
    measures = ("content_share", "function_share", "long_share", "very_long_share", "lexical_diversity")
    summary = ("document_count", "sentence_count", "token_count", "word_token_count", "distinct_word_count", "average_words_per_sentence", "average_characters_per_word")
    out = measured(table).select("run", *summary, *measures, F.col("score").alias("difficulty_score"))
    out = out.join(chapters.groupBy("run").agg(F.countDistinct("book").alias("book_count")), "run")
    words = table.where(~F.col("is_total")).select("run", F.col("text").alias("word"), "count", X.is_stop_word(F.col("text"), F.col("run")).alias("is_stop_word"))
    stop = F.col("is_stop_word")
    top = ranked(words, stats.ORDERS["words"](), n, ("run", "is_stop_word"))
    out = out.join(_listed(top, "word", " ", top_content_words=~stop, top_function_words=stop), "run", "left")
    found = context.longest_only(context.content_phrases(chapters, 2, 5, min_phrase_count, min_phrase_chapters))
    out = out.join(_listed(ranked(found, stats.ORDERS["phrases"](), n), "phrase", "; ", top_phrases=F.lit(True)), "run", "left")
    return out.na.fill("", ["top_content_words", "top_function_words", "top_phrases"])


def analyse_folder(spark: SparkSession, folder: str, language: str, catalog: Catalog, corpus_id: int, settings: AnalysisSettings = AnalysisSettings(), pattern: str = "*.epub") -> int:
    """Import a folder's books into a corpus and save a run with their chapters, index and statistics; the run's id. Statistics are made from the
    stored chapters."""
    read, failures = books.read_books(spark, folder, language, pattern)
    path = f"{catalog.root}/imports/{uuid.uuid4().hex}"
    read.write.option("compression", "zstd").parquet(path)  # archives are unpacked once
    found = spark.read.schema(read.schema).parquet(path)
    if found.isEmpty():
        raise books.BookError(f"no readable book in {folder}: {failures.count()} failures")
    stored = catalog.store.save(books.run_chapters(found, language_code(language)))
    chapters = catalog.store.chapters(stored)
    catalog.add_books(corpus_id, found)
    links = found.groupBy("book_id").agg(F.min(F.lower("source_path")).alias("path"))
    links = links.select("book_id", F.row_number().over(Window.orderBy("path", "book_id")).alias("order_index"))  # a row a book
    run_id = catalog.save_run(corpus_id, {**analyse(chapters, settings), "tokens": token_index(chapters)}, links, settings, stored)
    catalog.fs.delete(catalog._path(path), True)
    return run_id


def analyse(chapters: DataFrame, settings: AnalysisSettings = AnalysisSettings()) -> dict[str, DataFrame]:
    """All statistics tables of the chapters' runs."""
    return {
        "summary": corpus_summary(chapters),
        "words": word_frequencies(chapters, settings),
        "ngrams": ngram_frequencies(chapters, settings),
        "next_words": next_words(chapters, settings),
        "categories": sentence_categories(chapters),
    }
