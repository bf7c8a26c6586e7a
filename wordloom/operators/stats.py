"""Statistics of a run: words, n-grams, word pairs, sentences and their classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.functions.measures import per_million, ratio_of
from wordloom.operators.grams import runs_with_totals
from wordloom.operators.index import counted, on_counts, with_totals
from wordloom.settings import AnalysisSettings, limit_of


def sentence_table(chapters: DataFrame) -> DataFrame:
    """A row for each sentence: run, book, chapter_id, sentence_index from 0, sentence, words."""
    split = F.posexplode(X.sentences(X.for_reading(F.col("text")))).alias("i", "sentence")
    rows = chapters.select("run", "book", "chapter_id", split)
    return rows.select("run", "book", "chapter_id", F.col("i").cast("bigint").alias("sentence_index"), "sentence", X.words(F.col("sentence")).alias("words"))


def word_frequencies(chapters: DataFrame, settings: AnalysisSettings = AnalysisSettings()) -> DataFrame:
    """Counts, numbers of documents, frequency per million and stop-word flag of each word of a run."""
    words = X.words(F.col("text"))
    out = with_totals(counted(chapters, words, total=F.size(words)), "total")
    if settings.min_word_length > 1:
        out = out.where(F.length("text") >= settings.min_word_length)
    return out.select(
        "run", F.col("text").alias("word"), "count", "document_count", per_million(F.col("count"), F.col("total")).alias("frequency_per_million"),
        X.is_stop_word(F.col("text"), F.col("run")).alias("is_stop_word"),
    )


def ranked(rows: DataFrame, order: list[Column], n: int, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """The first n rows (see limit_of) of each group in an order, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= limit_of(n))


def top_words(words: DataFrame, per_run: int = 100, word_class: str = "all") -> DataFrame:
    """The most frequent words of each run, all of them, content words or function words: count falling, then word."""
    if word_class == "content":
        words = words.where(~F.col("is_stop_word"))
    elif word_class == "function":
        words = words.where("is_stop_word")
    elif word_class != "all":
        raise ValueError(f"no such class of words: {word_class}")
    return ranked(words, ORDERS["words"](), per_run)


def word_detail(words: DataFrame, word: str) -> DataFrame:
    return words.where(F.col("word") == X.query_form(word))


def ngram_frequencies(chapters: DataFrame, settings: AnalysisSettings = AnalysisSettings()) -> DataFrame:
    """Runs of words within sentences that occur min_ngram_count times or more; per million of word tokens."""
    low, high, least = settings.ngram_min_n, settings.ngram_max_n, settings.min_word_length
    own = chapters.select("run", X.cut_sentences(F.col("text")).alias("words"))
    own = own.select("run", "words", F.size(F.array_compact("words")).alias("total"))
    out = runs_with_totals(own, low, high, settings.min_ngram_count, least).where(F.col("count") >= settings.min_ngram_count)
    return out.select("run", X.n_words(F.col("text")).alias("n"), "text", "count", "document_count", per_million(F.col("count"), F.col("total")).alias("frequency_per_million"))


def ngram_search(ngrams: DataFrame, term: str | None = None, n: int | None = None, min_count: int = 1) -> DataFrame:
    """N-grams that hold the term as whole words."""
    if n is not None:
        ngrams = ngrams.where(F.col("n") == n)
    if min_count > 1:
        ngrams = ngrams.where(F.col("count") >= min_count)
    if term and term.strip():
        own = " ".join(term.lower().split())
        ngrams = ngrams.where(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).contains(f" {own} "))
    return ngrams


#: The n-gram explorer's sort keys; ties go by count, frequency, n and text.
NGRAM_KEYS = {"count": [F.desc, "count"], "frequency": [F.desc, "frequency_per_million"], "documents": [F.desc, "document_count"], "text": [F.asc, "text"]}


def ngram_order(key: str) -> list[Column]:
    how, column = NGRAM_KEYS[key]
    return [how(column), F.desc("count"), F.desc("frequency_per_million"), F.asc("n"), F.asc("text")]


#: Orders of ranked results.
ORDERS = {
    "words": lambda: [F.desc("count"), F.asc("word")],
    "ngrams": lambda: [F.desc("count"), F.asc("n"), F.asc("text")],
    "next_words": lambda: [F.desc("count"), F.asc("word"), F.asc("next_word")],
    "collocations": lambda: [F.desc("dice"), F.desc("count"), F.desc("right_count"), F.asc("collocate")],
    "phrases": lambda: [F.desc("count"), F.desc("n"), F.asc("phrase")],
    "comparison": lambda: [F.desc("absolute_difference_per_million"), F.desc("total_count"), F.asc("word")],
    "books": lambda: [F.desc("count"), F.asc("book")],
}


def ngram_patterns(ngrams: DataFrame, kind: str = "all") -> DataFrame:
    """N-grams with their pattern of content (C) and function (F) words; kind: all, content, function or boundary (content
    words at both ends)."""
    letters = F.transform(F.split("text", " "), lambda w: F.when(X.is_stop_word_of(w, F.col("_code")), "F").otherwise("C"))
    out = ngrams.withColumn("_code", X.language_code(F.col("run"))).withColumn("pattern", F.array_join(letters, "-")).drop("_code")
    tests = {"all": F.lit(True), "content": ~F.col("pattern").contains("F"), "function": ~F.col("pattern").contains("C"), "boundary": F.col("pattern").startswith("C") & F.col("pattern").endswith("C")}
    return out if kind == "all" else out.where(on_counts(tests[kind]))


def next_words(chapters: DataFrame, settings: AnalysisSettings = AnalysisSettings()) -> DataFrame:
    """Successors within sentences of a run's most frequent words, and their probability among all successors of the word.

    A sentence's last word has no successor, so the counts of pairs also give those of words; texts are scanned once.
    """
    own = chapters.select("run", X.cut_sentences(F.col("text")).alias("word"))
    own = own.withColumn("next_word", F.slice("word", F.lit(2), F.greatest(F.size("word") - 1, F.lit(0))))  # null after a sentence's last word
    rows = own.select("run", F.explode(F.arrays_zip("word", "next_word")).alias("p")).select("run", "p.*").where(F.col("word").isNotNull())
    # Both uses of the pairs read both counts, so the exchange is made once.
    pairs = rows.groupBy("run", "word", "next_word").agg(F.count("*").alias("all"), F.count("next_word").alias("count"))
    words = pairs.groupBy("run", "word").agg(F.sum("all").alias("n"), F.sum("count").alias("total"))
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("n"), "word"))
    top = words.withColumn("r", place).where(F.col("r") <= settings.top_words_for_next_word_analysis).select("run", "word", "total")
    out = pairs.where((F.col("count") >= max(1, settings.min_next_word_pair_count)) & (F.col("all") >= 1)).join(F.broadcast(top), ["run", "word"])  # so many words a run
    return out.select("run", "word", "next_word", "count", ratio_of(F.col("count").cast("double"), F.col("total")).alias("probability"))


def neighbours(pairs: DataFrame, word: str, before: bool = False) -> DataFrame:
    """Rows of next_words with the word as first, or as second, of the pair."""
    return pairs.where(F.col("next_word" if before else "word") == X.query_form(word))


def sentence_categories(chapters: DataFrame) -> DataFrame:
    """Counts and percentages of the sentences' classes in each run."""
    rows = sentence_table(chapters).select("run", X.sentence_category(F.col("sentence"), F.col("words")).alias("category"))
    counts = rows.groupBy("run", "category").agg(F.count("*").alias("count"))
    totals = counts.groupBy("run").agg(F.sum("count").alias("total"))
    return counts.join(totals, "run").select("run", "category", "count", (F.col("count") * 100.0 / F.col("total")).alias("percentage"))


def sentence_tokens(chapters: DataFrame) -> DataFrame:
    """A row for each token of each sentence, with its kind and normalised form."""
    rows = sentence_table(chapters).select("run", "chapter_id", "sentence_index", F.posexplode(X.tokens(F.col("sentence"))).alias("i", "token_text"))
    kind = X.token_kind(F.col("token_text"))
    plain = F.translate("token_text", X.QUOTES, X.STRAIGHT)
    return rows.select("run", "chapter_id", "sentence_index", F.col("i").cast("bigint").alias("token_index"), "token_text", kind.alias("kind"), F.when(kind == "Word", F.lower(plain)).otherwise(plain).alias("normalized"))


def sentence_lengths(chapters: DataFrame, settings: AnalysisSettings = AnalysisSettings()) -> DataFrame:
    """Number of tokens of each sentence, without punctuation unless the settings say so."""
    own = X.tokens(F.col("sentence"))
    if not settings.include_punctuation_tokens:
        own = F.filter(own, lambda t: X.token_kind(t) != "Punctuation")
    return sentence_table(chapters).select("run", "chapter_id", "sentence_index", "sentence", F.size(own).cast("bigint").alias("token_count"))


def run_words(chapters: DataFrame) -> DataFrame:
    """Counts of words (text) by run, and on the rows with is_total the run's documents, sentences and tokens, after one scan."""
    own = chapters.withColumn("_sizes", F.transform(X.cut_text(F.col("text")), lambda s: F.size(X.tokens(s))))
    # A sentence has a token at least, a blank piece has none.
    own = own.withColumns({"_tokens": F.aggregate("_sizes", F.lit(0), lambda total, n: total + n), "_sentences": F.size(F.filter("_sizes", lambda n: n > 0))})
    return counted(own, X.words(F.col("text")), documents=F.lit(1), sentence_count=F.coalesce(F.greatest("_sentences", F.lit(0)), F.lit(0)), token_count=F.coalesce("_tokens", F.lit(0)))


def summed(words: DataFrame, **more: Column) -> DataFrame:
    """The summary of each run from :func:`run_words`; more: other sums over words."""
    own = ~F.col("is_total")
    sums = words.groupBy("run").agg(
        F.sum("documents").alias("document_count"), F.sum("sentence_count").alias("sentence_count"), F.sum("token_count").alias("token_count"), F.sum("count").alias("word_token_count"),
        F.count_if(own).alias("distinct_word_count"), F.sum(F.col("count") * F.length("text")).alias("chars"), *(F.sum(F.when(own & test, F.col("count")).otherwise(0)).alias(k) for k, test in more.items()),
    )
    return sums.select(
        "run", "document_count", "sentence_count", "token_count", "word_token_count", "distinct_word_count",
        ratio_of(F.col("word_token_count").cast("double"), F.col("sentence_count")).alias("average_words_per_sentence"),
        ratio_of(F.col("chars").cast("double"), F.col("word_token_count")).alias("average_characters_per_word"), *more,
    )


def corpus_summary(chapters: DataFrame) -> DataFrame:
    """Documents, sentences, tokens of all kinds, word tokens, distinct words, and the averages of each run."""
    return summed(run_words(chapters))
