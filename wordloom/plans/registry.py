"""Named queries over the test tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import cleaning, lexicon
from wordloom.functions import text as X
from wordloom.operators import books, compare, context, index, stats, stored
from wordloom.plans import oracles as O  # noqa: N812
from wordloom.plans import explore, profile
from wordloom.settings import AnalysisSettings
from wordloom.sinks.store import RunStore, shared_folder
from wordloom.sources import html
from wordloom.sources.tables import dialogue_chapters, document_chapters, labelled_chapters, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
STANDARD = AnalysisSettings()
TERM = "of the"


def _add(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None, source: Query = document_chapters) -> None:
    QUERIES[name] = lambda spark, folder: make(source(spark, folder))
    if sql is not None:
        ORACLES[name] = sql


_add("word_frequencies", stats.word_frequencies, O.word_frequencies())
_add("top_words", lambda c: stats.top_words(stats.word_frequencies(c), 100), O.top_words(100))
_add("top_content_words", lambda c: stats.top_words(stats.word_frequencies(c), 100, "content"), O.top_words(100, "not is_stop_word"))
_add("top_function_words", lambda c: stats.top_words(stats.word_frequencies(c), 100, "function"), O.top_words(100, "is_stop_word"))
_add("word_detail", lambda c: stats.word_detail(stats.word_frequencies(c), "The"), O.word_detail("the"))
_add("dialogue_word_frequencies", stats.word_frequencies, O.word_frequencies(O.TALK), dialogue_chapters)
_add("token_index", index.token_index, O.token_index())
_add("run_positions", index.run_positions, O.run_positions())
_add("token_index_summary", index.index_summary, O.index_summary())
_add("token_index_diagnostics", index.index_diagnostics, O.index_diagnostics())
_add("health", index.health, O.health())
_add("collocations", lambda c: context.collocations(c, "the", 4), O.collocations("the", 4))
_add("collocations_content", lambda c: context.collocations(c, "the", 4, word_class="content"), O.collocations("the", 4, f"not {O.stop('collocate')}"))
_add("collocations_min_dice", lambda c: context.collocations(c, "that", 2, min_count=5, min_dice=0.01), O.collocations("that", 2, "count >= 5 and dice >= 0.01::double"))
_add("kwic", lambda c: context.concordance(c, "That", 5), O.concordance("that", 5))
_add("phrases", lambda c: context.phrases(c, 2, 5, 3), O.phrases(2, 5, 3))
_add("phrases_with_boundary", lambda c: context.with_boundary(context.phrases(c, 2, 5, 3)), O.phrases(2, 5, 3, "boundary"))
_add("phrases_content_boundary", lambda c: context.content_boundary(context.phrases(c, 2, 5, 3)), O.phrases(2, 5, 3, "content"))
_add("phrases_min_chapters", lambda c: context.phrases(c, 2, 4, 2, min_chapters=3), f"select * from ({O.phrases(2, 4, 2)}) where chapter_count >= 3")
_add("phrases_longest_only", lambda c: context.longest_only(context.phrases(c, 2, 5, 3)), O.phrases(2, 5, 3, "longest"))
_add("sentences", lambda c: stats.sentence_table(c).select("run", "chapter_id", "sentence_index", "sentence"), O.sentences())
_add("sentence_tokens", stats.sentence_tokens, O.sentence_tokens())
_add("sentence_lengths", stats.sentence_lengths, O.sentence_lengths())
_add("corpus_summary", stats.corpus_summary, O.corpus_summary())
_add("ngrams", stats.ngram_frequencies, O.ngrams(2, 5, 2))
_add("ngrams_search", lambda c: stats.ngram_search(stats.ngram_frequencies(c), TERM, min_count=2), O.ngrams(2, 5, 2, f"contains(' ' || text || ' ', ' {TERM} ')"))
_add("ngrams_min_word_length", lambda c: stats.ngram_frequencies(c, AnalysisSettings(min_word_length=3, ngram_max_n=3)), O.ngrams(2, 3, 2, "len(list_filter(string_split(text, ' '), lambda x: length(x) < 3)) = 0"))
_add("ngram_patterns", lambda c: stats.ngram_patterns(stats.ngram_frequencies(c)), O.ngram_patterns(2, 5, 2))
_add("ngram_content_boundary", lambda c: stats.ngram_patterns(stats.ngram_frequencies(c), "boundary"), O.ngram_patterns(2, 5, 2, "pattern like 'C%C'"))
_add("next_words", stats.next_words, O.next_words(1000, 2))
_add("next_words_of", lambda c: stats.neighbours(stats.next_words(c), "the"), O.next_words(1000, 2, "word = 'the'"))
_add("previous_words_of", lambda c: stats.neighbours(stats.next_words(c), "the", before=True), O.next_words(1000, 2, "next_word = 'the'"))
_add("sentence_categories", stats.sentence_categories, O.sentence_categories())
_add("dialogue_categories", stats.sentence_categories, O.sentence_categories(O.TALK), dialogue_chapters)
_add("compare_word", lambda c: compare.compare_words(stats.word_frequencies(c), "en", "de").where("word = 'in'"), O.compare_words("en", "de", 1, "word = 'in'"))
_add("compare_words", lambda c: compare.compare_words(stats.word_frequencies(c), "en", "de", min_count=2), O.compare_words("en", "de", 2))
_add("compare_words_shared", lambda c: compare.compare_words(stats.word_frequencies(c), "en", "fr", "shared"), O.compare_words("en", "fr", 1, "left_count > 0 and right_count > 0"))
_add("compare_words_exclusive", lambda c: compare.compare_words(stats.word_frequencies(c), "fr", "es", "exclusive"), O.compare_words("fr", "es", 1, "(left_count = 0 or right_count = 0)"))
_add("compare_quality", lambda c: compare.compare_words(stats.word_frequencies(c), "good", "poor"), O.compare_words("good", "poor", 1, chapters=O.LABELLED), labelled_chapters)
_add("difficulty", compare.difficulty, O.difficulty())
_add("compare_difficulty", lambda c: compare.compare_difficulty(compare.difficulty(c), "en", "de"), O.compare_difficulty("en", "de"))
_add("language_note", lambda c: compare.language_note(c, "en", "de"), O.language_note())
_add("corpus_profile", lambda c: profile.corpus_profile(c, 10), O.corpus_profile(10, 2, 5, 3, 1))
_add("run_books", books.run_books, O.run_books())
_add("word_book_distribution", lambda c: books.word_distribution(c, "the"), O.word_distribution("the"))
_add("word_books_coverage", lambda c: books.word_coverage(c, "that"), O.word_coverage("that"))
_add("chapter_metrics", books.chapter_metrics, O.chapter_metrics())
_add("find_in_chapters", lambda c: books.find_in_chapters(c, "license"), O.find_in_chapters("license"))
_add("find_positions", lambda c: books.find_positions(c, "license"), O.find_positions("license"))
_add("import_diagnostics", books.import_diagnostics, O.import_diagnostics())
_add("suspicious_chapters", books.suspicious_chapters, O.suspicious_chapters())
_add("suspicious_terms", books.suspicious_terms, O.suspicious_terms())
_add("shortest_chapters", lambda c: books.extreme_chapters(c, longest=False), O.extreme_chapters("asc", 15))
_add("longest_chapters", lambda c: books.extreme_chapters(c, longest=True), O.extreme_chapters("desc", 15))
_add("normalize_text", lambda c: c.select("chapter_id", X.for_reading(F.col("text")).alias("reading"), X.inline(F.col("text")).alias("one_line"), X.key(F.col("text")).alias("key")), O.normalize_text())


# Explorers: the first rows of each run.
_HAS_THE = "contains(' ' || text || ' ', ' the ') and n = 3 and count >= 2"
_COLLOCATIONS = "dice desc, count desc, right_count desc, collocate"
_add("explore_next_words", lambda c: explore.next_words(c, limit=40), O.ranked(O.next_words(1000, 2), "count desc, word, next_word", 40))
_add("explore_next_words_of", lambda c: explore.next_words(c, "the", 20), O.ranked(O.next_words(1000, 2, "word = 'the'"), "count desc, next_word", 20))
_add("explore_previous_words", lambda c: explore.previous_words(c, "the", 20), O.ranked(O.next_words(1000, 2, "next_word = 'the'"), "count desc, word", 20))
for _key, _order in (("count", "count desc"), ("frequency", "frequency_per_million desc"), ("documents", "document_count desc"), ("text", "text")):
    _add(f"explore_ngrams_by_{_key}", lambda c, key=_key: explore.ngrams(c, sort=key, limit=30), O.ranked(O.ngram_patterns(2, 5, 2), f"{_order}, count desc, frequency_per_million desc, n, text", 30))
_add("explore_ngrams_filtered", lambda c: explore.ngrams(c, "the", 3, 2, "boundary", "documents", 20), O.ranked(f"select * from ({O.ngram_patterns(2, 5, 2, _HAS_THE)}) where pattern like 'C%C'", "document_count desc, count desc, frequency_per_million desc, n, text", 20))
_add("explore_collocations", lambda c: explore.collocations(c, "the", 4, 2, 0.001, "content", 30), O.ranked(O.collocations("the", 4, f"count >= 2 and dice >= 0.001::double and not {O.stop('collocate')}"), _COLLOCATIONS, 30))
_add("explore_collocations_compat", lambda c: explore.collocations(c, "the", 4, 2, 0.0, "content", 5, compat=True), O.ranked(f"select * exclude (rank) from ({O.ranked(O.collocations('the', 4), _COLLOCATIONS, 200)}) where count >= 2 and not {O.stop('collocate')}", _COLLOCATIONS, 5))
_add("explore_phrases", lambda c: explore.phrases(c, 2, 5, 3, 2, limit=30), O.ranked(f"select * from ({O.phrases(2, 5, 3, 'boundary')}) where chapter_count >= 2", "count desc, n desc, phrase", 30))
_add("explore_phrases_content", lambda c: explore.phrases(c, 2, 3, 3, 1, content_boundary=True, limit=30), O.ranked(f"select * from ({O.phrases(2, 3, 3, 'boundary')}) where boundary = 'content/content'", "count desc, n desc, phrase", 30))
_add("explore_comparison", lambda c: explore.comparison(stats.word_frequencies(c), "en", "de", min_count=2, limit=50), O.ranked(O.compare_words("en", "de", 2), "absolute_difference_per_million desc, total_count desc, word", 50, ""))
_add("explore_comparison_exclusive", lambda c: explore.comparison(stats.word_frequencies(c), "fr", "es", "exclusive", 2, "content", 50), O.ranked(O.compare_words("fr", "es", 2, "(left_count = 0 or right_count = 0) and not is_function_word"), "absolute_difference_per_million desc, total_count desc, word", 50, ""))
_add("explore_word", lambda c: explore.word(c, "the", 10, 10, 4, 10), O.word_explorer("the", 10, 10, 4, 10))


def _language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The language profiles, with the numbers of a corpus' documents in each language and of their words that are its stop words."""
    rows = [(*p, len(lexicon.STOP_WORDS[p[0]])) for p in lexicon.PROFILES]
    profiles = spark.createDataFrame(rows, "code string, name string, family string, long_word_length bigint, very_long_word_length bigint, apostrophes string, stop_word_count bigint")
    own = index.index_summary(document_chapters(spark, folder)).select(F.col("run").alias("code"), F.col("chapter_count").alias("document_count"), "stop_word_token_count")
    return profiles.join(own, "code", "left").na.fill(0, ["document_count", "stop_word_token_count"])


def _source_books(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("lang").alias("run_id"), F.col("source").alias("book_id"))
    links = docs.where("run_id <> 'es'").distinct()  # the tables link no books, so one run is left without links to show its fallback
    links = links.withColumn("order_index", F.lit(2))
    return books.source_books(docs.groupBy("run_id").agg(F.min("book_id").alias("book_id")), links)


QUERIES["language_profiles"], ORACLES["language_profiles"] = _language_profiles, O.language_profiles()
QUERIES["source_books"], ORACLES["source_books"] = _source_books, O.source_books()


def _marked(chapters: DataFrame) -> DataFrame:
    marked = F.concat(F.lit(O.MARKED[0]), "text", F.lit(O.MARKED[1]))
    return chapters.select("chapter_id", cleaning.without_markers(marked).alias("text"))


_add("boilerplate_markers", _marked, O.boilerplate_markers())


def _cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """The pages' texts, with a book's matter around them, after cleaning."""
    parts = [F.lit(a) if b is None else F.concat(F.lit(a), "text", F.lit(b)) for a, b in O.MATTER]
    around = F.element_at(F.array(*parts), (F.col("page_id") % len(parts) + 1).cast("int"))
    books = html.page_texts(table(spark, folder, "pages")).select("page_id", around.alias("page"))
    return cleaning.with_cleaned(books, F.col("page")).select("page_id", "text", "is_front_matter")


QUERIES["boilerplate_clean"], ORACLES["boilerplate_clean"] = _cleaned, O.boilerplate_clean()
QUERIES["html_to_text"], ORACLES["html_to_text"] = lambda spark, folder: html.page_texts(table(spark, folder, "pages")), O.html_to_text()


# Saved runs: each query saves the corpus as a run and reads it back.


def _add_stored(name: str, ask: Callable[[RunStore, int], DataFrame], sql: str) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        store = RunStore(spark, shared_folder(spark, "runs"))
        return ask(store, store.save(document_chapters(spark, folder), name))

    QUERIES[name], ORACLES[name] = query, sql


def _changed(spark: SparkSession, folder: str) -> DataFrame:
    """Words of a run to which a book has been added, and from which others have been taken."""
    chapters, store = document_chapters(spark, folder), RunStore(spark, shared_folder(spark, "runs"))
    run_id = store.save(chapters.where(F.col("book") != O.ADDED))
    store.append(run_id, chapters.where(F.col("book") == O.ADDED))
    store.delete_books(run_id, list(O.REMOVED))
    return store.words(run_id)


def _faults(store: RunStore, run_id: int) -> DataFrame:
    """Faults of an index in which a book is missing, one has lost words, one is held twice, and one has chapters the run hasn't."""
    own, book = store.postings(run_id), F.col("book")
    sound = own.where((book != O.FAULTS["missing"]) & ~((book == O.FAULTS["lost"]) & F.col("word").isin(*O.LOST_WORDS)))
    twice = own.where(book == O.FAULTS["twice"])
    strange = own.where((book == O.FAULTS["unknown"]) & F.col("word").isin(*O.LOST_WORDS)).withColumn("chapter_id", F.col("chapter_id") + O.FAR)
    store.replace_index(run_id, sound.union(twice).union(strange))
    return stored.index_faults(store, run_id)


_add_stored("stored_chapters", lambda s, r: stored.chapters(s, r).drop("title"), O.stored_chapters())
_add_stored("stored_kwic", lambda s, r: stored.concordance(s, r, "That", 5), O.concordance("that", 5))
_add_stored("stored_collocations", lambda s, r: stored.collocations(s, r, "that", 2, min_count=5, min_dice=0.01), O.collocations("that", 2, "count >= 5 and dice >= 0.01::double"))
_add_stored("stored_phrases", lambda s, r: stored.phrases(s, r, 2, 5, 3), O.phrases(2, 5, 3))
_add_stored("stored_word_books", lambda s, r: stored.word_distribution(s, r, "the"), O.word_distribution("the"))
_add_stored("stored_word_coverage", lambda s, r: stored.word_coverage(s, r, "that"), O.word_coverage("that"))
_add_stored("stored_index_diagnostics", stored.index_diagnostics, O.index_diagnostics())
_add_stored("stored_index_faults", _faults, O.index_faults())
QUERIES["stored_words_after_changes"], ORACLES["stored_words_after_changes"] = _changed, O.word_frequencies(O.LEFT)
