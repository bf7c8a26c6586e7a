"""Explorers: ranked and limited results for each run.

Filters come before limits, and limits and lengths out of their bounds are errors. With ``compat`` filters see only the first rows of a
ranking, as many as a fixed multiple of the limit but 1000 at most, which is how a store that limits every fetch behaves; "exclusive" words
are then those not among the other run's first ones; and limits and lengths become the nearest within bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators import books, compare, context, stats
from wordloom.operators.stats import ORDERS, ngram_order, ranked
from wordloom.settings import MOST_ROWS, MOST_SHOWN, PHRASE, AnalysisSettings, bounded, clamp, context_of, limit_of, phrase_lengths, window_of

#: Rows that are fetched for each row shown, and the least number of them.
FETCHED = {"collocations": (20, 200), "ngrams": (20, 300), "phrases": (40, 500), "comparison": (100, 2000)}


def _first(rows: DataFrame, kind: str, order: list[Column], limit: int, compat: bool, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """With compat, the rows that filters see."""
    if not compat:
        return rows
    times, least = FETCHED[kind]
    return ranked(rows, order, clamp(times * limit, least, MOST_ROWS), by).drop("rank")


def _rank_last(rows: DataFrame) -> DataFrame:
    return rows.select(*(c for c in rows.columns if c != "rank"), "rank")


def next_words(chapters: DataFrame, word: str | None = None, limit: int = 50, settings: AnalysisSettings = AnalysisSettings(), compat: bool = False) -> DataFrame:
    """The most frequent pairs of neighbours, or successors of a word."""
    pairs = stats.next_words(chapters, settings)
    return ranked(stats.neighbours(pairs, word) if word and word.strip() else pairs, ORDERS["next_words"](), limit_of(limit, MOST_ROWS, compat))


def previous_words(chapters: DataFrame, word: str, limit: int = 50, settings: AnalysisSettings = AnalysisSettings(), compat: bool = False) -> DataFrame:
    """The most frequent predecessors of a word."""
    return ranked(stats.neighbours(stats.next_words(chapters, settings), word, before=True), ORDERS["next_words"](), limit_of(limit, MOST_ROWS, compat))


def ngrams(chapters: DataFrame, term: str | None = None, n: int | None = None, min_count: int = 1, kind: str = "all", sort: str = "count", limit: int = 50, compat: bool = False, settings: AnalysisSettings = AnalysisSettings()) -> DataFrame:
    """N-grams that hold a term, of a pattern of content and function words, in one of the orders of stats.NGRAM_KEYS."""
    limit = limit_of(limit, MOST_SHOWN, compat)
    n = None if n is None else bounded("words of an n-gram", n, *PHRASE, compat)
    found = stats.ngram_search(stats.ngram_frequencies(chapters, settings), term, n, min_count)
    found = _first(found, "ngrams", ngram_order(sort), limit, compat)
    if kind != "all":
        return ranked(stats.ngram_patterns(found, kind), ngram_order(sort), limit)
    return _rank_last(stats.ngram_patterns(ranked(found, ngram_order(sort), limit)))  # patterns of the rows shown only


def collocations(chapters: DataFrame, word: str, window: int = 4, min_count: int = 1, min_dice: float = 0.0, word_class: str = "all", limit: int = 50, compat: bool = False) -> DataFrame:
    """Collocations of a word by Dice coefficient."""
    limit = limit_of(limit, MOST_SHOWN, compat)
    found = _first(context.collocations(chapters, word, window_of(window, compat)), "collocations", ORDERS["collocations"](), limit, compat)
    return ranked(context.matching(found, min_count, min_dice, word_class), ORDERS["collocations"](), limit)


def phrases(chapters: DataFrame, low: int = 2, high: int = 5, min_count: int = 2, min_chapters: int = 1, content_boundary: bool = False, longest: bool = False, limit: int = 50, compat: bool = False) -> DataFrame:
    """Repeated phrases, with the classes of their first and last words."""
    limit = limit_of(limit, MOST_SHOWN, compat)
    found = _first(context.phrases(chapters, *phrase_lengths(low, high, compat), min_count), "phrases", ORDERS["phrases"](), limit, compat).where(F.col("chapter_count") >= min_chapters)
    if content_boundary:
        found = context.content_boundary(found)
    if longest:
        found = context.longest_only(found)
    return _rank_last(context.with_boundary(ranked(found, ORDERS["phrases"](), limit)))  # classes of the rows shown only


def comparison(words: DataFrame, left: str, right: str, presence: str = "any", min_count: int = 1, word_class: str = "all", limit: int = 50, compat: bool = False) -> DataFrame:
    """Words of two runs by the difference of their frequencies; words: of stats.word_frequencies."""
    limit = limit_of(limit, MOST_ROWS, compat)
    if word_class != "all":
        words = words.where(F.col("is_stop_word") == (word_class == "function")) if compat else words
    words = _first(words, "comparison", ORDERS["words"](), limit, compat)
    return ranked(compare.compare_words(words, left, right, presence, min_count, word_class), ORDERS["comparison"](), limit, ())


def word(chapters: DataFrame, word: str, related: int = 20, contexts: int = 20, context_words: int = 5, book_limit: int = 20, settings: AnalysisSettings = AnalysisSettings(), compat: bool = False) -> DataFrame:
    """Everything about a word of each run: run, section, rank, item, count, value.

    Sections: word (count, per million), next and previous (count, probability), context (its place; left, word and right), book (count,
    per million). Of runs without the word there is nothing.
    """
    related, contexts, book_limit = (limit_of(x, MOST_SHOWN, compat) for x in (related, contexts, book_limit))
    pairs = stats.next_words(chapters, settings)
    own = stats.ranked(stats.word_detail(stats.word_frequencies(chapters, settings), word), [F.col("word")], 1)
    lines = context.concordance(chapters, word, context_of(context_words, compat))
    none = F.lit(None).cast("double")

    def section(name: str, rows: DataFrame, order: list[Column], n: int, item: Column, value: Column, count: str = "count") -> DataFrame:
        return ranked(rows, order, n).select("run", F.lit(name).alias("section"), "rank", item.alias("item"), F.col(count).alias("count"), value.alias("value"))

    out = own.select("run", F.lit("word").alias("section"), "rank", F.col("word").alias("item"), "count", F.col("frequency_per_million").alias("value"))
    for more in (
        section("next", stats.neighbours(pairs, word), ORDERS["next_words"](), related, F.col("next_word"), F.col("probability")),
        section("previous", stats.neighbours(pairs, word, before=True), ORDERS["next_words"](), related, F.col("word"), F.col("probability")),
        section("context", lines, [F.col("book"), F.col("chapter_id"), F.col("occurrence_index")], contexts, F.concat_ws(" | ", "left_context", "token_text", "right_context"), none, "chapter_position"),
        section("book", books.word_distribution(chapters, word), ORDERS["books"](), book_limit, F.col("book"), F.col("frequency_per_million")),
    ):
        out = out.union(more)
    return out.where(F.lit(X.query_form(word) != ""))
