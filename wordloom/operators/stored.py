"""Queries on a saved run (see :mod:`wordloom.sinks.store`): its index and counts are read instead of all its texts. Of a run that was saved without
an index, the stored texts are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.functions.measures import dice, per_million, ratio_of
from wordloom.operators import books as of_books
from wordloom.operators import context as of_texts
from wordloom.operators.context import around, lines, matching, phrases_in
from wordloom.operators.index import warnings_of, with_deviations
from wordloom.settings import context_of, window_of
from wordloom.sinks.store import KEYS, RunStore


def _places(store: RunStore, run_id: int, word: str) -> DataFrame:
    """The chapters that have the word, with its positions (at) and their forward index."""
    at = store.postings(run_id, word).select(*KEYS, F.col("positions").alias("at"))
    return store.tokens(run_id).join(at, KEYS)


def concordance(store: RunStore, run_id: int, word: str, context: int = 5) -> DataFrame:
    """:func:`wordloom.operators.context.concordance` of a saved run: the word's postings tell which chapters are looked at, and where."""
    if not store.indexed(run_id):
        return of_texts.concordance(store.chapters(run_id), word, context)
    return lines(_places(store, run_id, X.query_form(word)), context_of(context))


def collocations(store: RunStore, run_id: int, word: str, window: int = 4, min_count: int = 1, min_dice: float = 0.0, word_class: str = "all") -> DataFrame:
    """:func:`wordloom.operators.context.collocations` of a saved run. Only windows are counted; the words' own counts are stored."""
    if not store.indexed(run_id):
        return of_texts.collocations(store.chapters(run_id), word, window, min_count, min_dice, word_class)
    target = X.query_form(word)
    own = _places(store, run_id, target).select("run", "words", F.transform("at", lambda p: p.cast("int")).alias("at"))
    rows = own.select("run", F.explode(around(target, window_of(window))).alias("p")).select("run", "p.*")
    found = rows.groupBy("run", "collocate").agg(F.count_if(F.col("offset") < 0).alias("left_count"), F.count_if(F.col("offset") > 0).alias("right_count"), F.sum(F.abs("offset")).alias("distance"))
    counts = store.words(run_id).select("run", F.col("word").alias("collocate"), F.col("count").alias("collocate_count"))
    targets = store.postings(run_id, target).groupBy("run").agg(F.sum("n").alias("target_count"))
    out = found.withColumn("count", F.col("left_count") + F.col("right_count")).join(counts, ["run", "collocate"]).join(targets, "run")
    out = out.select(
        "run", F.lit(target).alias("word"), "collocate", "count", "left_count", "right_count",
        ratio_of(F.col("count").cast("double"), F.col("target_count")).alias("rate_per_target"),
        ratio_of(F.col("distance").cast("double"), F.col("count")).alias("average_distance"),
        dice(F.col("count"), F.col("target_count"), F.col("collocate_count")).alias("dice"),
    )
    return matching(out, min_count, min_dice, word_class)


def word_distribution(store: RunStore, run_id: int, word: str) -> DataFrame:
    """:func:`wordloom.operators.books.word_distribution` of a saved run: the word's postings, and a row of numbers for each chapter."""
    if not store.indexed(run_id):
        return of_books.word_distribution(store.chapters(run_id), word)
    hits = store.postings(run_id, X.query_form(word)).groupBy("run", "book").agg(F.sum("n").alias("count"))
    sizes = store.chapters(run_id).groupBy("run", "book").agg(F.count("*").alias("chapter_count"), F.sum(F.length("text")).alias("character_count"))
    tokens = store.positions(run_id).groupBy("run", "book").agg(F.sum("tokens").alias("word_token_count"))
    out = hits.join(tokens, ["run", "book"]).join(sizes, ["run", "book"])
    return out.select("run", "book", "chapter_count", "character_count", "word_token_count", "count", per_million(F.col("count"), F.col("word_token_count")).alias("frequency_per_million"))


def word_coverage(store: RunStore, run_id: int, word: str) -> DataFrame:
    """:func:`wordloom.operators.books.word_coverage` of a saved run: of the books only names are read."""
    if not store.indexed(run_id):
        return of_books.word_coverage(store.chapters(run_id), word)
    have = store.postings(run_id, X.query_form(word)).select("run", "book").distinct().withColumn("has", F.lit(1))
    books = store.chapters(run_id).select("run", "book").distinct().join(have, ["run", "book"], "left")
    sums = books.groupBy("run").agg(F.count("has").alias("matched_books"), F.count("*").alias("source_books"))
    return sums.withColumn("coverage_percentage", ratio_of(F.col("matched_books") * 100.0, F.col("source_books")))


def phrases(store: RunStore, run_id: int, low: int = 2, high: int = 5, min_count: int = 2, min_chapters: int = 1) -> DataFrame:
    """:func:`wordloom.operators.context.phrases` of a saved run, from the forward index."""
    if not store.indexed(run_id):
        return of_texts.phrases(store.chapters(run_id), low, high, min_count, min_chapters)
    return phrases_in(store.tokens(run_id).select("run", "words", "gaps"), low, high, min_count, min_chapters)


def chapters(store: RunStore, run_id: int, run: str | None = None, book: str | None = None) -> DataFrame:
    """Chapters in reading order: of all books, or of one, which Parquet's statistics find in the sorted buckets."""
    own = store.chapters(run_id)
    if run is not None:
        own = own.where(F.col("run") == run)
    if book is not None:
        own = own.where(F.col("book") == book)
    size = F.length("text").cast("bigint").alias("character_count")
    rows = own.select(*KEYS, "title", size, "word_count", "sentence_count")
    return rows.orderBy(*KEYS)


def books(store: RunStore, run_id: int, links: DataFrame | None = None) -> DataFrame:
    """run, book, order_index of a saved run: the books that it is linked with (run, book, order_index), and of runs without links those of
    which it has chapters, by name."""
    own = store.chapters(run_id).select("run", "book").distinct()
    own = own.withColumn("order_index", F.row_number().over(Window.partitionBy("run").orderBy("book")).cast("bigint"))  # a row a book
    if links is None:
        return own
    linked = links.select("run", "book", F.col("order_index").cast("bigint").alias("order_index"))
    return linked.union(own.join(linked.select("run").distinct(), "run", "left_anti"))


# The stored index itself


def _indexed(store: RunStore, run_id: int) -> DataFrame:
    """Of each chapter in the inverted index: tokens, and the first and last of their positions."""
    own = store.postings(run_id)
    return own.groupBy(*KEYS).agg(F.sum("n").alias("tokens"), F.min(F.element_at("positions", 1)).cast("bigint").alias("low"), F.max(F.element_at("positions", -1)).cast("bigint").alias("high"))


def index_diagnostics(store: RunStore, run_id: int) -> DataFrame:
    """What the stored inverted index holds against what the stored chapters should give: counts, run positions, gaps, delta and coverage."""
    chapters = store.chapters(run_id)
    expected = chapters.groupBy("run").agg(F.sum("word_count").alias("expected_word_token_count"), F.count("*").alias("expected_chapter_count"), F.countDistinct("book").alias("source_book_count"))
    indexed = _indexed(store, run_id).groupBy("run").agg(F.sum("tokens").alias("indexed_word_token_count"), F.count("*").alias("indexed_chapter_count"), F.countDistinct("book").alias("indexed_book_count"))
    spans = store.positions(run_id).groupBy("run").agg(F.min("first_run_position").alias("first_run_position"), F.max("last_run_position").alias("last_run_position"))
    return with_deviations(expected.join(indexed, "run", "left").join(spans, "run", "left"))


def health(store: RunStore, run_id: int) -> DataFrame:
    """Whether a saved run's index is sound, and what isn't."""
    return warnings_of(index_diagnostics(store, run_id))


#: Run positions in a range, at whose borders neighbours are looked up apart.
RANGE = 1 << 20


def span_faults(spans: DataFrame, width: int = RANGE) -> DataFrame:
    """Gaps and overlaps between neighbouring spans of run positions (run, book, chapter_id, first_run_position, last_run_position).

    Neighbours are found inside ranges of positions, each a group of its own; the greatest end of the ranges before comes from a table of
    one row a range. So no task sees a whole run.
    """
    first, last = F.col("first_run_position"), F.col("last_run_position")
    own = spans.withColumn("_range", F.floor(first / width))
    earlier = Window.partitionBy("run").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = own.groupBy("run", "_range").agg(F.max(last).alias("_end")).select("run", "_range", F.max("_end").over(earlier).alias("_before"))
    inside = Window.partitionBy("run", "_range").orderBy("first_run_position", "last_run_position", "book", "chapter_id").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_inside", F.max(last).over(inside)).join(ranges, ["run", "_range"])
    end = F.coalesce(F.greatest("_inside", "_before"), F.lit(0))
    fault = F.when(first > end + 1, "run position gap").when(first <= end, "run position overlap")
    low, high = F.least(end + 1, first), F.greatest(first - 1, F.least(end, last))
    return own.select(*KEYS, fault.alias("fault"), low.alias("first"), high.alias("last")).where("fault is not null")


def index_faults(store: RunStore, run_id: int) -> DataFrame:
    """run, book, chapter_id, fault, first, last: each place where the stored index and the stored chapters disagree.

    * missing chapter: it has words but nothing in the index; unknown chapter: the index has it, the run doesn't;
    * token gap: positions first to last of a chapter have no word; repeated token: position first is held last times (last is the number);
    * run position gap, run position overlap: between this chapter's span of run positions and those before it.

    Chapters are compared by joins on their keys, and only the positions of those whose numbers don't agree are looked at one by one.
    """
    chapters, indexed = store.chapters(run_id).select(*KEYS, "word_count"), _indexed(store, run_id)
    none = F.lit(None).cast("bigint")
    missing = chapters.where("word_count > 0").join(indexed, KEYS, "left_anti").select(*KEYS, F.lit("missing chapter").alias("fault"), F.lit(1).cast("bigint").alias("first"), F.col("word_count").alias("last"))
    unknown = indexed.join(chapters, KEYS, "left_anti").select(*KEYS, F.lit("unknown chapter"), none, none)
    both = indexed.join(chapters, KEYS).where((F.col("tokens") != F.col("word_count")) | (F.col("low") != 1) | (F.col("high") != F.col("word_count")))
    # A chapter's own positions, with its end as one more place, which holds no token. It comes from the same rows: a union with a row for each chapter may be
    # taken as dealt by chapters where it isn't, and positions and end then meet in no window.
    held = F.transform(F.coalesce("positions", F.array().cast("array<int>")), lambda p: F.struct(p.cast("bigint").alias("at"), F.lit(True).alias("held")))
    end = F.array(F.struct((F.col("word_count") + 1).alias("at"), F.lit(False).alias("held")))
    at = store.postings(run_id).join(both.select(*KEYS, "word_count"), KEYS).select(*KEYS, F.explode(F.concat(held, end)).alias("p")).select(*KEYS, "p.*")
    counts = at.groupBy(*KEYS, "at").agg(F.count_if("held").alias("count"))
    repeated = counts.where("count > 1").select(*KEYS, F.lit("repeated token"), "at", "count")
    before = F.coalesce(F.lag("at").over(Window.partitionBy(*KEYS).orderBy("at")), F.lit(0))
    gaps = counts.withColumn("_before", before).where(F.col("at") > F.col("_before") + 1).select(*KEYS, F.lit("token gap"), F.col("_before") + 1, F.col("at") - 1)
    return missing.union(unknown).union(repeated).union(gaps).union(span_faults(store.positions(run_id)))
