"""The positional token index of chapters.

A chapter is a row (run, book, chapter_id, text). Its index is arrays: the words, the words as they are written, and the gaps before
them, each made by a regular expression's scan of the text where a query needs it. Most queries work on the arrays, so they need no
join and no shuffle before their aggregation. The exploded form has a row for each token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.functions.measures import ratio_of


def word_arrays(chapters: DataFrame) -> DataFrame:
    """run, book, chapter_id, words."""
    return chapters.select("run", "book", "chapter_id", X.words(F.col("text")).alias("words"))


def index_arrays(chapters: DataFrame) -> DataFrame:
    """run, book, chapter_id, words, gaps, raws (words as they are written)."""
    return chapters.select("run", "book", "chapter_id", X.words(F.col("text")).alias("words"), X.gaps(F.col("text")).alias("gaps"), X.raw_words(F.col("text")).alias("raws"))


def counted(chapters: DataFrame, items: Column, /, **sums: Column) -> DataFrame:
    """run, text, count, document_count of the items (an array of strings that aren't empty) of each chapter, after one scan.

    A chapter's items, then each distinct one once more, are exploded and summed up together: occurrences and chapters are both told
    by the place in the array, so no chapter is shuffled, only (run, text) and their sums. Each chapter also gives one row of empty
    text, which carries the chapter's own ``sums``; is_total marks the run's sum of these rows.
    """
    own = chapters.select("run", items.alias("_items"), *(c.alias(k) for k, c in sums.items()))
    # The size is a column of its own before the explosion, else each exploded row would carry the array.
    own = own.select("run", F.coalesce("_items", X.none()).alias("_items"), *sums).select("run", "_items", F.size("_items").alias("_k"), *sums)
    rows = own.select("run", "_k", *sums, F.posexplode(F.concat(F.array(F.lit("")), "_items", F.array_distinct("_items"))).alias("_i", "text"))
    first = F.col("_i") == 0
    return rows.groupBy("run", "text").agg(
        F.count_if(~first & (F.col("_i") <= F.col("_k"))).alias("count"), F.count_if(F.col("_i") > F.col("_k")).alias("document_count"),
        F.max(first).alias("is_total"), *(F.sum(F.when(first, F.col(k)).otherwise(0)).cast("bigint").alias(k) for k in sums),
    )


def on_counts(test: Column) -> Column:
    """A test of rows with counts that the optimizer can't push below the counting: where the counts are used twice, both uses then
    share one exchange, and texts are scanned once."""
    return test | (F.col("count") < 0)


def with_totals(counts: DataFrame, *sums: str) -> DataFrame:
    """Rows of :func:`counted` other than totals, with the run's sums.

    Both sides read all columns of the same aggregation, so its exchange is made once and used twice. There is a total a run.
    """
    some = F.col("is_total") & (F.col("count") >= 0) & (F.col("document_count") >= 0)
    totals = counts.where(some).select("run", *(F.col(c) for c in sums))
    own = counts.where(~F.col("is_total") & (F.greatest(*sums, F.lit(0)) >= 0)).drop("is_total", *sums)
    return own.join(F.broadcast(totals), "run")


#: Tokens whose sizes are added up at once, so no offset takes a sum over a whole chapter.
STRIDE = 64


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0), lambda total, x: total + x)


def with_offsets(own: DataFrame) -> DataFrame:
    """``own`` (with gaps and raws) and the arrays sizes, of gaps and words together, and so_far, ends of each STRIDE of them."""
    own = own.withColumn("sizes", F.zip_with("gaps", "raws", lambda g, w: F.length(g) + F.length(w)))
    strides = F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / STRIDE).cast("int")), lambda k: _sum(F.slice("sizes", k * STRIDE + 1, STRIDE)))
    ends = F.aggregate(strides, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
    return own.withColumn("so_far", F.when(F.size("sizes") > 0, ends))


def end_offset(position: Column) -> Column:
    """Where the word at a position from 1 ends; for rows of :func:`with_offsets`."""
    k = F.floor(position / STRIDE).cast("int")
    return F.element_at("so_far", k + 1) + _sum(F.slice("sizes", k * STRIDE + 1, position - k * STRIDE))


def token_index(chapters: DataFrame) -> DataFrame:
    """A row for each token: chapter_position from 1, token_text, word, start_offset, end_offset, is_stop_word. Nothing is shuffled."""
    own = chapters.select("run", "book", "chapter_id", X.gaps_and_words(F.col("text")).alias("pieces")).where(F.size("pieces") > 0)
    own = own.withColumn("parts", F.transform(F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / STRIDE).cast("int")), lambda k: F.slice("pieces", k * STRIDE + 1, STRIDE)))
    # An offset is a stride's beginning and the length of the stride's text up to the word, so nothing is added up token by token.
    begin = F.aggregate("parts", F.array(F.lit(0)), lambda done, part: F.concat(done, F.array(F.element_at(done, -1) + F.length(F.array_join(part, "")))))
    own = own.withColumn("code", X.language_code(F.col("run")))
    own = own.select("run", "book", "chapter_id", "code", F.posexplode(F.arrays_zip("parts", F.slice(begin, 1, F.size("parts")).alias("begin"))).alias("k", "s"))
    rows = own.select("run", "book", "chapter_id", "code", "k", F.col("s.begin").alias("begin"), F.col("s.parts").alias("part")).select("*", F.posexplode("part").alias("i", "piece"))
    rows = rows.withColumns({"end": F.col("begin") + F.length(F.array_join(F.slice("part", F.lit(1), F.col("i") + 1), "")), "token_text": X.without_gap(F.col("piece"))})
    word = X.word_form(F.col("token_text"))
    return rows.select(
        "run", "book", "chapter_id", (F.col("k") * STRIDE + F.col("i") + 1).cast("bigint").alias("chapter_position"), "token_text", word.alias("word"),
        (F.col("end") - F.length("token_text")).cast("bigint").alias("start_offset"), F.col("end").cast("bigint").alias("end_offset"), X.is_stop_word_of(word, F.col("code")).alias("is_stop_word"),
    )


def prefix_sums(rows: DataFrame, groups: list[str], order: str, value: str, width: int = 4096) -> DataFrame:
    """``rows`` with ``before``: the sum of value over the group's rows of smaller order (an integer column, unique in a group).

    Ranges of ``width`` order values are summed apart, so no task sees a whole group.
    """
    cut = rows.withColumn("_range", F.floor(F.col(order) / width))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy(*groups, "_range").agg(F.sum(value).alias("_sum")).select(*groups, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*groups, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(ranges, [*groups, "_range"]).withColumn("before", F.col("_own") + F.col("_base")).drop("_range", "_own", "_base")


def run_positions(chapters: DataFrame) -> DataFrame:
    """run, book, chapter_id, tokens, first_run_position and last_run_position of each chapter with tokens; positions count
    from 1 through a run's books (in order of name) and their chapters (in order of id)."""
    return positions_of(word_arrays(chapters).select("run", "book", "chapter_id", F.size("words").cast("bigint").alias("tokens")))


def positions_of(sizes: DataFrame) -> DataFrame:
    """:func:`run_positions` of chapters whose numbers of tokens are known. All that is made of them reads one exchange, so they are made once."""
    sizes = sizes.groupBy("run", "book", "chapter_id").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.partitionBy("run").orderBy("book").rowsBetween(Window.unboundedPreceding, -1)
    books = sizes.groupBy("run", "book").agg(F.sum("tokens").alias("n")).select("run", "book", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("of_book"))
    out = prefix_sums(sizes, ["run", "book"], "chapter_id", "tokens").join(books, ["run", "book"]).where("tokens > 0")
    first = F.col("of_book") + F.col("before")
    return out.select("run", "book", "chapter_id", "tokens", (first + 1).alias("first_run_position"), (first + F.col("tokens")).alias("last_run_position"))


def index_summary(chapters: DataFrame) -> DataFrame:
    """Tokens, distinct tokens, stop-word and content tokens, and chapters of each run."""
    words = X.words(F.col("text"))
    counts = counted(chapters, words, chapters=(F.size(words) > 0).cast("int"))
    stop, n = ~F.col("is_total") & X.is_stop_word(F.col("text"), F.col("run")), F.col("count")
    out = counts.groupBy("run").agg(
        F.sum("count").alias("token_count"), F.count_if(~F.col("is_total")).alias("distinct_token_count"),
        F.sum(F.when(stop, n).otherwise(0)).alias("stop_word_token_count"), F.sum("chapters").alias("chapter_count"),
    )
    out = out.where("token_count > 0").withColumn("content_token_count", F.col("token_count") - F.col("stop_word_token_count"))
    return out.select("run", "token_count", "distinct_token_count", "stop_word_token_count", "content_token_count", "chapter_count")


def chapter_sizes(chapters: DataFrame) -> DataFrame:
    """``chapters`` and the number of word tokens of its sentences, as the analyser counts them (from normalised sentences), and of
    its sentences: expected, sentences."""
    found = X.sentences(X.for_reading(F.col("text")))
    n = F.aggregate("_found", F.lit(0), lambda total, s: total + F.size(X.words(s)))
    return chapters.withColumn("_found", found).withColumns({"expected": n.cast("bigint"), "sentences": F.size("_found").cast("bigint")}).drop("_found")


def index_diagnostics(chapters: DataFrame) -> DataFrame:
    """Expected against indexed tokens, chapters and books of each run, gaps in run positions, coverage and delta; after one scan.

    The index is the one made of these texts, so its run positions count from 1 without gaps; stored.index_diagnostics looks at a saved one.
    """
    own = chapter_sizes(chapters).select("run", "book", "expected", F.size(X.words(F.col("text"))).alias("n"))
    n = F.greatest("n", F.lit(0))
    by_book = own.groupBy("run", "book").agg(F.sum("expected").alias("expected"), F.count("*").alias("chapters"), F.sum(n).alias("tokens"), F.count_if(n > 0).alias("indexed"))
    sums = by_book.groupBy("run").agg(
        F.sum("expected").alias("expected_word_token_count"), F.sum("chapters").alias("expected_chapter_count"), F.count("book").alias("source_book_count"),
        F.sum("tokens").alias("indexed_word_token_count"), F.sum("indexed").alias("indexed_chapter_count"), F.count_if((F.col("tokens") > 0) & F.col("book").isNotNull()).alias("indexed_book_count"),
    )
    some = F.col("indexed_word_token_count") > 0
    return with_deviations(sums.withColumns({"first_run_position": F.when(some, F.lit(1).cast("bigint")), "last_run_position": F.when(some, F.col("indexed_word_token_count"))}))


def with_deviations(out: DataFrame) -> DataFrame:
    """Expected and indexed numbers of each run, with the gaps in its run positions, delta and coverage."""
    n = F.coalesce("indexed_word_token_count", F.lit(0))
    return out.select(
        "run", "expected_word_token_count", "expected_chapter_count", "source_book_count",
        n.alias("indexed_word_token_count"),
        F.coalesce("indexed_chapter_count", F.lit(0)).alias("indexed_chapter_count"),
        F.coalesce("indexed_book_count", F.lit(0)).alias("indexed_book_count"),
        "first_run_position", "last_run_position",
        F.coalesce(F.col("last_run_position") - F.col("first_run_position") + 1 - n, F.lit(0)).alias("run_position_gap_count"),
        (n - F.col("expected_word_token_count")).alias("word_token_delta"),
        ratio_of(n * 100.0, F.col("expected_word_token_count")).alias("coverage_percentage"),
    )


def health(chapters: DataFrame) -> DataFrame:
    """Whether each run's index is sound, and what isn't."""
    return warnings_of(index_diagnostics(chapters))


def warnings_of(d: DataFrame) -> DataFrame:
    """What the diagnostics of each run say, in words."""
    warnings = F.filter(
        F.array(
            F.when(F.col("indexed_word_token_count") == 0, "token index is missing"),
            F.when((F.col("indexed_word_token_count") > 0) & (F.col("word_token_delta") != 0), F.format_string("token index delta is %+d", "word_token_delta")),
            F.when((F.col("indexed_word_token_count") > 0) & (F.col("indexed_chapter_count") != F.col("expected_chapter_count")), F.format_string("indexed chapters are %d of %d", "indexed_chapter_count", "expected_chapter_count")),
            F.when((F.col("indexed_word_token_count") > 0) & (F.col("indexed_book_count") != F.col("source_book_count")), F.format_string("indexed source books are %d of %d", "indexed_book_count", "source_book_count")),
            F.when(F.col("run_position_gap_count") != 0, F.format_string("run position gaps: %d", "run_position_gap_count")),
        ),
        lambda w: w.isNotNull(),
    )
    return d.select("run", F.array_join(warnings, "; ").alias("warnings"), (F.size(warnings) == 0).alias("overall_ok"))
