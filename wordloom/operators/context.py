"""Words in context: collocations, concordances and phrases. Each reads a chapter's arrays, without joins of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.functions.measures import dice, per_million, ratio_of
from wordloom.operators.grams import runs_with_totals
from wordloom.operators.index import end_offset, index_arrays, on_counts, with_offsets, word_arrays
from wordloom.settings import context_of, phrase_lengths, window_of


def around(target: str, window: int) -> Column:
    """Array of the words (collocate, offset) in the windows around the places ``at`` of a chapter's ``words``, without the word itself."""

    def near(p):
        found = F.transform(F.sequence(F.greatest(p - window, F.lit(1)), F.least(p + window, F.size("words"))), lambda i: F.struct(F.element_at("words", i).alias("collocate"), (i - p).alias("offset")))
        return F.filter(found, lambda x: x["collocate"] != target)

    return F.flatten(F.transform("at", near))


def collocations(chapters: DataFrame, word: str, window: int = 4, min_count: int = 1, min_dice: float = 0.0, word_class: str = "all") -> DataFrame:
    """Words within ``window`` words of each occurrence of ``word`` in the same chapter: counts by side, mean distance, rate
    for each occurrence and Dice coefficient.

    The word isn't a collocate of itself. A token in the windows of two occurrences counts twice; Dice bounds the count.
    """
    target, w = X.query_form(word), window_of(window)
    own = word_arrays(chapters).withColumn("at", F.filter(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1))), lambda i: F.try_element_at("words", i) == target))

    # All words, for their own counts, at offset 0; then those of the windows.
    own = own.withColumn("near", around(target, w))
    rows = own.select("run", F.explode(F.arrays_zip(F.concat("words", "near.collocate").alias("collocate"), F.concat(F.array_repeat(F.lit(0), F.size("words")), "near.offset").alias("offset"))).alias("p")).select("run", "p.*")
    found = rows.groupBy("run", "collocate").agg(
        F.count_if(F.col("offset") == 0).alias("collocate_count"), F.count_if(F.col("offset") < 0).alias("left_count"), F.count_if(F.col("offset") > 0).alias("right_count"),
        F.sum(F.abs("offset")).alias("distance"), F.max(F.col("collocate") == target).alias("is_target"),
    )
    # Both sides read all columns of the aggregation, so its exchange is made once and used twice.
    whole = (F.col("left_count") >= 0) & (F.col("right_count") >= 0) & (F.col("distance") >= 0) & (F.col("collocate_count") >= 0)
    targets = found.where(F.col("is_target") & whole).select("run", F.col("collocate_count").alias("target_count"))
    found = found.where(~F.col("is_target")).withColumn("count", F.col("left_count") + F.col("right_count"))
    out = found.where("count > 0").join(F.broadcast(targets), "run")  # a row a run
    out = out.select(
        "run", F.lit(target).alias("word"), "collocate", "count", "left_count", "right_count",
        ratio_of(F.col("count").cast("double"), F.col("target_count")).alias("rate_per_target"),
        ratio_of(F.col("distance").cast("double"), F.col("count")).alias("average_distance"),
        dice(F.col("count"), F.col("target_count"), F.col("collocate_count")).alias("dice"),
    )
    return matching(out, min_count, min_dice, word_class)


def matching(found: DataFrame, min_count: int = 1, min_dice: float = 0.0, word_class: str = "all") -> DataFrame:
    """Collocations of a least count and Dice coefficient: all, or those that are content or function words."""
    out = found.where((F.col("count") >= min_count) & (F.col("dice") >= min_dice)) if min_count > 1 or min_dice > 0 else found
    stop = X.is_stop_word(F.col("collocate"), F.col("run"))
    return {"all": out, "content": out.where(on_counts(~stop)), "function": out.where(on_counts(stop))}[word_class]


def concordance(chapters: DataFrame, word: str, context: int = 5) -> DataFrame:
    """A row for each occurrence of the word: the words before and after it as they are written, and its place.

    Occurrences are put together inside the chapter's row, and only they are exploded.
    """
    target, k = X.query_form(word), context_of(context)
    own = index_arrays(chapters.where(X.word_form(F.col("text")).contains(target))).where(F.array_contains("words", target))
    at = F.filter(F.sequence(F.lit(1), F.size("raws")), lambda i: F.element_at("words", i) == target)
    return lines(own.withColumn("at", at), k)


def lines(own: DataFrame, k: int) -> DataFrame:
    """Concordance lines of the places ``at`` of chapters (run, book, chapter_id) with the arrays gaps and raws, with k words on each side."""
    own, size = with_offsets(own), F.size("raws")
    span = lambda a, b, f: F.array_join(F.when(a <= b, F.transform(F.sequence(a, b), f)).otherwise(X.none()), "")

    def hit(p):
        left = span(F.greatest(p - k, F.lit(1)), p - 1, lambda i: F.concat(F.element_at("raws", i), F.element_at("gaps", i + 1)))
        right = span(p + 1, F.least(p + k, size), lambda i: F.concat(F.element_at("gaps", i), F.element_at("raws", i)))
        token = F.element_at("raws", p)
        return F.struct(p.alias("p"), token.alias("token_text"), left.alias("left"), right.alias("right"), (end_offset(p) - F.length(token)).alias("start"))

    rows = own.select("run", "book", "chapter_id", F.posexplode(F.transform("at", hit)).alias("k", "h"))
    return rows.select(
        "run", "book", "chapter_id", (F.col("k") + 1).cast("bigint").alias("occurrence_index"), F.col("h.p").cast("bigint").alias("chapter_position"), F.col("h.token_text").alias("token_text"),
        X.left_snippet(F.col("h.left")).alias("left_context"), X.right_snippet(F.col("h.right")).alias("right_context"), F.col("h.start").cast("bigint").alias("start_offset"),
    )


def phrases(chapters: DataFrame, low: int = 2, high: int = 5, min_count: int = 2, min_chapters: int = 1) -> DataFrame:
    """Repeated runs of words with nothing but white space between them, within a chapter (they may cross line and sentence
    ends that have no punctuation)."""
    return _phrases(chapters.select("run", X.stretches(F.col("text")).alias("words")), low, high, min_count, min_chapters)


def content_phrases(chapters: DataFrame, low: int = 2, high: int = 5, min_count: int = 2, min_chapters: int = 1) -> DataFrame:
    """:func:`content_boundary` of :func:`phrases`: places at which none of them begins aren't shuffled."""
    return content_boundary(_phrases(chapters.select("run", X.stretches(F.col("text")).alias("words")), low, high, min_count, min_chapters, ends=True))


def phrases_in(own: DataFrame, low: int = 2, high: int = 5, min_count: int = 2, min_chapters: int = 1) -> DataFrame:
    """:func:`phrases` of chapters (run) with the arrays words and gaps."""
    return _phrases(own.select("run", X.cut_words(F.col("words"), F.col("gaps")).alias("words")), low, high, min_count, min_chapters)


def _phrases(own: DataFrame, low: int, high: int, min_count: int, min_chapters: int, ends: bool = False) -> DataFrame:
    """Phrases of chapters (run) with words between which a null stands where no phrase goes on; ``ends`` as in :func:`runs_with_totals`."""
    low, high = phrase_lengths(low, high)
    own = own.select("run", "words", F.size(F.array_compact("words")).alias("total"))
    out = runs_with_totals(own, low, high, min_count, ends=ends)
    out = out.where((F.col("count") >= min_count) & (F.col("document_count") >= min_chapters)).withColumnsRenamed({"text": "phrase", "document_count": "chapter_count"})
    return out.select("run", X.n_words(F.col("phrase")).alias("n"), "phrase", "count", "chapter_count", per_million(F.col("count"), F.col("total")).alias("frequency_per_million"))


def with_boundary(found: DataFrame) -> DataFrame:
    """Phrases with the classes of their first and last words."""
    kind = lambda w: F.when(X.is_stop_word(w, F.col("run")), "function").otherwise("content")
    ends = F.split("phrase", " ")
    return found.withColumn("boundary", F.concat_ws("/", kind(F.element_at(ends, 1)), kind(F.element_at(ends, -1))))


def content_boundary(found: DataFrame) -> DataFrame:
    """Phrases that begin and end with content words."""
    return with_boundary(found).where(on_counts(F.col("boundary") == "content/content")).drop("boundary")


def longest_only(found: DataFrame) -> DataFrame:
    """Phrases that aren't part of a longer one with the same count and number of chapters.

    A longer phrase is looked up by its parts: each part of a phrase (by one word at either end, and so on down) is a key of
    an anti-join, so no two phrases of a count are compared unless one holds the other.
    """
    # An aggregation is an exchange that both uses read, if they read its count too.
    columns, once = found.columns, F.col("_rows") > 0
    found = found.groupBy(*columns).agg(F.count("*").alias("_rows"))
    size = F.size(F.split("phrase", " "))
    split = F.split("phrase", " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(size - 1, F.lit(2))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(split, i, n), " "))))
    held = found.where(((F.col("n") > 2) & once) | (F.col("_rows") < 0)).select("run", "count", "chapter_count", F.explode(F.array_distinct(parts)).alias("phrase")).distinct()
    return found.where(once).join(held, ["run", "phrase", "count", "chapter_count"], "left_anti").select(*columns)
