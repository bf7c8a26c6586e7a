"""Books and chapters of a run: listings, distribution of a word, quality of chapters, import diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import lexicon
from wordloom.functions import text as X
from wordloom.functions.measures import per_million, ratio_of
from wordloom.operators.index import chapter_sizes, end_offset, with_offsets, word_arrays


def run_books(chapters: DataFrame) -> DataFrame:
    """Chapters and characters of each book of a run."""
    return chapters.groupBy("run", "book").agg(F.count("*").alias("chapter_count"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("character_count"))


def source_books(runs: DataFrame, links: DataFrame) -> DataFrame:
    """The books of each run: those it is linked with (run_id, book_id, order_index), else its own (run_id, book_id)."""
    fallback = runs.join(links.select("run_id").distinct(), "run_id", "left_anti").select("run_id", "book_id", F.lit(1).alias("order_index"))
    return links.select("run_id", "book_id", "order_index").union(fallback)


def word_distribution(chapters: DataFrame, word: str) -> DataFrame:
    """Occurrences of a word in each book that has it, and per million of the book's words."""
    target = X.query_form(word)
    own = chapters.select("run", "book", F.length("text").alias("chars"), X.words(F.col("text")).alias("words"))
    sums = own.groupBy("run", "book").agg(
        F.count("*").alias("chapter_count"), F.sum("chars").alias("character_count"), F.sum(F.size("words")).cast("bigint").alias("word_token_count"),
        F.sum(F.size(F.filter("words", lambda w: w == target))).cast("bigint").alias("count"),
    )
    return sums.where("count > 0").withColumn("frequency_per_million", per_million(F.col("count"), F.col("word_token_count")))


def word_coverage(chapters: DataFrame, word: str) -> DataFrame:
    """How many of a run's books have the word, in all and as a percentage."""
    target = X.query_form(word)
    has = word_arrays(chapters).groupBy("run", "book").agg(F.max(F.array_contains("words", target).cast("int")).alias("has"))
    sums = has.groupBy("run").agg(F.sum("has").alias("matched_books"), F.count("*").alias("source_books"))
    return sums.withColumn("coverage_percentage", ratio_of(F.col("matched_books") * 100.0, F.col("source_books")))


def _any_of(c: Column, terms: tuple[str, ...]) -> Column:
    own, out = F.lower(c), F.lit(False)
    for t in terms:
        out = out | own.contains(t)
    return out


def chapter_metrics(chapters: DataFrame) -> DataFrame:
    """Words, sentences, characters and quality label of each chapter."""
    title = F.col("title") if "title" in chapters.columns else F.lit("")
    size, empty = F.length("text").cast("bigint"), ~F.col("text").rlike(r"(?U)\S")
    odd = _any_of(title, lexicon.TITLE_MARKERS) | _any_of(F.col("text"), lexicon.TEXT_MARKERS)
    labels = F.array_compact(F.array(F.when(empty, "empty").when(size < 200, "very short"), F.when(size >= 100_000, "very long"), F.when(odd, "potentially suspicious")))
    return chapter_sizes(chapters).select(
        "run", "book", "chapter_id", size.alias("character_count"), F.col("expected").alias("word_count"), F.col("sentences").alias("sentence_count"),
        F.when(F.size(labels) == 0, "normal").otherwise(F.array_join(labels, " · ")).alias("quality"),
    )


def find_in_chapters(chapters: DataFrame, term: str) -> DataFrame:
    """Number of occurrences of a term in each chapter that has it, whatever its case, without overlaps."""
    n = F.regexp_count("text", F.lit("(?iu)" + _quoted(term)))
    return chapters.select("run", "book", "chapter_id", n.cast("bigint").alias("matches")).where("matches > 0")


def find_positions(chapters: DataFrame, term: str) -> DataFrame:
    """A row for each occurrence of a term in a chapter, whatever its case, without overlaps: match_index from 1, start_offset, match.

    The text between the matches is what a split by them leaves, so offsets are sums of lengths.
    """
    pattern = F.lit("(?iu)" + _quoted(term))
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    own = chapters.where(F.regexp_count("text", pattern) > 0).select("run", "book", "chapter_id", found.alias("raws"), F.slice(F.split("text", "(?iu)" + _quoted(term), -1), 1, F.size(found)).alias("gaps"))
    own = with_offsets(own)
    ends = F.transform(F.sequence(F.lit(1), F.size("raws")), end_offset)
    rows = own.select("run", "book", "chapter_id", F.posexplode(F.arrays_zip(F.col("raws"), ends.alias("ends"))).alias("k", "t"))
    return rows.select("run", "book", "chapter_id", (F.col("k") + 1).cast("bigint").alias("match_index"), (F.col("t.ends") - F.length("t.raws")).cast("bigint").alias("start_offset"), F.col("t.raws").alias("match"))


def _quoted(term: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&#~" else c for c in term)


def looks_like_contents(text: Column) -> Column:
    """Whether among the first 60 lines one is a heading of contents or five name chapters."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), X.trimmed), lambda x: x != ""), 1, 60)
    heading = F.exists(lines, lambda x: F.lower(x).isin("contents", "indice", "sommario"))
    named = F.size(F.filter(lines, lambda x: x.rlike(r"(?i)^(chapter|capitolo)\s+([ivxlcdm]+|[0-9]+)")))
    return heading | (named >= 5)


def suspicion(text: Column) -> Column:
    """Why a chapter looks like boilerplate; null if it doesn't."""
    size, own = F.length(text), F.lower(text)
    contents = looks_like_contents(text)
    strong = F.lit(None).cast("string")
    for t in reversed(lexicon.STRONG_TERMS):
        strong = F.when(own.contains(t), f"contains '{t}'").otherwise(strong)
    weak = F.lit(None).cast("string")
    for t in reversed(lexicon.WEAK_TERMS):
        weak = F.when(own.contains(t), f"contains possible front matter term '{t}'").otherwise(weak)
    near_top = _any_of(F.substring(text, 1, 1500), lexicon.WEAK_TERMS)
    return (
        F.when(size == 0, "empty chapter")
        .when((size < 500) & contents, "short table-of-contents-like chapter")
        .when(strong.isNotNull(), strong)
        .when(weak.isNotNull() & (contents | ((size < 5000) & near_top)), weak)
    )


def suspicious_chapters(chapters: DataFrame) -> DataFrame:
    return chapters.select("run", "book", "chapter_id", F.length("text").cast("bigint").alias("character_count"), suspicion(F.col("text")).alias("reason")).where("reason is not null")


def import_diagnostics(chapters: DataFrame) -> DataFrame:
    """Books, chapters, characters and odd chapters of each run."""
    size = F.length("text")
    return chapters.groupBy("run").agg(
        F.countDistinct("book").alias("book_count"), F.count("*").alias("chapter_count"), F.sum(size).alias("total_characters"),
        ratio_of(F.sum(size).cast("double"), F.count("*")).alias("average_characters"), F.count_if(size == 0).alias("empty_chapters"),
        F.count_if((size > 0) & (size < 500)).alias("short_chapters"), F.count_if(size > 50_000).alias("long_chapters"), F.count_if(suspicion(F.col("text")).isNotNull()).alias("suspicious_chapters"),
    )


def suspicious_terms(chapters: DataFrame) -> DataFrame:
    """Occurrences of each boilerplate term that occurs."""
    own = F.lower("text")
    sums = chapters.agg(*(F.sum(F.regexp_count(own, F.lit(_quoted(t)))).cast("bigint").alias(t) for t in lexicon.SUSPICIOUS_TERMS))
    pairs = F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"`{t}`").alias("count")) for t in lexicon.SUSPICIOUS_TERMS))
    return sums.select(F.explode(pairs).alias("p")).select("p.term", "p.count").where("count > 0")


def extreme_chapters(chapters: DataFrame, longest: bool, n: int = 15) -> DataFrame:
    """The n shortest or longest chapters, with the beginning of their text."""
    rows = chapters.select("run", "book", "chapter_id", F.length("text").cast("bigint").alias("character_count"), F.substring(X.inline(F.col("text")), 1, 80).alias("preview"))
    return rows.orderBy(F.desc("character_count") if longest else F.asc("character_count"), "run", "book", "chapter_id").limit(n)
