"""Comparison of two runs, and lexical difficulty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import lexicon
from wordloom.functions import text as X
from wordloom.functions.measures import comparison, difficulty_score, ratio_of
from wordloom.operators.stats import run_words, summed


def compare_words(words: DataFrame, left: str, right: str, presence: str = "any", min_count: int = 1, word_class: str = "all") -> DataFrame:
    """Words of two runs side by side; presence: any, shared (in both) or exclusive (in one)."""
    side = lambda run, name: words.where(F.col("run") == run).select("word", F.col("count").alias(f"{name}_count"), F.col("document_count").alias(f"{name}_document_count"), F.col("frequency_per_million").alias(f"{name}_per_million"), F.col("is_stop_word").alias(f"{name}_stop"))
    both = side(left, "left").join(side(right, "right"), "word", {"any": "full_outer", "exclusive": "full_outer", "shared": "inner"}[presence])
    if presence == "exclusive":
        both = both.where("left_count is null or right_count is null")
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    own = {c: F.coalesce(c, zero if c.endswith("count") else none).alias(c) for c in ("left_count", "left_document_count", "left_per_million", "right_count", "right_document_count", "right_per_million")}
    out = both.select("word", *own.values(), (F.coalesce("left_stop", F.lit(False)) | F.coalesce("right_stop", F.lit(False))).alias("is_function_word"))
    out = out.where((F.col("left_count") >= min_count) | (F.col("right_count") >= min_count))
    if word_class != "all":
        out = out.where(F.col("is_function_word") == (word_class == "function"))
    total = F.col("left_count") + F.col("right_count")
    return out.withColumns({"total_count": total, "left_share": ratio_of(F.col("left_count").cast("double"), total), "right_share": ratio_of(F.col("right_count").cast("double"), total), **comparison(F.col("left_per_million"), F.col("right_per_million"))})


def difficulty(chapters: DataFrame, thresholds: tuple[int, int] | None = None) -> DataFrame:
    """The difficulty of each run; see :func:`difficulty_of`."""
    return difficulty_of(run_words(chapters), thresholds)


def difficulty_of(words: DataFrame, thresholds: tuple[int, int] | None = None) -> DataFrame:
    """Shares of content, function, long and very long words, lexical diversity and the heuristic score of each run; lengths
    that count as long are those of the run's language unless given."""
    return measured(words, thresholds).select("run", "word_token_count", "distinct_word_count", "content_tokens", "function_tokens", "long_tokens", "very_long_tokens", "content_share", "function_share", "long_share", "very_long_share", "lexical_diversity", "score")


def measured(words: DataFrame, thresholds: tuple[int, int] | None = None) -> DataFrame:
    """The summary of each run (see :func:`wordloom.operators.stats.summed`) and its difficulty, after one aggregation."""
    code = F.regexp_extract(F.lower(F.col("run")), "^[^-_]*", 0)
    long, very = F.lit((thresholds or lexicon.UNKNOWN_THRESHOLDS)[0]), F.lit((thresholds or lexicon.UNKNOWN_THRESHOLDS)[1])
    if thresholds is None:
        for p in lexicon.PROFILES:
            long, very = F.when(code == p[0], p[3]).otherwise(long), F.when(code == p[0], p[4]).otherwise(very)
    else:
        low = max(2, thresholds[0])
        long, very = F.lit(low), F.lit(max(low, thresholds[1]))
    stop = X.is_stop_word(F.col("text"), F.col("run"))
    own = summed(words, content_tokens=~stop, function_tokens=stop, long_tokens=F.length("text") >= long, very_long_tokens=F.length("text") >= very)
    n = F.greatest(F.col("word_token_count"), F.lit(1)).cast("double")
    own = own.withColumns({
        "content_share": F.col("content_tokens") / n, "function_share": F.col("function_tokens") / n, "long_share": F.col("long_tokens") / n, "very_long_share": F.col("very_long_tokens") / n,
        "lexical_diversity": ratio_of(F.col("distinct_word_count") * 1000.0, F.col("word_token_count")),
    })
    score = difficulty_score(F.col("average_words_per_sentence"), F.col("average_characters_per_word"), F.col("long_share"), F.col("very_long_share"), F.col("content_share"), F.col("lexical_diversity"))
    return own.withColumn("score", score)


def compare_difficulty(profiles: DataFrame, left: str, right: str) -> DataFrame:
    """Differences (right less left) of two runs' difficulty, and which is the harder."""
    pick = lambda run, name: profiles.where(F.col("run") == run).select(F.col("run").alias(f"{name}_run"), F.col("score").alias(f"{name}_score"), F.col("lexical_diversity").alias(f"{name}_diversity"), F.col("long_share").alias(f"{name}_long_share"))
    both = pick(left, "left").crossJoin(pick(right, "right"))  # a row each
    diff = F.col("right_score") - F.col("left_score")
    return both.withColumns({"score_difference": diff, "harder": F.when(F.abs(diff) < 0.000001, "tie").when(diff > 0, F.col("right_run")).otherwise(F.col("left_run"))})


def language_note(chapters: DataFrame, left: str, right: str) -> DataFrame:
    """Languages of two runs and whether they differ. Here a run is named after its language."""
    codes = chapters.where(F.col("run").isin(left, right)).select("run", F.regexp_extract(F.lower(X.trimmed(F.col("run"))), "^[^-_]*", 0).alias("code")).distinct()
    return codes.agg(F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("languages"), (F.count_distinct("code") > 1).alias("different_languages"))  # two runs at most
