"""Operator 12: how the sources of a language differ in their words.

Of each language, the terms in LEAST_DOCUMENTS of its documents or more are kept. A source's share of a kept term is smoothed and scaled to an
integer, p = 1 + floor(SCALE * (count + PSEUDO) / (N + PSEUDO * V)), with N the group's count over the V kept terms; so all arithmetic is
on integers. Two reports are made of the shares:

* terms: those that a source uses more than its language does, the TOP_TERMS with the greatest difference. Ranks are found by radix selection:
  a histogram over ten bits of the differences at a time, counted by all tasks, tells for each group in which range its last rank lies, until
  the threshold itself is known; of the terms at the threshold, histograms over the next bytes of their UTF-8 forms tell which come first. Only
  the terms that are ranked, and a bounded number at the border, meet in a window.
* pairs: the sum of differences over all kept terms for each two sources of a language. A source has most kept terms 0 times, and then its
  share is its baseline. The sum starts as if all shares were baselines, V * |base - base'|, and each term that one of the two has corrects
  it; so only occurring (source, term) pairs are read. Sources are taken in blocks, and a task adds up the corrections of a bounded part
  of the terms for two blocks as a matrix; no pair is a row before these sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm._common import written

#: Fixed by the contract: the terms, and the numbers of the formula.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCUMENTS, PSEUDO, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50

#: Differences are below 2 ** VALUE_BITS, and are told apart by DIGIT_BITS at a time.
VALUE_BITS, DIGIT_BITS = 30, 10
#: Bytes of a term that a pass over ties looks at, and ties of a group that are ranked without another pass.
TIE_BYTES, FEW_TIES = 2, 1024
#: Sources in a block, and (source, term) pairs in a part of a language's terms.
BLOCK, PART_ROWS = 256, 100_000

GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), after one scan; null text, lang and source are ''.

    A document's terms and, after them, its distinct terms once more are exploded together, and counted before the shuffle. Each also gives a
    row of the empty term, which no text has: of a group without terms it is the only one.
    """
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP), F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)).alias("_terms"))
    own = own.select(*GROUP, "_terms", F.size("_terms").alias("_n"))
    rows = own.select(*GROUP, "_n", F.posexplode(F.concat(F.array(F.lit("")), "_terms", F.array_distinct("_terms"))).alias("_i", "term"))
    inside = F.col("_i") <= F.col("_n")
    return rows.groupBy(*GROUP, "term").agg(F.count_if(inside & (F.col("_i") > 0)).alias("n"), F.count_if(~inside).alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """p of a term with n of a group's total occurrences of kept terms; exact, as a quotient of decimals."""
    top = (n + PSEUDO).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", top, (total + PSEUDO * kept).cast("decimal(20,0)"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n, lang_n (occurrences in the language) and once (true in one row of each term of a language)."""
    of_term = Window.partitionBy("lang", "term")
    own = counts.where("term <> ''").withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "once": F.min("source").over(of_term) == F.col("source")})
    return own.where(F.col("lang_docs") >= least).select(*GROUP, "term", "n", "lang_n", "once")


def groups_of(counts: DataFrame, kept: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """All groups: lang, source, total, lang_total, kept (V), idx (the source's number in its language), sources, parts, base."""
    totals = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("once").alias("kept"), F.count("*").alias("_pairs"))
    own = counts.where("term = ''").select(*GROUP).join(totals, GROUP, "left").join(langs, "lang", "left").na.fill(0)
    in_lang = Window.partitionBy("lang")
    return own.select(
        *GROUP, "total", "lang_total", "kept", (F.row_number().over(in_lang.orderBy("source")) - 1).alias("idx"), F.count("*").over(in_lang).alias("sources"),
        (F.floor(F.col("_pairs") / part_rows) + 1).alias("parts"), F.when(F.col("kept") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.col("kept"))).otherwise(0).alias("base"),
    )


# Ranks by radix selection


def _cut(rows: DataFrame, digit: Column, order: Column, need: Column | str) -> DataFrame:
    """lang, source, digit and need of the digit among whose rows each group's last wanted row is; groups with fewer rows have none."""
    counts = rows.select(*GROUP, digit.alias("digit"), (F.col(need) if isinstance(need, str) else need).cast("bigint").alias("_need")).groupBy(*GROUP, "digit", "_need").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*GROUP).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a digit
    counts = counts.withColumn("_before", before)
    return counts.where((F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("count") >= F.col("_need"))).select(*GROUP, "digit", (F.col("_need") - F.col("_before")).alias("need"))


def thresholds(values: DataFrame, k: int) -> DataFrame:
    """lang, source, threshold (the k-th greatest value of the group) and need (how many of those equal to it are among the first k)."""
    shift = VALUE_BITS - DIGIT_BITS
    state, _ = written(_cut(values, F.shiftright("value", shift), F.desc("digit"), F.lit(k)), "radix")
    while shift > 0:
        shift -= DIGIT_BITS
        inside = values.join(state, GROUP).where(F.shiftright("value", shift + DIGIT_BITS) == F.col("digit")).drop("digit")
        state, _ = written(_cut(inside, F.shiftright("value", shift), F.desc("digit"), "need"), "radix")
    return state.withColumnRenamed("digit", "threshold")


def first_ties(ties: DataFrame, few: int = FEW_TIES) -> tuple[list[DataFrame], DataFrame]:
    """Of rows (lang, source, term, value, need) of one value a group: those known to be among the first need by UTF-8 bytes, and those of
    which that isn't known yet, few or need a group at most."""
    settled, at = [], 0
    while True:
        open_groups = ties.groupBy(*GROUP, "need").count().where((F.col("count") > F.col("need")) & (F.col("count") > few))
        if open_groups.isEmpty():
            return settled, ties
        key = F.substring(F.encode("term", "UTF-8"), at * TIE_BYTES + 1, TIE_BYTES)
        cut, _ = written(_cut(ties, key, F.asc("digit"), "need").withColumnRenamed("need", "_left"), "ties")
        own = ties.join(cut, GROUP, "left").withColumn("_key", key)  # a group that needs all its rows has no cut
        own, _ = written(own.where(F.col("digit").isNull() | (F.col("_key") <= F.col("digit"))), "ties")
        settled.append(own.where(F.col("digit").isNull() | (F.col("_key") < F.col("digit"))).select(*GROUP, "term", "value"))
        ties = own.where(F.col("_key") == F.col("digit")).select(*GROUP, "term", "value", F.col("_left").alias("need"))
        at += 1


def top_terms(values: DataFrame, k: int = TOP_TERMS, few: int = FEW_TIES) -> DataFrame:
    """The first k rows of each group by value, descending, and term: lang, source, term, value, rank. values: of a written table."""
    known = values.join(thresholds(values, k), GROUP, "left")
    sure = known.where(F.col("threshold").isNull() | (F.col("value") > F.col("threshold"))).select(*GROUP, "term", "value")
    ties, _ = written(known.where(F.col("value") == F.col("threshold")).select(*GROUP, "term", "value", "need"), "ties")
    settled, border = first_ties(ties, few)
    rows = sure.union(border.select(*GROUP, "term", "value"))
    for more in settled:
        rows = rows.union(more)
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "term"))  # over less than k + few rows
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


# Pairs of sources


def _cell(size: int, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums for the sources of two blocks (of ``size``) over a part of the terms; rows without a term hold the sources and their baselines."""
    lang, low, high, part = rows[["lang", "low", "high", "part"]].iloc[0]
    own = rows[rows["term"].isna()].sort_values("idx")
    block = own["idx"].to_numpy() // size
    left, right = own[block == low], own[block == high]
    a0, b0 = left["p"].to_numpy(np.int64), right["p"].to_numpy(np.int64)
    apart = np.abs(a0[:, None] - b0[None, :])
    sums = apart * int(own["kept"].iloc[0]) if part == 0 else np.zeros_like(apart)
    rest = rows[rows["term"].notna()].sort_values("term", kind="stable")
    idx, p = rest["idx"].to_numpy(np.int64), rest["p"].to_numpy(np.int64)
    term = rest["term"].to_numpy()
    edges = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1], [True]))) if len(term) else np.zeros(0, np.int64)
    for start, end in zip(edges[:-1], edges[1:]):
        i, x = idx[start:end], p[start:end]
        in_left, in_right = i // size == low, i // size == high
        rows_of, cols_of = i[in_left] - low * size, i[in_right] - high * size
        b = b0.copy()
        b[cols_of] = x[in_right]
        sums[rows_of] += np.abs(x[in_left][:, None] - b[None, :]) - apart[rows_of]
        others = np.ones(len(a0), bool)
        others[rows_of] = False
        others = np.flatnonzero(others)
        here = np.ix_(others, cols_of)
        sums[here] += np.abs(a0[others][:, None] - x[in_right][None, :]) - apart[here]
    i, j = np.triu_indices(len(a0), 1) if low == high else (k.ravel() for k in np.indices(sums.shape))
    one, two = left["source"].to_numpy()[i], right["source"].to_numpy()[j]
    value = sums[i, j]
    return pd.DataFrame({"lang": lang, "source": np.concatenate([one, two]), "item": np.concatenate([two, one]), "value": np.concatenate([value, value])})


def divergences(kept: DataFrame, groups: DataFrame, size: int = BLOCK) -> DataFrame:
    """lang, source, item (another source of the language) and value: the sum of differences of their shares over the kept terms."""
    about = groups.select(*GROUP, "idx", "sources", "parts", "kept", "total", "base")
    part = F.pmod(F.xxhash64("term"), F.col("parts")).alias("part")
    has = kept.select(*GROUP, "term", "n").join(about, GROUP).select("lang", F.lit(None).cast("string").alias("source"), "idx", "sources", part, F.lit(None).cast("bigint").alias("kept"), "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    own = about.select("lang", "source", "idx", "sources", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "kept", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"))
    block = F.floor(F.col("idx") / size)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("sources") - 1) / size))).alias("_other")
    rows = has.union(own).select("*", other).select("lang", F.least(block, "_other").alias("low"), F.greatest(block, "_other").alias("high"), "part", "source", "idx", "kept", "term", "p")
    sums = rows.groupBy("lang", "low", "high", "part").applyInPandas(lambda rows: _cell(size, rows), "lang string, source string, item string, value bigint")
    return sums.groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))


def divergence_audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, few: int = FEW_TIES, block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank, by value descending and item ascending.

    Null lang, source and text are ''. Groups without terms have pairs but no terms; where a language keeps no term, its pairs' values are 0. A
    language with one source has no pairs. Repeated rows are documents of their own; of an empty table there is nothing. Other columns, whatever
    their names, are not looked at. Counts, kept terms and shares are written to the shared folder, so a lost executor costs no second scan.
    """
    counts, _ = written(term_counts(docs), "term-counts")
    kept, _ = written(kept_terms(counts, least), "kept-terms")
    groups, _ = written(groups_of(counts, kept, part_rows), "groups")
    shares = kept.join(groups, GROUP).select(*GROUP, "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    values, _ = written(shares.where("p > q").select(*GROUP, "term", (F.col("p") - F.col("q")).alias("value")), "differences")
    terms = top_terms(values, top, few).select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))  # a row for each other source
    pairs = divergences(kept, groups, block).withColumn("rank", rank).select(*GROUP, F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.union(terms)
