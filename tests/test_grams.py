"""Counting of runs of words by sorted windows, against counting each run by itself."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.operators import context, grams, stats
from wordloom.plans import explore

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def counted(own, low, high, least, short):
    """(run, text): count and chapters of runs of words, by brute force."""
    count, docs = Counter(), Counter()
    for run, words in own:
        found = [(run, " ".join(w)) for n in range(low, high + 1) for i in range(len(words) - n + 1) if None not in (w := words[i : i + n]) and min(map(len, w)) >= short]
        count.update(found)
        docs.update(set(found))
    return {k: (c, docs[k]) for k, c in count.items() if c >= least}


@pytest.mark.parametrize("batch, low, high, least, short", [(1, 2, 5, 1, 1), (3, 2, 4, 2, 1), (10_000, 3, 3, 1, 2), (7, 2, 8, 3, 1)])
def test_counts_across_batches(spark, monkeypatch, batch, low, high, least, short):
    seed = random.Random(batch)
    vocabulary = ["a", "a'b", "a-b", "ab", "á", None]
    own = [(seed.choice(["en", "en x", ""]), [seed.choice(vocabulary) for _ in range(seed.randint(0, 30))]) for _ in range(60)] + [("en", [])]
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, batch)
    try:
        df = spark.createDataFrame(own, "run string, words array<string>").withColumn("total", F.lit(2))
        got = grams.run_counts(df, low, high, least, short).collect()
    finally:
        spark.conf.set(BATCH, before)
    assert {(r["run"], r["text"]): (r["count"], r["document_count"]) for r in got if not r["is_total"]} == counted(own, low, high, least, short)
    assert {r["run"]: r["total"] for r in got if r["is_total"]} == {k: 2 * n for k, n in Counter(r for r, _ in own).items()}


def test_a_place_is_shuffled_once(chapters):
    """No row for each length of each run of words, and none for a chapter's distinct ones."""
    text = chapters("One two three four five six. One two three, four five six seven.")
    for df in (stats.ngram_frequencies(text), context.phrases(text), context.longest_only(context.content_boundary(context.phrases(text)))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan and "MapInArrow" in plan


def test_stretches_and_sentences_are_those_of_words_and_gaps(chapters):
    text = "“Don’t!” she said.\r\n\r\n\r\nNo more – e.g. this one\t\tor that?” asked I. Well-known words  here\n\nEND (so. it) 3.5 went‐on"
    df = chapters(text)
    a = context.phrases(df, min_count=1).collect()
    from wordloom.functions import text as X

    b = context.phrases_in(df.select("run", X.words("text").alias("words"), X.gaps("text").alias("gaps")), min_count=1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a
    own = df.select(X.sentence_words(F.col("text")).alias("w"), F.transform(X.sentences(X.for_reading(F.col("text"))), X.words).alias("v")).first()
    assert [w for w in own["w"] if w] == [v for v in own["v"] if v]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_chapters_without_text(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([("en", "b", 1, None), ("en", "b", 2, "Go on go on"), ("en", "b", 3, "")], "run string, book string, chapter_id bigint, text string")
        for found in (stats.ngram_frequencies(df), context.phrases(df)):
            assert [tuple(r)[-4:] for r in found.collect()] == [("go on", 2, 1, 2 * 1e6 / 4)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_counts_arent_shuffled_again(chapters):
    """Places are made and dealt once, for counts and totals, and what is counted isn't grouped once more."""
    text = chapters("One two three four five six. One two three, four five six seven.")
    for df in (stats.ngram_frequencies(text), context.phrases(text)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        dealt = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
        assert len([line for line in dealt if "Reused" not in line]) == 1 and [line for line in dealt if "Reused" in line]
        assert not [line for line in plan.splitlines() if "Aggregate(keys=[run" in line and "text#" in line.split("functions=")[0]]


@pytest.mark.parametrize("block, low, high, least, bits", [(1, 2, 5, 1, 64), (5, 2, 5, 2, 64), (40, 2, 4, 3, 64), (7, 3, 3, 2, 64), (3, 2, 5, 2, 1), (50, 2, 8, 1, 2), (10_000, 2, 5, 2, 1)])
def test_blocks_and_equal_bits(monkeypatch, block, low, high, least, bits):
    """rows are sorted by a number alone, so runs with equal bits stand mixed, and runs go on from block to block."""
    plain = grams._hashes
    monkeypatch.setattr(grams, "_hashes", lambda values: plain(values) << np.uint64(64 - bits))
    seed = random.Random(block)
    own = [(seed.choice(["en", "en x", ""]), [seed.choice(["a", "a'b", "b", "á", None]) for _ in range(seed.randint(0, 30))]) for _ in range(60)]
    words = [" ".join(grams.CUT if w is None else w for w in ws) for _, ws in own]
    batch = pa.RecordBatch.from_pydict({"run": [r for r, _ in own], "words": words, "total": pa.array([1] * len(own), pa.int64())})
    rows = pa.Table.from_batches(grams._windows(low, high, 1)(iter([batch]))).filter(pa.compute.field("text").is_valid()).sort_by("key").combine_chunks()
    parts, state = [rows.slice(k, block) for k in range(0, len(rows), block)], grams._Sorted(low, high, least)
    found = [b for p in parts for b in state.add(*(grams._array(p[c]) for c in ("run", "text")), *(p[c].to_numpy() for c in ("x", "key")))] + list(state.end())
    got = [((r["run"], r["text"]), (r["count"], r["document_count"])) for b in found for r in b.to_pylist()]
    assert len(got) == len(dict(got)) and dict(got) == counted(own, low, high, least, 1)


def test_rows_are_sorted_by_a_number(chapters):
    """rows were sorted by their texts, and patterns and classes made of all rows before the first were taken."""
    text = chapters("One two three four five six. One two three, four five six seven.")
    for df, made in ((explore.ngrams(text, sort="frequency"), "AS pattern"), (explore.ngrams(text, sort="text"), "AS pattern"), (explore.phrases(text), "AS boundary")):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert [line for line in lines if "Sort [key" in line and "text" not in line]
        at = [k for k, line in enumerate(lines) if made in line]
        assert at and max(at) < min(k for k, line in enumerate(lines) if "Window" in line)
        assert df.columns[-1] == "rank"


@pytest.mark.parametrize("batch, low, high", [(1, 2, 5), (7, 2, 3), (10_000, 3, 5), (10_000, 2, 2)])
def test_content_phrases_equal_those_chosen_later(spark, batch, low, high):
    """places at which no phrase between content words begins aren't shuffled."""
    seed = random.Random(batch + high)
    words = "the of der und a sea Sail night. old, wind".split()
    rows = [(seed.choice(["en", "en-GB", "DE_x", "xx", "", None]), "b", k, " ".join(seed.choices(words, k=seed.randint(0, 25)))) for k in range(80)]
    df = spark.createDataFrame(rows, "run string, book string, chapter_id bigint, text string")
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, batch)
    try:
        got, want = (sorted(map(tuple, f.collect())) for f in (context.content_phrases(df, low, high, 2, 1), context.content_boundary(context.phrases(df, low, high, 2, 1))))
    finally:
        spark.conf.set(BATCH, before)
    own = df.where("run like 'en%'").selectExpr("run", "split('the sea of night', ' ') as words", "4 as total")
    assert got == want and want and grams._counts_and_totals(own, 2, 5, 1, 1, True)[0].where("text = 'the sea'").isEmpty()
