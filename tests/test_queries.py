"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from wordloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def cells(rows):
    return sorted(repr([None if isinstance(x, float) and math.isnan(x) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", ["top_content_words", "kwic", "collocations_min_dice", "phrases_longest_only", "sentence_categories", "ngrams_search", "difficulty", "health", "import_diagnostics", "boilerplate_markers", "token_index", "next_words", "corpus_profile", "chapter_metrics", "find_positions", "phrases_content_boundary", "explore_word", "explore_ngrams_by_documents", "explore_collocations_compat", "explore_comparison", "html_to_text", "boilerplate_clean", "stored_kwic", "stored_collocations", "stored_index_faults", "stored_words_after_changes", "language_profiles"])
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
    assert cells(map(tuple, df.select(*columns).collect())) == cells(want)


@pytest.mark.parametrize("name", ["stored_chapters", "stored_index_diagnostics", "stored_phrases", "stored_word_coverage", "stored_word_books"])
def test_saved_runs_against_sql(spark, duck, name):
    """No run could be saved with an index."""
    test_against_sql(spark, duck, name)


def test_cleaning_has_something_to_clean(spark):
    df = registry.QUERIES["boilerplate_clean"](spark, FOLDER).collect()
    texts = {k: [r["text"] for r in df if r["page_id"] % 5 == k] for k in range(5)}
    assert all(t.startswith("Chapter I.\n") and t.endswith("Nobody spoke.") for t in texts[2]) and all(t.startswith("Capitolo I\n") for t in texts[3])
    assert not any("GUTENBERG" in t for t in texts[1]) and {r["is_front_matter"] for r in df if r["page_id"] % 5 == 4} == {True}


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:2] == ["run", "word"] or "word" in entry.entry(spark).columns
