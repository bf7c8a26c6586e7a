"""Saved runs: bucketed chapters, the inverted index, changes and faults."""

import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.operators import books, context, grams, index, stats, stored
from wordloom.operators.inverted import _inverted, inverted
from wordloom.sinks import store as module
from wordloom.sinks.manifest import Conflict, Manifest
from wordloom.sinks.store import KEYS, RunStore

FOLDER = "/root/testdata/sf0.001"
WORDS = "the sea was calm and grey a sail came over it don't wait naïve Éa".split()


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def corpus(spark):
    out = []
    for k in range(60):
        words = [WORDS[(k * 7 + i * i) % len(WORDS)] for i in range(k % 23)]
        out.append(("en" if k % 3 else "de", f"book{k % 5}", k // 5 + 1, ", ".join(words) + ("." if words else "")))
    return spark.createDataFrame(out, "run string, book string, chapter_id bigint, text string")


@pytest.fixture(scope="module")
def saved(spark, corpus, tmp_path_factory):
    store = RunStore(spark, f"file://{tmp_path_factory.mktemp('store')}")
    return store, store.save(corpus, "all")


def test_stored_queries_equal_those_on_texts(corpus, saved):
    store, run = saved
    for word in ("The", "don’t", "absent"):
        assert rows(stored.concordance(store, run, word, 3)) == rows(context.concordance(corpus, word, 3))
        assert rows(stored.collocations(store, run, word, 2)) == rows(context.collocations(corpus, word, 2))
        assert rows(stored.word_distribution(store, run, word)) == rows(books.word_distribution(corpus, word))
        assert rows(stored.word_coverage(store, run, word)) == rows(books.word_coverage(corpus, word))
    assert rows(stored.phrases(store, run)) == rows(context.phrases(corpus)) and rows(store.words(run)) == rows(stats.word_frequencies(corpus))
    assert rows(store.positions(run)) == rows(index.run_positions(corpus)) and rows(stored.index_diagnostics(store, run)) == rows(index.index_diagnostics(corpus))
    assert rows(stored.health(store, run)) == rows(index.health(corpus)) and stored.index_faults(store, run).isEmpty()
    one = stored.chapters(store, run, "en", "book2").collect()
    assert [r["chapter_id"] for r in one] == sorted(r["chapter_id"] for r in corpus.where("run = 'en' and book = 'book2'").collect()) and one


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_by_buckets_have_no_exchange(spark, saved):
    store, run = saved
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(store.indexed_chapters(run))
        assert "Exchange" not in plan(store._postings_of(store._run(run)["parts"][0]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_word_opens_few_files(spark, saved, monkeypatch, tmp_path):
    many = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("lang").alias("run"), F.col("source").alias("book"), F.col("doc_id").alias("chapter_id"), "text")
    monkeypatch.setattr(module, "FILE_BYTES", 4096)
    store = RunStore(spark, f"file://{tmp_path}")
    run = store.save(many)
    whole, one = store.postings(run), store.postings(run, "license")
    assert len(whole.inputFiles()) >= 30 and len(one.inputFiles()) * 10 <= len(whole.inputFiles())
    assert "EqualTo(word,license)" in plan(one) and rows(one) == rows(whole.where("word = 'license'"))
    some = [("en", "src1"), ("de", "src2")]
    assert rows(store.book_words(run, some)) == rows(store.book_words(run).where("(run = 'en' and book = 'src1') or (run = 'de' and book = 'src2')"))
    assert len(store._holding(store._run(run)["parts"], "book_word", ["src1"]).inputFiles()) * 3 < len(store.book_words(run).inputFiles())


def test_changes_equal_a_recount(spark, corpus, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}")
    run = store.save(corpus.where("book <> 'book3'"))
    store.append(run, corpus.where("book = 'book3'"))
    with pytest.raises(ValueError):
        store.append(run, corpus.where("book = 'book3' and chapter_id = 1"))
    assert len(store._run(run)["parts"]) == 2 and rows(store.words(run)) == rows(stats.word_frequencies(corpus))
    before = store.manifest.version()
    store.delete_books(run, [("en", "book3"), ("de", "book0"), ("en", "none")])
    left = corpus.where("not (run = 'en' and book = 'book3' or run = 'de' and book = 'book0')")

    def same():
        assert rows(store.words(run)) == rows(stats.word_frequencies(left)) and rows(store.positions(run)) == rows(index.run_positions(left))
        assert rows(stored.concordance(store, run, "sea")) == rows(context.concordance(left, "sea")) and rows(stored.collocations(store, run, "sea")) == rows(context.collocations(left, "sea"))
        assert rows(stored.index_diagnostics(store, run)) == rows(index.index_diagnostics(left)) and stored.index_faults(store, run).isEmpty()

    same()
    assert store.manifest.version() == before + 1
    store.compact(run)
    same()
    assert len(store._run(run)["parts"]) == 1 and not store._run(run)["removed"]
    store.replace_index(run)
    same()


def test_a_run_without_an_index(spark, corpus, saved, tmp_path):
    """Its texts are looked at; when the index is made, the answers stay the same."""
    store, (whole, of_whole) = RunStore(spark, f"file://{tmp_path}"), saved
    run = store.save(corpus, index=False)
    assert not store.indexed(run) and store.postings(run).isEmpty() and store.tokens(run).isEmpty() and store.postings(run, "sea").isEmpty()
    asked = (lambda s, r: stored.concordance(s, r, "sea"), lambda s, r: stored.collocations(s, r, "sea"), lambda s, r: stored.word_distribution(s, r, "sea"), lambda s, r: stored.word_coverage(s, r, "sea"), stored.phrases, lambda s, r: s.words(r))
    want = [rows(f(whole, of_whole)) for f in asked]
    assert [rows(f(store, run)) for f in asked] == want
    assert all("token index is missing" in r["warnings"] for r in stored.health(store, run).collect())
    assert {r["fault"] for r in stored.index_faults(store, run).collect()} == {"missing chapter"}
    store.replace_index(run)
    assert store.indexed(run) and [rows(f(store, run)) for f in asked] == want and stored.index_faults(store, run).isEmpty()


def test_faults_are_found(spark, corpus, saved, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}")
    run = store.save(spark.createDataFrame([("en", "b", k, "one two three four five six") for k in range(1, 6)], "run string, book string, chapter_id bigint, text string"))
    own = store.postings(run)
    third = own.where("chapter_id = 3").withColumn("positions", F.filter("positions", lambda p: ~p.isin(2, 3, 6))).withColumn("n", F.size("positions").cast("bigint")).where("n > 0")
    strange = own.where("chapter_id = 1 and word = 'one'").withColumn("chapter_id", F.lit(9).cast("bigint"))
    store.replace_index(run, own.where("chapter_id not in (2, 3)").union(third).union(own.where("chapter_id = 4 and word = 'two'")).union(strange))
    got = {tuple(r)[2:] for r in stored.index_faults(store, run).collect()}
    assert got == {(2, "missing chapter", 1, 6), (9, "unknown chapter", None, None), (3, "token gap", 2, 3), (3, "token gap", 6, 6), (4, "repeated token", 2, 2)}
    said = stored.health(store, run).first()
    assert not said["overall_ok"] and "token index delta" in said["warnings"]
    store.replace_index(run)
    assert stored.index_faults(store, run).isEmpty() and stored.health(store, run).first()["overall_ok"]


def test_faults_without_broadcast_joins(spark, corpus, tmp_path):
    """positions and the end of a chapter meet in one window also where nothing is broadcast, as on large tables."""
    store = RunStore(spark, f"file://{tmp_path}")
    run = store.save(corpus)
    own = store.postings(run)
    want = {(*r, "repeated token") for r in own.where("book = 'book1'").select("run", "book", "chapter_id", F.explode("positions")).collect()}
    store.replace_index(run, own.union(own.where("book = 'book1'")))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = stored.index_faults(store, run).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(got) == len(want) and {(r["run"], r["book"], r["chapter_id"], r["first"], r["fault"]) for r in got} == want


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_gaps_across_the_borders_of_ranges(spark, width):
    spans = [("en", "b", 1, 1, 5), ("en", "b", 2, 6, 6), ("en", "b", 3, 9, 30), ("en", "b", 4, 28, 31), ("en", "b", 5, 32, 40), ("de", "b", 1, 2, 4), ("de", "b", 2, 5, 5), ("de", "b", 3, 1000, 1001)]
    df = spark.createDataFrame(spans, "run string, book string, chapter_id bigint, first_run_position bigint, last_run_position bigint")
    got = {(r["run"], *tuple(r)[2:]) for r in stored.span_faults(df, width).collect()}
    assert got == {("en", 3, "run position gap", 7, 8), ("en", 4, "run position overlap", 28, 30), ("de", 1, "run position gap", 1, 1), ("de", 3, "run position gap", 6, 999)}


def test_a_killed_writer_leaves_nothing_visible(spark, corpus, saved, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}")
    begun = store._begin("killed")
    store._write_part(begun, corpus.limit(3))
    with pytest.raises(LookupError):
        store.chapters(begun)
    assert store.runs() == [] and store.recover() == [] and list(tmp_path.glob("run-*"))
    assert store.recover(older_than=0) == [begun] and not list(tmp_path.glob("run-*")) and store.manifest.read()["runs"] == {}
    broken = corpus.withColumn("text", F.when(F.col("chapter_id") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        store.save(broken)
    assert store.runs() == [] and not list(tmp_path.glob("run-*"))
    assert store.save(corpus.limit(5)) == begun + 2 and [r["run_id"] for r in store.runs()] == [begun + 2]


def test_another_writers_change_isnt_lost(spark, corpus, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}")
    run = store.save(corpus.limit(9))
    seen = store._run(run)
    time.sleep(0.01)
    store.delete_books(run, [("de", "book0")])
    with pytest.raises(RuntimeError, match="another writer"):
        store._complete(run, seen, removed=[])
    m = Manifest(spark, f"file://{tmp_path}/m")
    m.commit({"a": 1}, 0)
    with pytest.raises(Conflict):
        m.commit({"a": 2}, 0)
    assert m.read() == {"a": 1} and m.update(lambda s: {"a": s["a"] + 1}) == {"a": 2} and m.version() == 2 and m.read(1) == {"a": 1}


def test_empty_and_odd_chapters(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}")
    schema = "run string, book string, chapter_id bigint, text string, title string, words int"
    empty = store.save(spark.createDataFrame([], schema))
    assert store.words(empty).isEmpty() and stored.concordance(store, empty, "a").isEmpty() and stored.index_diagnostics(store, empty).isEmpty()
    odd = store.save(spark.createDataFrame([("en", "b", 1, None, "T", 1), ("en", "b", 2, "", None, 2), ("en", "b", 3, "word " * 5000, "x", 3), (None, "b", 4, "lost run", "y", 4)], schema))
    assert stored.chapters(store, odd, "en").select("title").collect()[0][0] == "T" and stored.concordance(store, odd, "word").count() == 5000
    assert [(r["fault"], r["run"]) for r in stored.index_faults(store, odd).collect() if r["run"]] == []


def test_source_books_fall_back_on_stored_chapters(spark, saved):
    store, run = saved
    own = [tuple(r) for r in stored.books(store, run).orderBy("run", "order_index").collect()]
    assert own[:2] == [("de", "book0", 1), ("de", "book1", 2)] and len(own) == 10
    links = spark.createDataFrame([("en", "book4", 1)], "run string, book string, order_index int")
    got = [tuple(r) for r in stored.books(store, run, links).orderBy("run", "order_index").collect()]
    assert got == [*own[:5], ("en", "book4", 1)]
    assert re.fullmatch(r"wordloom_[0-9a-f]{32}", module._table("x")) and KEYS[0] == "run"


def test_chapters_are_inverted_where_they_are(spark, tmp_path):
    """words were exploded and grouped token by token."""
    rows = [("en", "b", 1, ["b", "a", "b"]), (None, "c", 2, []), ("de", None, 3, None), ("en", "b", 4, ["é-x"] + ["a"] * 5), (None, None, 5, ["a"])]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in (1, 2, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            found = inverted(spark.createDataFrame(rows, "run string, book string, chapter_id bigint, words array<string>").coalesce(1))
            got = {tuple(r)[:4]: (r["n"], r["positions"]) for r in found.collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        want = {(*r[:3], w): [i + 1 for i, x in enumerate(r[3]) if x == w] for r in rows for w in r[3] or []}
        assert got == {k: (len(v), v) for k, v in want.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan and "Generate" not in plan


@pytest.mark.parametrize("words", [1, 4, 1000])
def test_chapters_are_inverted_piece_by_piece(monkeypatch, words):
    """Pieces were cut by the bytes of words in one string, where chapters to be inverted have arrays of words."""
    monkeypatch.setattr(grams, "WORDS", words)
    rows = [{"run": "en", "book": f"b{k % 2}", "chapter_id": k, "words": None if k % 4 == 3 else ["ab", "c", "d"][: k % 5] * (k % 3)} for k in range(20)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("run", pa.string()), ("book", pa.string()), ("chapter_id", pa.int64()), ("words", pa.list_(pa.string()))]))
    for own, some in ((batch, rows), (batch.slice(3, 11), rows[3:14])):
        got = {(r["chapter_id"], r["word"]): (r["n"], r["positions"]) for b in _inverted(iter([own])) for r in b.to_pylist()}
        want = {(r["chapter_id"], w): [i + 1 for i, x in enumerate(r["words"]) if x == w] for r in some for w in r["words"] or []}
        assert got == {k: (len(v), v) for k, v in want.items()} and got
