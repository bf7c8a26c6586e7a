"""Statistics, index, context, comparison and book queries on small texts."""

import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions import lexicon
from wordloom.operators import books, compare, context, index, stats
from wordloom.plans import explore
from wordloom.plans.profile import analyse, corpus_profile
from wordloom.settings import AnalysisSettings, context_of, limit_of, phrase_lengths, window_of

SAMPLE = "Hello, Tom.\nI don't know.\nDo you know Anna?\nNo, I don't know Anna.\nHello again.\nI don't care.\nCould you help me, please?"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_word_frequencies(chapters):
    words = {r["word"]: r for r in stats.word_frequencies(chapters(SAMPLE)).collect()}
    assert words["hello"]["count"] == 2 and words["i"]["count"] == 3 and words["i"]["is_stop_word"]
    docs = {r["word"]: r for r in stats.word_frequencies(chapters("Alice smiled. Alice laughed.", "Alice wondered. Rabbit ran.")).collect()}
    assert (docs["alice"]["count"], docs["alice"]["document_count"]) == (3, 2)
    assert docs["alice"]["frequency_per_million"] == 3 * 1e6 / 8


def test_ngrams(chapters):
    grams = dict(rows(stats.ngram_frequencies(chapters(SAMPLE)), "text", "count"))
    assert grams["i don't"] == 3 and grams["don't know"] == 2
    short = stats.ngram_frequencies(chapters("Alice a rabbit. Alice rabbit."), AnalysisSettings(min_word_length=2, ngram_max_n=2, min_ngram_count=1))
    assert rows(short, "text", "count") == [("alice rabbit", 1)]


def test_ngram_search_and_patterns(spark):
    df = spark.createDataFrame([("en", 2, "the rabbit", 14), ("en", 2, "white rabbit", 12), ("en", 2, "in the", 10), ("en", 2, "rabbit hole", 8), ("en", 3, "the white rabbit", 6)], "run string, n bigint, text string, count bigint")
    found = stats.ngram_search(df, " RABBIT ", n=2)
    assert found.count() == 3
    assert sorted(rows(stats.ngram_patterns(found, "content"), "text", "pattern")) == [("rabbit hole", "C-C"), ("white rabbit", "C-C")]
    assert stats.ngram_search(df, "he").count() == 0
    assert rows(df.withColumn("frequency_per_million", F.lit(1.0)).orderBy(*stats.ngram_order("count")).limit(1), "text") == [("the rabbit",)]


def test_next_words(chapters):
    pairs = stats.next_words(chapters(SAMPLE), AnalysisSettings(min_next_word_pair_count=1))
    assert rows(stats.neighbours(pairs, "I"), "next_word", "count", "probability") == [("don't", 3, 1.0)]
    assert {r[0] for r in rows(stats.neighbours(pairs, "know", before=True), "word")} == {"don't", "you"}


def test_summary_and_empty(chapters):
    s = corpus = stats.corpus_summary(chapters(SAMPLE, "")).collect()[0]
    assert (corpus["document_count"], corpus["sentence_count"]) == (2, 7) and s["average_words_per_sentence"] == s["word_token_count"] / 7
    e = stats.corpus_summary(chapters("")).collect()[0]
    assert (e["word_token_count"], e["average_words_per_sentence"], e["average_characters_per_word"]) == (0, 0.0, 0.0)


def test_index(chapters):
    df = chapters("Hello, Alice. The rabbit saw Alice.")
    tokens = index.token_index(df).orderBy("chapter_position").collect()
    text = "Hello, Alice. The rabbit saw Alice."
    assert [text[r["start_offset"] : r["end_offset"]] for r in tokens] == [r["token_text"] for r in tokens]
    assert [r["chapter_position"] for r in tokens if r["word"] == "alice"] == [2, 6]
    s = index.index_summary(df).collect()[0]
    assert (s["token_count"], s["distinct_token_count"], s["stop_word_token_count"], s["content_token_count"], s["chapter_count"]) == (6, 5, 1, 5, 1)
    d = index.index_diagnostics(df).collect()[0]
    assert (d["coverage_percentage"], d["word_token_delta"], d["run_position_gap_count"]) == (100.0, 0, 0)
    assert rows(index.health(df), "overall_ok", "warnings") == [(True, "")]


def test_run_positions(chapters):
    df = chapters(("en", "b", "one two"), ("en", "a", "three"), ("en", "b", ""), ("en", "a", "four five six"))
    got = sorted(rows(index.run_positions(df), "book", "chapter_id", "first_run_position", "last_run_position"))
    assert got == [("a", 2, 1, 1), ("a", 4, 2, 4), ("b", 1, 5, 6)]


def test_concordance(chapters):
    df = chapters("Hello, Alice. Alice looked at the rabbit. The rabbit saw Alice again.", "No Alice here? Yes, Alice is here.")
    got = context.concordance(df, "ALICE", 2).orderBy("chapter_id", "chapter_position").collect()
    assert len(got) == 5 and got[0]["token_text"] == "Alice" and got[0]["left_context"] == "Hello" and got[0]["right_context"] == "Alice looked"
    said = context.concordance(chapters("The old man said: “I have a view,” and smiled."), "said", 4).collect()[0]
    assert said["left_context"] == "The old man" and said["right_context"].startswith("I have a view")
    sister = "Alice’s sister said that Alice's cat won’t stay."
    assert [r["token_text"] for r in context.concordance(chapters(sister), "alice's").orderBy("start_offset").collect()] == ["Alice’s", "Alice's"]
    assert [r["token_text"] for r in context.concordance(chapters(sister), "won't").collect()] == ["won’t"]


def test_collocations(chapters):
    got = {r["collocate"]: r for r in context.collocations(chapters("Alice saw white rabbit. Alice followed rabbit."), "alice", 2).collect()}
    r, w = got["rabbit"], got["white"]
    assert (r["count"], r["left_count"], r["right_count"], r["rate_per_target"], r["average_distance"], r["dice"]) == (2, 1, 1, 1.0, 1.5, 1.0)
    assert (w["count"], w["average_distance"], round(w["dice"], 2)) == (2, 2.0, 0.67) and "alice" not in got
    whale = context.collocations(chapters("the sperm whale met the sperm whale. the whale saw the sea. the sky and the sea were blue."), "whale", 2)
    assert whale.orderBy(F.desc("dice"), F.desc("count")).first()["collocate"] == "sperm"


def test_phrases(chapters):
    df = chapters("Piazza del Duomo era piena. Nella piazza del Duomo arrivò gente. Piazza, del resto, era grande.", run="it")
    got = {r["phrase"]: r for r in context.phrases(df).collect()}
    assert (got["piazza del duomo"]["n"], got["piazza del duomo"]["count"], got["piazza del duomo"]["chapter_count"]) == (3, 2, 1)
    assert got["piazza del"]["count"] == 2
    assert rows(context.longest_only(context.phrases(df)), "phrase") == [("piazza del duomo",)]
    assert rows(context.with_boundary(context.phrases(df, 3, 3)), "boundary") == [("content/content",)]


def test_explorers(chapters):
    df = chapters("the grey sea and the grey sky. the grey sea sang.", "a grey sea. the sky fell.")
    assert rows(explore.next_words(df, "grey", 5, AnalysisSettings(min_next_word_pair_count=1)), "rank", "next_word", "count") == [(1, "sea", 3), (2, "sky", 1)]
    assert rows(explore.previous_words(df, "GREY", 1, AnalysisSettings(min_next_word_pair_count=1)), "word", "count") == [("the", 3)]
    assert rows(explore.ngrams(df, "sea", 2, kind="content", limit=1), "text", "count", "pattern") == [("grey sea", 3, "C-C")]
    assert rows(explore.phrases(df, 2, 3, content_boundary=True, limit=5), "phrase", "count", "chapter_count") == [("grey sea", 3, 2)]
    assert rows(context.content_boundary(context.phrases(df, 2, 2, 2)), "phrase") == [("grey sea",)]
    first = explore.collocations(df, "grey", 1, word_class="content", limit=1).collect()[0]
    assert (first["collocate"], first["rank"]) == ("sea", 1)
    whole = {(r["section"], r["item"]): r["count"] for r in explore.word(df, "sea", settings=AnalysisSettings(min_next_word_pair_count=1)).collect()}
    assert whole["word", "sea"] == 3 and whole["next", "sang"] == 1 and whole["previous", "grey"] == 3 and whole["book", "b"] == 3
    assert sum(k[0] == "context" for k in whole) == 3 and explore.word(df, "none").count() == 0
    words = stats.word_frequencies(chapters(("l", "b", "x x y"), ("r", "b", "y z")))
    assert rows(explore.comparison(words, "l", "r", limit=1), "word", "rank") == [("x", 1)]
    # With compat, filters see the first rows only: here 300 of the 441 pairs of function words, which all come before the content words.
    stops = lexicon.stop_words("en")[:21]
    many = chapters(". ".join([f"{a} {b}" for a in stops for b in stops] * 2 + ["grey sea"]))
    one = AnalysisSettings(min_ngram_count=1, ngram_max_n=2)
    assert rows(explore.ngrams(many, kind="content", limit=1, settings=one), "text") == [("grey sea",)]
    assert explore.ngrams(many, kind="content", limit=1, compat=True, settings=one).count() == 0


def test_find_positions(chapters):
    text = "Sea, SEA and seas; no se a."
    got = rows(books.find_positions(chapters(text, "none"), "sea").orderBy("match_index"), "chapter_id", "match_index", "start_offset", "match")
    assert got == [(1, 1, 0, "Sea"), (1, 2, 5, "SEA"), (1, 3, 13, "sea")] and all(text[a : a + 3] == m for _, _, a, m in got)


def test_offsets_of_long_chapters(chapters):
    text = " ".join(f"w{'x' * (k % 7)}" for k in range(500))
    got = index.token_index(chapters(text)).collect()
    assert len(got) == 500 and all(text[r["start_offset"] : r["end_offset"]] == r["token_text"] for r in got)
    lines = context.concordance(chapters(text), "wxx").collect()
    assert len(lines) == 72 and all(text[r["start_offset"] :].startswith("wxx ") for r in lines[:-1])


def test_word_books(chapters):
    df = chapters(("en", "Moby Dick", "whale whale sea"), ("en", "The Pirate", "sea whale"), ("en", "Other", "land"))
    got = rows(books.word_distribution(df, "Whale").orderBy(F.desc("count")), "book", "count", "word_token_count")
    assert got == [("Moby Dick", 2, 3), ("The Pirate", 1, 2)]
    assert rows(books.word_coverage(df, "whale"), "matched_books", "source_books") == [(2, 3)]


def test_source_books(spark):
    runs = spark.createDataFrame([(1, 10), (2, 20)], "run_id bigint, book_id bigint")
    links = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "run_id bigint, book_id bigint, order_index int")
    assert sorted(rows(books.source_books(runs, links), "run_id", "book_id")) == [(1, 11), (1, 12), (2, 20)]


def test_compare(chapters):
    words = stats.word_frequencies(chapters(("l", "b", "a a b"), ("r", "b", "a c c c")))
    got = {r["word"]: r for r in compare.compare_words(words, "l", "r").collect()}
    assert got["b"]["ratio"] == float("inf") and got["b"]["direction"] == "left" and got["c"]["direction"] == "right" and got["c"]["ratio"] == 0.0
    assert rows(compare.compare_words(words, "l", "r", "shared"), "word") == [("a",)]
    assert sorted(rows(compare.compare_words(words, "l", "r", "exclusive"), "word")) == [("b",), ("c",)]


def test_difficulty(chapters):
    text = "the cat elephant extraordinary the cat elephant extraordinary elephant extraordinary"
    d = compare.difficulty(chapters(text), (7, 10)).collect()[0]
    assert (d["content_share"], d["function_share"], d["long_share"], d["very_long_share"], d["lexical_diversity"]) == (0.8, 0.2, 0.6, 0.3, 400.0)
    both = compare.difficulty(chapters(("en", "b", text), ("de", "b", "ja")))
    assert compare.compare_difficulty(both, "de", "en").collect()[0]["harder"] == "en"


def test_chapters(spark):
    df = spark.createDataFrame([("en", "b", 1, "One sentence. Another sentence!", "A"), ("en", "b", 2, "Project Gutenberg notice.", "Copyright"), ("en", "b", 3, " ", "x")], "run string, book string, chapter_id bigint, text string, title string")
    got = {r["chapter_id"]: r for r in books.chapter_metrics(df).collect()}
    assert (got[1]["word_count"], got[1]["sentence_count"], got[1]["quality"]) == (4, 2, "very short")
    assert got[2]["quality"] == "very short · potentially suspicious" and got[3]["quality"] == "empty"
    assert rows(books.find_in_chapters(df, "SENTENCE"), "chapter_id", "matches") == [(1, 2)]


def test_import_diagnostics(chapters):
    df = chapters("", "Contents\nChapter I\n", "Sommario\nUn testo", "It has a licence.", "Plain prose.")
    got = dict(rows(books.suspicious_chapters(df), "chapter_id", "reason"))
    assert got == {1: "empty chapter", 2: "short table-of-contents-like chapter", 3: "short table-of-contents-like chapter", 4: "contains 'licence'"}
    d = books.import_diagnostics(df).collect()[0]
    assert (d["chapter_count"], d["empty_chapters"], d["short_chapters"], d["suspicious_chapters"]) == (5, 1, 4, 4)
    assert dict(rows(books.suspicious_terms(df), "term", "count")) == {"sommario": 1, "licence": 1}


def test_profile_and_limits(chapters):
    p = corpus_profile(chapters(SAMPLE), 3).collect()[0]
    assert p["top_content_words"].split()[0] in {"hello", "know"} and p["top_function_words"].split()[0] == "don't"
    assert set(analyse(chapters(SAMPLE))) == {"summary", "words", "ngrams", "next_words", "categories"}
    assert (limit_of(0, compat=True), limit_of(500), window_of(99, True), context_of(0, True), phrase_lengths(1, 99, True), phrase_lengths(5, 3, True)) == (1, 500, 10, 1, (2, 8), (5, 5))
    for f, *bad in ((limit_of, 0), (limit_of, 500, 100), (window_of, 11), (context_of, 31), (phrase_lengths, 1, 5), (phrase_lengths, 2, 9), (phrase_lengths, 5, 3)):
        with pytest.raises(ValueError):
            f(*bad)
    with pytest.raises(ValueError):
        limit_of(5000)
    with pytest.raises(ValueError):
        stats.top_words(stats.word_frequencies(chapters(SAMPLE)), 3, "odd")


def test_stop_words_of_regional_and_padded_languages(spark):
    from wordloom.functions import text as X

    df = spark.createDataFrame([("the", x) for x in ("en", " EN-gb\t", " en_US-x", " en　", "fr", "", "e n", None)], "word string, run string")
    assert [r[0] for r in df.select(X.is_stop_word(F.col("word"), F.col("run"))).collect()] == [True, True, True, True, False, False, False, False]
    plan = index.token_index(df.select("run", F.lit("b").alias("book"), F.lit(1).alias("chapter_id"), F.col("word").alias("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(" not in plan and "zip_with" not in plan  # nothing is added up or matched for each token's language


def test_next_words_are_cut_from_the_text_once(chapters):
    df = stats.next_words(chapters("One two. Two three two\n\nthree?", ""), AnalysisSettings(min_next_word_pair_count=1))
    assert sorted(rows(df, "word", "next_word", "count", "probability")) == [("one", "two", 1, 1.0), ("three", "two", 1, 0.5 * 2), ("two", "three", 2, 1.0)]
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_and_sentences_are_counted_without_normalising(spark):
    """white space changes neither number, so texts aren't normalised for reading, nor sentences trimmed, to count them."""
    seed = random.Random(10)
    parts = ["\r\n", "\n\n\n", "\t ", "  ", "\x85", " ", "  ", ".", "?", "!\"", "’", "“Mr", "e.g", "½", "3", "²", ",", "…", "don’t", "So", "a-b", "—", "é", "$"]
    texts = ["".join(seed.choices(parts, k=seed.randint(0, 40))) for _ in range(400)] + ["", " \n ", None]
    df = spark.createDataFrame([(str(k), "b", k, t) for k, t in enumerate(texts)], "run string, book string, chapter_id bigint, text string")
    got = {r["run"]: (r["sentence_count"], r["token_count"]) for r in stats.run_words(df).where("is_total").collect()}
    sentences = {r["run"]: r["count"] for r in stats.sentence_table(df).groupBy("run").count().collect()}
    tokens = {r["run"]: r["count"] for r in stats.sentence_tokens(df).groupBy("run").count().collect()}
    assert got == {str(k): (sentences.get(str(k), 0), tokens.get(str(k), 0)) for k in range(len(texts))} and max(sentences.values()) > 5


def test_a_profile_reads_texts_twice(spark):
    """once for words and once for phrases, and books' names."""
    seen = spark.sparkContext.accumulator(0)

    def counted(r):
        seen.add(1)
        return r

    own = spark.sparkContext.parallelize([("en", f"b{k % 3}", k, SAMPLE) for k in range(8)], 2)
    profile = corpus_profile(spark.createDataFrame(own.map(counted), "run string, book string, chapter_id bigint, text string"))
    seen.value = 0
    assert profile.first()["book_count"] == 3 and seen.value <= 3 * 8
