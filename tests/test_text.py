"""Normalisation, sentences, tokens, sentence classes and word lists."""

import pytest
from pyspark.sql import functions as F

from wordloom.functions import lexicon
from wordloom.functions import text as X


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).collect()[0]["x"]


def test_for_reading(spark):
    assert column(spark, "  Look\r\n\r\n\r\n“Mara” wrote: ‘no’.  ", X.for_reading) == "Look\n\n\"Mara\" wrote: 'no'."
    assert column(spark, "a\x0bb\n\tc — d", X.for_reading) == "a b\n c - d"
    assert column(spark, "A\n\nB", X.inline) == "A B" and column(spark, "A\nB", X.key) == "a b"


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("Evening, Mara. We can't stay. Is the ferry late? Well, it isn't.", 4),
        ("Dr. Lind is out. Come back later!", 2),
        ("Mrs. Oak knocked twice. Prof. Elm slept on.", 2),
        ("Bring tools, e.g. a saw. We start at six.", 2),
        ('"Where is the key?" asked the porter. Nobody knew.', 2),
        ('"Mind the step!" called Ines. The lamp went out.', 2),
        ("PART II. The Salt-Road. Snow had begun to fall over the pass.", 3),
        ("It weighs 2.75 kilos. Take it.", 2),
        ("Wait... what? No end", 3),
        ("", 0),
        ("   ", 0),
    ],
)
def test_sentences(spark, text, n):
    assert len(column(spark, text, lambda c: X.sentences(X.for_reading(c)))) == n


def test_tokens(spark):
    def kinds(text):
        rows = spark.createDataFrame([(text,)], "c string").select(F.explode(X.tokens(F.col("c"))).alias("t")).select("t", X.token_kind(F.col("t"))).collect()
        return [tuple(r) for r in rows]

    assert kinds("We can't swim.") == [("We", "Word"), ("can't", "Word"), ("swim", "Word"), (".", "Punctuation")]
    assert kinds("A well-known 1,000.5 €  x") == [("A", "Word"), ("well-known", "Word"), ("1,000.5", "Number"), ("€", "Symbol"), ("x", "Word")]
    assert column(spark, "We’re late; Mara’s boat hasn’t left.", X.words) == ["we're", "late", "mara's", "boat", "hasn't", "left"]


@pytest.mark.parametrize(
    ("text", "category"),
    [
        ("Hi, Mara.", "Greeting"),
        ("Good evening, captain.", "Greeting"),
        ("They never came back.", "Negation"),
        ("Would you hold the rope, please?", "Question"),
        ("Please hold the rope.", "Request"),
        ('She asked "Why?" and sat down.', "Statement"),
        ('"What now?!" cried Ines.', "Exclamation"),
        ('"Is it far?" said the boy.', "Question"),
        ("The road is long.", "Statement"),
        ("Run!", "Exclamation"),
        ("Non parte nessuno.", "Negation"),
        ("...", "Other"),
    ],
)
def test_sentence_category(spark, text, category):
    assert column(spark, text, lambda c: X.sentence_category(c, X.words(c))) == category


def test_word_lists(spark):
    en, it = lexicon.stop_words("en-GB"), lexicon.stop_words(" IT ")
    assert {"don't", "i'm", "won't", "couldn't"} <= set(en) and not {"alice's", "rabbit's"} & set(en)
    assert {"i", "è", "me", "egli", "quel", "fu"} <= set(it) and not {"disse", "casa", "vita"} & set(it)
    assert lexicon.stop_words("xx") == () and lexicon.thresholds("xx") == (7, 10) and lexicon.thresholds("it") == (8, 12)
    assert {"andere", "dein", "jedes", "derselbe"} <= set(lexicon.stop_words("de")) and "manch" not in lexicon.stop_words("de")
    assert set(lexicon.stop_words("en", "fr")) == set(lexicon.stop_words("en")) | set(lexicon.stop_words("fr"))


def test_snippets(spark):
    assert column(spark, "A tall\n boy cried: “", X.left_snippet) == "A tall boy cried: “"
    assert column(spark, "A tall boy , ", X.left_snippet) == "A tall boy"
    assert column(spark, ": “There is land", X.right_snippet) == "There is land"


def test_shown_numbers(spark):
    from wordloom.functions import measures as M

    def all_of(f, *values):
        return [r[0] for r in spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(f(F.col("v"))).collect()]

    assert all_of(M.shown, 1.0, 0.126, -0.001, 12.5) == ["1", "0.13", "0", "12.5"]
    assert all_of(lambda c: M.shown(c, signed=True), 3, -2.5, 0) == ["+3", "-2.5", "0"]
    assert all_of(M.shown_ratio, float("inf"), float("nan"), 0.001, 0.0, 2.345) == ["inf", "n/a", "<0.01", "0", "2.35"]
    assert all_of(M.shown_size, 10, 1536, 5 * 2**20, 3 * 2**30) == ["10 B", "1.5 KiB", "5 MiB", "3 GiB"]
    assert all_of(M.shown_share, 0.5, 0.12346) == ["50.00%", "12.35%"]
    assert column(spark, "lighthouse", lambda c: M.shortened(c, 6)) == "light…" and column(spark, "lamp", lambda c: M.shortened(c, 6)) == "lamp"
