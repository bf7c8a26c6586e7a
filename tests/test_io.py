"""Sources, cleaning, sinks, catalog and streaming."""

import zipfile

import pytest
from pyspark.sql import functions as F

from wordloom.functions import cleaning
from wordloom.operators import books, stats, stored
from wordloom.plans.profile import analyse, analyse_folder
from wordloom.sinks import reports
from wordloom.sinks.catalog import Catalog, Conflict
from wordloom.sources import books as sources
from wordloom.sources.html import visible_text
from wordloom.streaming import ingest


def test_html(spark):
    pages = {
        "<p>Hello,    Tom.</p><p>Good&nbsp;&nbsp;morning.</p>": "Hello, Tom.\nGood morning.", None: "", " \n": "", "a<br>b<BR/>c": "a\nb\nc",
        "<html><head><title>x</title><style>p{}</style></head><body><script>a('<p>')</script><p>Visible text.</p></body></html>": "Visible text.",
        "x &lt;p&gt; &amp;lt; a&#10;b": "x <p> &lt; a b", "&#65;&#x42;&#x110000;&#0;&#150;&notit;&copy 5&copycat;&bogus;&": "AB\ufffd\ufffd–¬it;© 5©cat;&bogus;&", "&#99999999999999999999;": "\ufffd",
        "a < b > c <3": "a < b > c <3", "<a title='x>y'>z</a>": "z", "<!-- <p> -->t<!-- open": "t", "<script>x": "", "1<prefix>2</prefix>3<p>4": "123\n4", "<noscript>n</noscript>m<scripted>q</scripted>": "mq",
        "pre<BODY class=x>in<body>again": "in\nagain", "cut <p": "cut", "é&eacute;&#233; ": "ééé", "<!DOCTYPE html><?x y?>t": "t", "<ul><li>one<li>two &#128512;</ul>": "one\ntwo 😀",
    }
    got = spark.createDataFrame(list(enumerate(pages)), "k int, h string").select("k", visible_text(F.col("h")).alias("t")).orderBy("k")
    assert [r["t"] for r in got.collect()] == list(pages.values())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_markers(spark):
    text = "Header\n*** START OF THE PROJECT GUTENBERG EBOOK SAMPLE ***\n\nBody one.\nBody two.\n*** END OF THE PROJECT GUTENBERG EBOOK SAMPLE ***\nLicence"
    got = spark.createDataFrame([(text,), ("plain",)], "t string").select(cleaning.without_markers(F.col("t"))).collect()
    assert [r[0].strip() for r in got] == ["Body one.\nBody two.", "plain"]


def cleaned(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, page string")
    return [tuple(r) for r in cleaning.with_cleaned(df, F.col("page")).orderBy("k").select("text", "is_front_matter").collect()]


def test_contents_and_library_matter(spark):
    toc = "The Ferry\n\nContents\nChapter I.\nChapter II.\n\n\nChapter I.\nThe boat left before dawn.\nChapter II.\nNobody spoke."
    far = "Contents\nChapter I.\n" + "word " * 4000 + "\nChapter I.\nToo far."
    book = "Liber Liber\nQuesto e-book fu preparato\nTITOLO: Il faro\nAUTORE: N. N.\n\n  Capitolo I\r\nPioveva sul porto."
    roman = "Liber Liber\nautore: N. N.\nII\nhttp://x\nLa casa\nAltro."
    prose = "Liber Liber\nindice dei nomi\nUna riga breve.\n" + "parola " * 13
    got = cleaned(spark, toc, far, book, roman, prose, None, "  \n ", "Just prose.\nMore of it.")
    assert got[0] == ("Chapter I.\nThe boat left before dawn.\nChapter II.\nNobody spoke.", False)
    assert got[1][0].startswith("Contents\nChapter I.")
    assert got[2][0] == "Capitolo I\r\nPioveva sul porto." and got[3][0] == "II\nhttp://x\nLa casa\nAltro." and got[4][0].startswith("parola parola")
    assert got[5:] == [("", True), ("", True), ("Just prose.\nMore of it.", False)]


def test_front_matter(spark):
    only = "Questo e-book\nLiber Liber\nlicenza: libera"
    chapters = "Indice\nCapitolo I\nCapitolo II\n3 - La fine"
    long = chapters + "\n" + "word " * 12
    prose = "Contents of the chest:\nChapter I\nChapter II\nChapter III"
    df = spark.createDataFrame(list(enumerate([only, "", None, chapters, long, prose])), "k int, t string")
    got = [r[0] for r in cleaning.with_front_matter(df, "t").orderBy("k").select("is_front_matter").collect()]
    assert got == [True, True, True, True, False, False]


def _epub(path, title, chapters):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="c{k}.xhtml"/>' for k in range(len(chapters)))
        spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(chapters)))
        z.writestr("OPS/c.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>')
        for k, c in enumerate(chapters):
            z.writestr(f"OPS/c{k}.xhtml", f"<html><body>{c}</body></html>")


@pytest.fixture
def library(spark, tmp_path):
    _epub(tmp_path / "a.epub", "Alpha", ["<p>First text of it.</p>", "<p> </p>", "<p>Second text.</p>"])
    _epub(tmp_path / "b.epub", "Beta", ["<p>Other text.</p>"])
    _epub(tmp_path / "empty.epub", "None", ["<p></p>"])
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    return sources.read_books(spark, str(tmp_path), "en")


def test_books(library):
    chapters, failures = library
    got = [tuple(r) for r in chapters.select("title", "order_index", "chapter_title", "text").orderBy("title", "order_index").collect()]
    assert got == [("Alpha", 1, "Chapter 1", "First text of it."), ("Alpha", 2, "Chapter 2", "Second text."), ("Beta", 1, "Chapter 1", "Other text.")]
    assert sorted(r["name"] for r in failures.collect()) == ["bad.epub", "empty.epub"]
    whole = [tuple(r) for r in sources.aggregate_book(chapters).select("order_index", "chapter_title").orderBy("order_index").collect()]
    assert whole == [(1, "Alpha — Chapter 1"), (2, "Alpha — Chapter 2"), (3, "Beta — Chapter 1")]
    named = sources.aggregate_book(chapters, "/books/of mine").first()
    assert named["book_id"] == sources.folder_id("/books/of mine") and named["title"] == "EPUB folder: of mine" and len(named["book_id"]) == 28
    many = chapters.sparkSession.createDataFrame([(f"/x/{n}", n[0], "", k, f"p{k}", "en", "t") for n in ("b2", "B1", "ba", "a", "_c", "C") for k in (1, 2)], "source_path string, title string, chapter_title string, order_index int, part_path string, lang string, text string")
    order = sources.aggregate_book(many).orderBy("order_index").collect()
    assert [r["order_index"] for r in order] == list(range(1, 13)) and [r["source"] for r in order][:4] == ["/x/a::p1", "/x/a::p2", "/x/B1::p1", "/x/B1::p2"] and order[0]["chapter_title"] == "a"
    assert sources.aggregate_id(["b", "a"]) == sources.aggregate_id(["a", "b"])


def test_read_texts(spark, tmp_path):
    (tmp_path / "one.txt").write_text("a\nb")
    assert [tuple(r) for r in sources.read_texts(spark, str(tmp_path), "en").select("title", "content").collect()] == [("one", "a\nb")]


def test_reports(spark, chapters, tmp_path):
    df = chapters('He said, "no, no". He said it.')
    tables = analyse(df)
    reports.write_csv(tables["words"], "words", str(tmp_path / "w"))
    lines = "".join(p.read_text() for p in (tmp_path / "w").glob("part-*")).splitlines()
    assert lines[0] == "word,count,document_count,frequency_per_million,is_stop_word" and lines[1].startswith("he,2,1,285714.2857,")
    reports.write_csv(tables["words"], "words", str(tmp_path / "m"), mark=True)
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbfword,count") for p in (tmp_path / "m").glob("part-*"))
    text = reports.markdown_report("T", tables["summary"], tables["words"], tables["ngrams"], tables["next_words"], tables["categories"])
    assert "| Documents | 1 |" in text and "## Next words" in text
    fails = spark.createDataFrame([("/x", "x", "m", "E")], "path string, name string, error_message string, exception_type string")
    out = reports.diagnostics_report(books.import_diagnostics(df), fails, books.suspicious_terms(df), books.suspicious_chapters(df), books.extreme_chapters(df, False), books.extreme_chapters(df, True))
    assert "| x | E | m |" in out
    reports.save_markdown(spark, out, str(tmp_path / "d.md"))
    assert (tmp_path / "d.md").read_text() == out
    reports.write_text(df, str(tmp_path / "t"))


def test_catalog(spark, chapters, library, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    corpus = c.create_corpus("Tales", "en-GB")
    with pytest.raises(ValueError):
        c.create_corpus(" tales ", "en")
    with pytest.raises(ValueError):
        c.create_corpus("x", "xx")
    c.add_books(corpus, library[0])
    c.add_books(corpus, library[0])
    assert c.table("book").count() == 2
    ids = [r["book_id"] for r in c.table("book").orderBy("title").collect()]
    links = spark.createDataFrame([(ids[0], 1)], "book_id string, order_index int")
    run = c.save_run(corpus, analyse(chapters("One two. One two.")), links)
    second = c.save_run(corpus, analyse(chapters("Three.")))
    assert [r["run_id"] for r in c.runs(corpus).collect()] == [second, run]
    assert c.statistics(run, "word").where("word = 'one'").collect()[0]["count"] == 2
    c.replace_statistics(run, "word", stats.word_frequencies(chapters("four")))
    assert [r["word"] for r in c.statistics(run, "word").collect()] == ["four"] and c.statistics(second, "word").count() == 1
    c.delete_books([ids[0]])
    assert c.table("book").count() == 1 and [r["run_id"] for r in c.runs().collect()] == [second] and c.statistics(run, "word").count() == 0
    (tmp_path / "cat" / "out").mkdir()
    (tmp_path / "cat" / "out" / "import_diagnostics.md").write_text("x")
    (tmp_path / "cat" / "out" / "words.csv").write_text("x")
    got = {k: v[1] for k, v in c.artifacts({"report": "out/report.md", "words": str(tmp_path / "cat/out/words.csv"), "ngrams": None}).items()}
    assert got == {"report": "Missing", "words": "Available", "ngrams": "NotGenerated", "next-words": "NotGenerated", "extracted-text": "NotGenerated", "import-diagnostics": "Available", "import-failures": "NotGenerated"}


def test_of_two_writers_one_is_told(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    c.create_corpus("One", "en")
    version, rows = c._at("corpus")
    c.create_corpus("Two", "fr")
    with pytest.raises(Conflict):
        c._replace("corpus", version, rows)
    assert [r["name"] for r in c.corpora().collect()] == ["One", "Two"]


def test_from_files_to_statistics(spark, tmp_path):
    (tmp_path / "books").mkdir()
    _epub(tmp_path / "books" / "b.epub", "Beta", ["<p>The sea was calm. The sea was grey.</p>", "<p>A sail!</p>"])
    _epub(tmp_path / "books" / "a.epub", "Alpha", ["<p>The sea again.</p>"])
    c = Catalog(spark, str(tmp_path / "cat"))
    corpus = c.create_corpus("Sea", "en")
    run = analyse_folder(spark, str(tmp_path / "books"), "en-GB", c, corpus)
    words = {r["word"]: (r["count"], r["document_count"]) for r in c.statistics(run, "word").collect()}
    assert words["sea"] == (3, 2) and words["sail"] == (1, 1)
    assert [r["title"] for r in c.run_books(run).collect()] == ["Alpha", "Beta"] and c.languages(run) == ["en-gb"]
    assert c.runs().first()["document_count"] == 3 and c.statistics(run, "token_occurrence").count() == 13
    assert [(r["title"], r["word_count"]) for r in c.chapters(run).orderBy("book", "chapter_id").collect()] != [] and c.chapters(run).count() == 3
    assert [r["word"] for r in stored.concordance(c.store, c._run(run)["stored_run_id"], "sail").select(F.col("token_text").alias("word")).collect()] == ["sail"]
    alpha, beta = (c.table("book").where(F.col("title") == t).first()["book_id"] for t in ("Alpha", "Beta"))
    c._replace("run_book", *(lambda at, rows: (at, rows.where("false")))(*c._at("run_book")))  # without links the stored chapters' books are the run's
    assert {r["title"] for r in c.run_books(run).collect()} == {"Alpha", "Beta"}
    c._replace("run_book", *(lambda at, rows: (at, rows.union(spark.createDataFrame([(run, alpha, 1), (run, beta, 2)], rows.schema))))(*c._at("run_book")))
    c.delete_books([alpha], analyse)
    words = {r["word"]: (r["count"], r["document_count"]) for r in c.statistics(run, "word").collect()}
    assert words["sea"] == (2, 1) and "again" not in words and c.runs().first()["document_count"] == 2 and c.chapters(run).count() == 2
    assert {(r["word"], r["next_word"]) for r in c.statistics(run, "next_word").collect()} == {("the", "sea"), ("sea", "was")}
    chapters, _ = sources.read_run(spark, str(tmp_path / "books"), "en")
    assert {r["chapter_id"] for r in books.chapter_metrics(chapters).collect()} == {1, 2} and books.chapter_metrics(chapters).count() == 3
    one, same = sources.folder_hash(spark, str(tmp_path / "books")), sources.folder_hash(spark, str(tmp_path / "books") + "/")
    (tmp_path / "books" / "a.epub").rename(tmp_path / "books" / "c.epub")
    assert one == same != sources.folder_hash(spark, str(tmp_path / "books")) and len(one) == 64
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.epub").write_bytes(b"no archive")
    with pytest.raises(sources.BookError):
        sources.read_run(spark, str(tmp_path / "none"), "en")
    assert stats.word_frequencies(sources.demo_chapters(spark)).count() > 10


def test_failed_run_leaves_nothing(spark, chapters, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    tables = analyse(chapters("One two."))
    tables["ngrams"] = tables["ngrams"].withColumn("bad", F.raise_error(F.lit("stop")).cast("string")).union(tables["ngrams"].withColumn("bad", F.lit("x")))
    tables["ngrams"] = tables["words"].withColumn("bad", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        c.save_run(1, tables)
    assert c.runs().count() == 0 and c.statistics(1, "word").count() == 0


def test_stream(spark, tmp_path):
    rows = [("en", "b", 1, "One two one.", "2024-01-01 00:10:00"), ("de", "b", 2, "Drei", "2024-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "run string, book string, chapter_id bigint, text string, arrived string").withColumn("arrived", F.to_timestamp("arrived"))
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.chapter_stream(spark, str(tmp_path / "in"))
    ingest.append_index(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    q = ingest.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["word"], r["count"]) for r in spark.table("counts").collect()} == {("one", 2), ("two", 1), ("drei", 1)}
