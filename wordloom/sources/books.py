"""Books from files: whole text files, EPUB archives, and folders of them. Paths may be on any file system Spark reads."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.cleaning import with_cleaned
from wordloom.sources.html import visible_text


def read_texts(spark: SparkSession, path: str, language: str, title: str | None = None) -> DataFrame:
    """Each file as a document: doc_id (SHA-256), title (the file's stem unless given), lang, content."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_name").alias("name"))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return rows.select(F.sha2(F.col("content").cast("binary"), 256).alias("doc_id"), (F.lit(title) if title else stem).alias("title"), F.lit(language).alias("lang"), "content")


class BookError(ValueError):
    """A file that can't be read as a book."""


def parts_of(data: bytes) -> tuple[str, str, list[tuple[str, str]]]:
    """Title, author and (path, HTML) of the spine's files, in reading order, of an EPUB archive."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = set(archive.namelist())
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        root = next(x.attrib["full-path"] for x in container.iter() if x.tag.endswith("}rootfile"))
        package = ElementTree.fromstring(archive.read(root))
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
        raise BookError(f"not a readable EPUB archive: {e}") from e
    local = lambda x: x.tag.rsplit("}", 1)[-1]
    first = lambda name: next(("".join(x.itertext()).strip() for x in package.iter() if local(x) == name), "")
    items = {x.attrib.get("id"): x.attrib.get("href", "") for x in package.iter() if local(x) == "item"}
    order = [items.get(x.attrib.get("idref")) for x in package.iter() if local(x) == "itemref"]
    paths = [posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(h))) for h in order if h]
    return first("title"), first("creator"), [(p, archive.read(p).decode("utf-8-sig", "replace")) for p in paths if p in names]


_PARTS = "path string, name string, file_hash string, title string, author string, part int, part_path string, html string, error string, error_type string"


def _parts(files: DataFrame) -> DataFrame:
    """A row for each spine file of each archive, or one with the error."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, name, digest, data in zip(batch["path"], batch["name"], batch["file_hash"], batch["content"]):
                try:
                    title, author, parts = parts_of(data)
                    stem = re.sub(r"\.[^.]*$", "", name)
                    rows += [(path, name, digest, title or stem, author or "Unknown", k, p, h, None, None) for k, (p, h) in enumerate(parts)]
                    if not parts:
                        raise BookError("no readable text content")
                except Exception as e:  # one bad file doesn't end the import
                    rows.append((path, name, digest, None, None, None, None, None, str(e), type(e).__name__))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARTS.split(", ")])

    return files.mapInPandas(run, _PARTS)


def read_books(spark: SparkSession, folder: str, language: str, pattern: str = "*.epub", recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Chapters and failures of the EPUB files of a folder (or of one file).

    Chapters: book_id (SHA-256 of the file), title, author, lang, source_path, order_index from 1, chapter_title, part_path,
    text. Blank chapters and front matter are dropped. Failures: path, name, message, exception type; also of books without
    a chapter left.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("file_hash"), "content")
    parts = _parts(files)
    own = with_cleaned(parts.where("error is null").withColumn("page", visible_text(F.col("html"))), F.col("page"))
    kept = own.where((F.col("text") != "") & ~F.col("is_front_matter"))
    order = F.row_number().over(Window.partitionBy("path").orderBy("part"))
    chapters = kept.withColumn("order_index", order).select(
        F.col("file_hash").alias("book_id"), "title", "author", F.lit(language.strip()).alias("lang"), F.col("path").alias("source_path"), "order_index",
        F.format_string("Chapter %d", "order_index").alias("chapter_title"), "part_path", "text",
    )
    bad = parts.where("error is not null").select("path", "name", F.col("error").alias("error_message"), F.col("error_type").alias("exception_type"))
    empty = own.select("path", "name").distinct().join(kept.select("path").distinct(), "path", "left_anti")
    return chapters, bad.union(empty.select("path", "name", F.lit("no readable text content"), F.lit("BookError")))


def run_chapters(books: DataFrame, run: str | None = None) -> DataFrame:
    """read_books' chapters as the operators want them: run (the language unless given), book (its id), chapter_id (its place in the book),
    text; title and book_title go with them. A chapter is told by book and chapter_id."""
    return books.select((F.lit(run) if run else F.col("lang")).alias("run"), F.col("book_id").alias("book"), F.col("order_index").cast("bigint").alias("chapter_id"), "text", F.col("chapter_title").alias("title"), F.col("title").alias("book_title"))


def read_run(spark: SparkSession, folder: str, language: str, pattern: str = "*.epub", recursive: bool = False, run: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The chapters of a folder's books for the operators, and the failures. No readable book is an error; a single bad one isn't."""
    chapters, failures = read_books(spark, folder, language, pattern, recursive)
    if chapters.isEmpty():
        raise BookError(f"no readable book in {folder}: {failures.count()} failures")
    return run_chapters(chapters, run), failures


def folder_hash(spark: SparkSession, folder: str, pattern: str = "*.epub") -> str:
    """SHA-256 over the relative path, a zero byte and the SHA-256 of each file of a folder and those below it, in order of path."""
    import hashlib

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(root).toUri().getPath().rstrip("/")
    own = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.\-]*:(?://[^/]*)?", "")
    rows = files.select(own.alias("path"), F.sha2("content", 256).alias("hash")).collect()  # two short strings a book
    out = hashlib.sha256()
    for path, digest in sorted(((r["path"][len(root) + 1 :], r["hash"]) for r in rows), key=lambda x: (x[0].lower(), x[0])):
        out.update(path.encode() + b"\0" + bytes.fromhex(digest))
    return out.hexdigest()


def demo_chapters(spark: SparkSession) -> DataFrame:
    """A small English chapter to try things on."""
    text = "Good evening, Mara! Have you seen the lighthouse? I haven't seen it yet. The old lighthouse stands on the cliff. Please take the lamp with you."
    return spark.createDataFrame([("en", "demo", 1, text, "Chapter 1")], "run string, book string, chapter_id bigint, text string, title string")


def aggregate_book(chapters: DataFrame, folder: str | None = None) -> DataFrame:
    """All chapters of all books (in order of path, whatever its case) as one book's: a view, texts aren't copied together. Given the folder they
    come from, the book is named after it.

    Chapters are renumbered through the books by adding up the books' numbers of chapters: those of the books that begin alike, and those
    of the beginnings before.
    """
    path = F.upper("source_path")
    sizes = chapters.groupBy(path.alias("_p"), "source_path").agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_start", F.substring(F.element_at(F.split("_p", "/"), -1), 1, 2)).withColumn("_where", F.regexp_replace("_p", "[^/]*$", ""))
    earlier = lambda w: F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.groupBy("_where", "_start").agg(F.sum("_size").alias("_size")).select("_where", "_start", earlier(Window.orderBy("_where", "_start")).alias("_starts"))  # a row a beginning
    own = sizes.select("source_path", "_where", "_start", earlier(Window.partitionBy("_where", "_start").orderBy("_p", "source_path")).alias("_own")).join(starts, ["_where", "_start"])
    own = chapters.join(own.select("source_path", (F.col("_own") + F.col("_starts")).alias("_before")), "source_path")
    title = F.when(F.trim(F.coalesce("chapter_title", F.lit(""))) == "", F.col("title")).otherwise(F.concat_ws(" — ", "title", "chapter_title"))
    return own.select(
        F.lit(folder_id(folder) if folder else "aggregate").alias("book_id"), F.lit(f"EPUB folder: {folder.rstrip('/').rsplit('/', 1)[-1]}" if folder else "").alias("title"),
        (F.col("_before") + F.col("order_index")).alias("order_index"), title.alias("chapter_title"), F.concat_ws("::", "source_path", "part_path").alias("source"), "lang", "text",
    )


def folder_id(folder: str) -> str:
    """Id of a folder's aggregate book, from its path."""
    import hashlib

    return "epub-folder-" + hashlib.sha256(folder.encode()).hexdigest()[:16]


def aggregate_id(hashes: list[str]) -> str:
    """Id of an aggregate of books, from their sorted file hashes."""
    import hashlib

    return "books-" + hashlib.sha256("\n".join(sorted(hashes)).encode()).hexdigest()[:16]
