"""A catalog of corpora, books, runs and their statistics as Parquet tables under a folder.

Statistics are partitioned by run, so a run is replaced by a dynamic overwrite of its partition and deleted by removing it.
A small table is a series of versions: its rows are written to a folder of their own, and the version is committed by creating a file of its
number, which holds the folder's name. Creating a file that exists fails, so of two writers one is told to begin again (:class:`Conflict`),
and whenever a writer stops, the last committed version is whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.lexicon import STOP_WORDS, language_code
from wordloom.settings import AnalysisSettings
from wordloom.sinks.store import RunStore

CORPUS = "corpus_id bigint, name string, language_code string, description string, created_at timestamp, updated_at timestamp"
BOOK = "book_id string, corpus_id bigint, title string, author string, language_code string, source_path string, file_hash string, imported_at timestamp, status string, error_message string"
RUN = "run_id bigint, corpus_id bigint, started_at timestamp, completed_at timestamp, status string, settings_json string, document_count bigint, sentence_count bigint, token_count bigint, word_token_count bigint, distinct_word_count bigint, average_words_per_sentence double, average_characters_per_word double, stored_run_id bigint"
RUN_BOOK = "run_id bigint, book_id string, order_index bigint"
SMALL = {"corpus": CORPUS, "book": BOOK, "run": RUN, "run_book": RUN_BOOK}
STATISTICS = {
    "word": "run string, word string, count bigint, document_count bigint, frequency_per_million double, is_stop_word boolean",
    "ngram": "run string, n bigint, text string, count bigint, document_count bigint, frequency_per_million double",
    "next_word": "run string, word string, next_word string, count bigint, probability double",
    "category": "run string, category string, count bigint, percentage double",
    "token_occurrence": "run string, book string, chapter_id bigint, chapter_position bigint, token_text string, word string, start_offset bigint, end_offset bigint, is_stop_word boolean",
}
#: The names of an analysis' tables, and those of the statistics they are stored as.
_TABLES = {"words": "word", "ngrams": "ngram", "next_words": "next_word", "categories": "category", "tokens": "token_occurrence"}


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


#: Names and files of a run's artifacts; the last two are found beside the others.
ARTIFACTS = {
    "report": "report.md", "words": "words.csv", "ngrams": "ngrams.csv", "next-words": "next_words.csv", "extracted-text": "extracted_text.txt",
    "import-diagnostics": "import_diagnostics.md", "import-failures": "import_failures.csv",
}
RECORDED = 5


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        #: Chapters and indexes of runs, which their rows name by stored_run_id.
        self.store = RunStore(spark, f"{self.root}/store")

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def _exists(self, p: str) -> bool:
        return self.fs.exists(self._path(p))

    def table(self, name: str) -> DataFrame:
        """A table's rows; empty before the first write."""
        if name in SMALL:
            return self._at(name)[1]
        path = f"{self.root}/{name}"
        if not self._exists(path):
            raise LookupError(f"no statistics have been saved: {name}")
        # Columns that older files lack are null.
        return self.spark.read.schema(STATISTICS[name] + ", run_id bigint").parquet(path)

    def _at(self, name: str) -> tuple[int, DataFrame]:
        """The last committed version of a small table, 0 before the first, and its rows."""
        folder = f"{self.root}/{name}/_versions"
        versions = [int(f.getPath().getName()) for f in self.fs.listStatus(self._path(folder))] if self._exists(folder) else []
        if not versions:
            return 0, self.spark.createDataFrame([], SMALL[name])
        stream = self.fs.open(self._path(f"{folder}/{max(versions):08d}"))
        try:
            data = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return max(versions), self.spark.read.schema(SMALL[name]).parquet(f"{self.root}/{name}/{data}")

    def _replace(self, name: str, version: int, df: DataFrame) -> None:
        """Commit ``df`` as the version after ``version``."""
        data = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{data}")
        try:
            out = self.fs.create(self._path(f"{self.root}/{name}/_versions/{version + 1:08d}"), False)
        except Py4JJavaError as e:
            self.fs.delete(self._path(f"{self.root}/{name}/{data}"), True)
            raise Conflict(f"{name}: version {version + 1} has been committed by another writer") from e
        out.write(bytearray(data.encode()))
        out.close()

    # Corpora and books

    def create_corpus(self, name: str, language: str, description: str = "") -> int:
        """Id of the new corpus. Names are unique whatever their ASCII case; the language must have a word list."""
        own, code = name.strip(), language_code(language)
        if not own:
            raise ValueError("a corpus needs a name")
        if code not in STOP_WORDS:
            raise ValueError(f"no such language: {language}")
        version, rows = self._at("corpus")
        if rows.where(F.lower("name") == own.lower()).count():
            raise ValueError(f"there is a corpus of this name: {own}")
        new = (rows.agg(F.max("corpus_id")).collect()[0][0] or 0) + 1
        row = self.spark.range(1).select(F.lit(new).cast("bigint"), F.lit(own), F.lit(code), F.lit(description), F.current_timestamp(), F.current_timestamp())
        self._replace("corpus", version, rows.union(row))
        return new

    def find_corpus(self, name: str):
        found = self.table("corpus").where(F.lower("name") == name.strip().lower()).collect()
        return found[0] if found else None

    def corpora(self) -> DataFrame:
        return self.table("corpus").orderBy(F.lower("name"))

    def add_books(self, corpus_id: int, chapters: DataFrame) -> None:
        """Register the books of read_books' chapters that the corpus doesn't have yet (by file hash)."""
        own = chapters.select("book_id", "title", "author", "lang", "source_path").distinct()
        new = own.select("book_id", F.lit(corpus_id).cast("bigint").alias("corpus_id"), "title", "author", F.col("lang").alias("language_code"), "source_path", F.col("book_id").alias("file_hash"), F.current_timestamp().alias("imported_at"), F.lit("Imported").alias("status"), F.lit(None).cast("string").alias("error_message"))
        version, rows = self._at("book")
        self._replace("book", version, rows.union(new.join(rows.where(F.col("corpus_id") == corpus_id).select("file_hash"), "file_hash", "left_anti").select(*rows.columns)))

    # Runs

    def save_run(self, corpus_id: int, tables: dict[str, DataFrame], books: DataFrame | None = None, settings: AnalysisSettings = AnalysisSettings(), stored_run_id: int | None = None) -> int:
        """Store one run's tables (summary of one row, words, ngrams, next_words, categories, maybe tokens) and return its id. Its chapters and
        index may be those of a run of the store.

        The run's row is committed first, as Running, which takes its id; it becomes Completed last. If a table can't be written, what was
        written of the run is taken away.
        """
        version, runs = self._at("run")
        run_id = (runs.agg(F.max("run_id")).collect()[0][0] or 0) + 1
        cols = [c.split()[0] for c in RUN.split(", ")][6:-1]
        own = lambda done, status, of: of.select(F.lit(run_id).cast("bigint").alias("run_id"), F.lit(corpus_id).cast("bigint").alias("corpus_id"), F.current_timestamp().alias("started_at"), done.cast("timestamp").alias("completed_at"), F.lit(status).alias("status"), F.lit(settings.to_json()).alias("settings_json"), *(F.col(c) for c in cols), F.lit(stored_run_id).cast("bigint").alias("stored_run_id"))
        none = self.spark.range(1).select(*(F.lit(None).alias(c) for c in cols))
        self._replace("run", version, runs.union(own(F.lit(None), "Running", none)))
        try:
            for key, name in _TABLES.items():
                if key in tables:
                    self.replace_statistics(run_id, name, tables[key])
            if books is not None:
                links = books.select(F.lit(run_id).cast("bigint"), F.col("book_id").cast("string"), F.col("order_index").cast("bigint"))
                at, rows = self._at("run_book")
                self._replace("run_book", at, rows.union(links))
            version, runs = self._at("run")
            began = runs.where(F.col("run_id") == run_id).select("started_at")
            row = own(F.current_timestamp(), "Completed", tables["summary"]).drop("started_at").crossJoin(began).select(*runs.columns)  # a row each
            self._replace("run", version, runs.where(F.col("run_id") != run_id).union(row))
        except Exception:
            self.delete_run(run_id)
            raise
        return run_id

    def replace_statistics(self, run_id: int, name: str, df: DataFrame) -> None:
        """Write a run's partition of a statistics table, in place of what it had."""
        if name not in STATISTICS:
            raise ValueError(f"no such table: {name}")
        own = df.drop("run_id").withColumn("run_id", F.lit(run_id).cast("bigint"))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{self.root}/{name}")

    def statistics(self, run_id: int, name: str) -> DataFrame:
        """A run's rows: only its partition is read. Of a run that isn't complete there are none."""
        rows = self.table(name)
        return rows.where(F.col("run_id") == run_id) if self._run(run_id) else rows.where("false")

    def _run(self, run_id: int):
        """The row of a completed run, or None."""
        return self.table("run").where((F.col("run_id") == run_id) & (F.col("status") == "Completed")).first()

    def chapters(self, run_id: int) -> DataFrame:
        """The stored chapters of a run: run, book, chapter_id, title, text and their numbers of words and sentences."""
        own = self._run(run_id)
        if own is None or own["stored_run_id"] is None:
            raise LookupError(f"no chapters are stored of run {run_id}")
        return self.store.chapters(own["stored_run_id"])

    def runs(self, corpus_id: int | None = None) -> DataFrame:
        """Runs with the names of their corpora, the latest first."""
        own = self.table("run").where("status = 'Completed'").join(self.table("corpus").select("corpus_id", F.col("name").alias("corpus_name")), "corpus_id", "left")
        if corpus_id is not None:
            own = own.where(F.col("corpus_id") == corpus_id)
        return own.orderBy(F.desc("run_id"))

    def run_books(self, run_id: int) -> DataFrame:
        """The run's books in their order, with titles and authors, and the name of its corpus: those it is linked with, else those whose
        chapters are stored."""
        links = self.table("run_book").where(F.col("run_id") == run_id)
        own = self._run(run_id)
        if own and own["stored_run_id"] is not None and links.isEmpty():
            found = self.store.chapters(own["stored_run_id"]).select(F.col("book").alias("book_id")).distinct()
            place = F.row_number().over(Window.orderBy("book_id")).cast("bigint").alias("order_index")  # a row a book
            links = found.select(F.lit(run_id).cast("bigint").alias("run_id"), "book_id", place)
        books = self.table("book").select("book_id", "title", "author", "language_code", "source_path")
        corpora = self.runs().select("run_id", "corpus_name")
        return links.join(books, "book_id").join(corpora, "run_id").orderBy("order_index")

    def languages(self, run_id: int) -> list[str]:
        """Codes of the languages of a run's books; all with a word list if there are none."""
        codes = [r[0] for r in self.run_books(run_id).select(F.lower("language_code").alias("c")).where("c <> ''").distinct().orderBy("c").limit(1000).collect()]
        return codes or sorted(STOP_WORDS)

    def delete_run(self, run_id: int) -> None:
        own = self._run(run_id)
        for name in STATISTICS:
            self.fs.delete(self._path(f"{self.root}/{name}/run_id={run_id}"), True)
        for name in ("run", "run_book"):
            version, rows = self._at(name)
            if version:
                self._replace(name, version, rows.where(F.col("run_id") != run_id))
        if own and own["stored_run_id"] is not None:
            self.store.delete_run(own["stored_run_id"])

    def delete_books(self, book_ids: list[str], remake: Callable[[DataFrame, AnalysisSettings], dict[str, DataFrame]] | None = None) -> None:
        """Delete books with their links, and runs that have no book left. A run that keeps others and has its chapters stored loses the books'
        chapters, index and word counts, which are subtracted; ``remake`` (such as plans.profile.analyse) makes its other statistics anew
        from the chapters left."""
        at, links = self._at("run_book")
        touched = links.where(F.col("book_id").isin(book_ids)).select("run_id").distinct()
        left = links.where(~F.col("book_id").isin(book_ids))
        bare = [r[0] for r in links.select("run_id").distinct().join(left.select("run_id").distinct(), "run_id", "left_anti").collect()]  # runs of these books
        kept = [r[0] for r in touched.join(left.select("run_id").distinct(), "run_id").collect()]
        if at:
            self._replace("run_book", at, left)
        version, books = self._at("book")
        self._replace("book", version, books.where(~F.col("book_id").isin(book_ids)))
        for run_id in bare:
            self.delete_run(run_id)
        for run_id in kept:
            own = self._run(run_id)
            if own and own["stored_run_id"] is not None:
                self._correct(run_id, own, book_ids, remake)

    def _correct(self, run_id: int, own, book_ids: list[str], remake) -> None:
        stored = own["stored_run_id"]
        gone = [tuple(r) for r in self.store.chapters(stored).where(F.col("book").isin(book_ids)).select("run", "book").distinct().collect()]  # some of book_ids
        if gone:
            self.store.delete_books(stored, gone)
        self.replace_statistics(run_id, "word", self.store.words(stored))
        if remake is None:
            return
        tables = remake(self.store.chapters(stored), AnalysisSettings(**json.loads(own["settings_json"])))
        for key, name in _TABLES.items():
            if key in tables and name != "word":
                self.replace_statistics(run_id, name, tables[key])
        version, runs = self._at("run")
        summary = tables["summary"].drop("run").withColumn("run_id", F.lit(run_id).cast("bigint"))
        fresh = runs.where(F.col("run_id") == run_id).drop(*[c for c in summary.columns if c != "run_id"]).join(summary, "run_id").select(*runs.columns)
        self._replace("run", version, runs.where(F.col("run_id") != run_id).union(fresh))

    def artifacts(self, paths: dict[str, str | None], folder: str | None = None) -> dict[str, tuple[str | None, str]]:
        """Path and state (Available, Missing or NotGenerated) of each of ARTIFACTS. The first RECORDED have the paths given, relative ones
        being looked for in the catalog's folder; the others are looked for in ``folder``, or beside the first of those with a path."""
        whole = {name: f"{self.root}/{p}" if p and not p.startswith("/") and ":" not in p else p for name, p in paths.items()}
        recorded = list(ARTIFACTS)[:RECORDED]
        folder = folder or next((whole[n].rsplit("/", 1)[0] for n in recorded if whole.get(n)), None)
        out = {}
        for name, file in ARTIFACTS.items():
            path = whole.get(name) if name in recorded else f"{folder}/{file}" if folder else None
            there = bool(path) and self._exists(path)
            out[name] = (path, "Available" if there else "Missing" if path and name in recorded else "NotGenerated")
        return out
