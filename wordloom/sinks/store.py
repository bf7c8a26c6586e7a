"""Saved runs: chapters, an inverted index and statistics that queries read instead of the texts.

A run is one or more parts, each written once and never changed. A part has these tables:

* chapter: texts, with the numbers of words and sentences that the analyser counts;
* token: the forward index, the arrays of a chapter's words, of what stands before them, and of the words as they are written;
* posting: the inverted index, a row for each word of each chapter with its positions;
* book_word and word: counts of words by book, and by run.

chapter and token are bucketed by the chapter's key, so they are joined, and postings are made, without a shuffle, and a book that holds much of
the corpus is dealt over all buckets. posting and book_word are sorted over ranges of their keys, of which a table of the files' least
and greatest keys is kept: a reader of one word opens the files that can have it, and in these Parquet's statistics and Bloom filters pass
over the rest. Positions are stored as differences by Parquet's own encoding.

All tables of all runs are named by one manifest (see :mod:`wordloom.sinks.manifest`). A run's number is taken by a version that calls it
Running; what is written is seen from the version on that calls it Completed. Of a writer that is killed nothing is seen, and
:meth:`RunStore.recover` takes its folder away. Deleting a book names it in the manifest; its rows are passed over, and the sums of its counts
are subtracted, so only its own files are read. A change is seen whole or not at all, as it is one version.
"""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.functions.measures import per_million
from wordloom.operators.index import chapter_sizes, positions_of
from wordloom.operators.inverted import inverted
from wordloom.operators.stats import word_frequencies
from wordloom.sinks.manifest import Manifest

KEYS = ["run", "book", "chapter_id"]
SCHEMAS = {
    "chapter": "run string, book string, chapter_id bigint, title string, text string, word_count bigint, sentence_count bigint",
    "token": "run string, book string, chapter_id bigint, words array<string>, gaps array<string>, raws array<string>",
    "posting": "run string, book string, chapter_id bigint, word string, n bigint, positions array<int>",
    "book_word": "run string, book string, word string, count bigint, document_count bigint",
    "word": "run string, word string, count bigint, document_count bigint",
    "position": "run string, book string, chapter_id bigint, tokens bigint, first_run_position bigint, last_run_position bigint",
}
#: Bytes of text for each bucket, and most buckets.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 20_000
#: Bytes of text for each file of a sorted table.
FILE_BYTES = 16 << 20


class RunStore:
    """Runs under a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest(spark, f"{self.root}/manifest")

    # Writing

    def save(self, chapters: DataFrame, name: str = "", index: bool = True) -> int:
        """Store chapters (run, book, chapter_id, text, maybe title) and their index as a new run; its number. Without ``index`` queries look at the
        chapters' texts, until :meth:`replace_index` has made one."""
        run_id = self._begin(name)
        try:
            part = self._write_part(run_id, chapters, index)
            self._complete(run_id, parts=[part], positions=self._write_positions(run_id, [part], []))
        except Exception:
            self.delete_run(run_id)
            raise
        return run_id

    def append(self, run_id: int, chapters: DataFrame) -> None:
        """Add chapters of further books, or further chapters, to a run; only these are read. A key that the run has already is an error."""
        old = self._run(run_id)
        part = self._write_part(run_id, chapters, self.indexed(run_id))
        keys = self._bucketed(part, "chapter").select(*KEYS)
        if not keys.join(self.chapters(run_id).select(*KEYS), KEYS, "left_semi").isEmpty():
            self._delete(part["folder"])
            raise ValueError(f"run {run_id} has some of these chapters")
        parts = [*old["parts"], part]
        self._complete(run_id, old, parts=parts, positions=self._write_positions(run_id, parts, old["removed"]))

    def delete_books(self, run_id: int, books: list[tuple[str, str]]) -> None:
        """Take books (run, book) out of a run. No stored row is rewritten but the chapters' run positions."""
        old = self._run(run_id)
        removed = sorted({*map(tuple, old["removed"]), *books})
        self._complete(run_id, old, removed=removed, positions=self._write_positions(run_id, old["parts"], removed))

    def compact(self, run_id: int) -> None:
        """Write a run of several parts, or with removed books, as one part."""
        old = self._run(run_id)
        part = self._write_part(run_id, self.chapters(run_id).select(*KEYS, "title", "text"), self.indexed(run_id))
        self._complete(run_id, old, parts=[part], removed=[], positions=self._write_positions(run_id, [part], []))

    def replace_index(self, run_id: int, postings: DataFrame | None = None) -> None:
        """Make a run's index again from its stored chapters, or from ``postings`` (of its schema), in one version."""
        old = self._run(run_id)
        parts = []
        for k, part in enumerate(old["parts"]):
            own = {**part, "index": f"index-{uuid.uuid4().hex}", "token": part.get("token", part["index"])}
            if postings is None:
                del own["token"]
                self._write_tokens(own)
                self._write_index(own, self._postings_of(own))
            else:  # the forward index stays
                self._write_index(own, postings if k == 0 else postings.where("false"))
            parts.append(own)
        self._complete(run_id, old, parts=parts, positions=self._write_positions(run_id, parts, old["removed"]))

    def delete_run(self, run_id: int) -> None:
        self.manifest.update(lambda s: {**s, "runs": {k: r for k, r in s.get("runs", {}).items() if k != str(run_id)}})
        self._delete(f"{self.root}/run-{run_id}")

    def recover(self, older_than: float = 24 * 3600.0) -> list[int]:
        """Take away what is left of runs that were begun so many seconds ago and never completed; their numbers."""
        dead = [int(k) for k, r in self.manifest.read().get("runs", {}).items() if r["status"] == "Running" and r["started"] <= time.time() - older_than]
        for run_id in dead:
            self.delete_run(run_id)
        return dead

    def _begin(self, name: str) -> int:
        def change(state: dict) -> dict:
            n = state.get("last", 0) + 1
            return {"last": n, "runs": {**state.get("runs", {}), str(n): {"name": name, "status": "Running", "started": time.time()}}}

        # The name that tells our entry from another writer's is the version's: update() repeats until ours is committed.
        return self.manifest.update(change)["last"]

    def _complete(self, run_id: int, seen: dict | None = None, **changes) -> None:
        """Commit a run's new tables; ``seen`` is its entry that they were made from, lest another writer's change be lost."""

        def change(state: dict) -> dict:
            now = state["runs"].get(str(run_id))
            if now is None or (seen is not None and now != seen):
                raise RuntimeError(f"run {run_id} has been changed by another writer")
            own = {"removed": [], **now, **changes, "status": "Completed", "completed": time.time()}
            return {**state, "runs": {**state["runs"], str(run_id): own}}

        self.manifest.update(change)

    def _run(self, run_id: int) -> dict:
        own = self.manifest.read().get("runs", {}).get(str(run_id))
        if not own or own["status"] != "Completed":
            raise LookupError(f"no such run: {run_id}")
        return own

    def _delete(self, folder: str) -> None:
        self.manifest.fs.delete(self.manifest.path(folder), True)

    # Parts

    def _write_part(self, run_id: int, chapters: DataFrame, index: bool = True) -> dict:
        size = _bytes_of(chapters)
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        part = {
            "folder": f"{self.root}/run-{run_id}/part-{uuid.uuid4().hex}", "index": f"index-{uuid.uuid4().hex}" if index else None,
            "buckets": max(width, min(MOST_BUCKETS, -(-size // BUCKET_BYTES))), "files": max(width, min(MOST_BUCKETS, -(-size // FILE_BYTES))),
        }
        title = F.col("title").cast("string") if "title" in chapters.columns else F.lit(None).cast("string")
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        own = chapters.select(F.col("run").cast("string").alias("run"), F.col("book").cast("string").alias("book"), F.col("chapter_id").cast("bigint").alias("chapter_id"), title.alias("title"), text.alias("text"))
        sized = chapter_sizes(own.repartition(part["buckets"], *KEYS)).withColumnsRenamed({"expected": "word_count", "sentences": "sentence_count"})
        self._write_bucketed(sized.na.fill(0, ["word_count", "sentence_count"]), part, "chapter")
        if index:
            self._write_tokens(part)
            self._write_index(part, self._postings_of(part))
        return part

    def _write_bucketed(self, rows: DataFrame, part: dict, name: str) -> None:
        """Rows that are dealt by KEYS already: a file a bucket."""
        path = self._path(part, name)
        rows.write.bucketBy(part["buckets"], *KEYS).sortBy(*KEYS).option("path", path).option("compression", "zstd").saveAsTable(_table(path))

    def _write_tokens(self, part: dict) -> None:
        own = self._bucketed(part, "chapter", keep=True)
        index = own.select(*KEYS, X.words(F.col("text")).alias("words"), X.gaps(F.col("text")).alias("gaps"), X.raw_words(F.col("text")).alias("raws"))
        self._write_bucketed(index, part, "token")

    def _postings_of(self, part: dict) -> DataFrame:
        """The inverted rows of the forward index. Its rows hold whole chapters, so words are grouped where they are."""
        return inverted(self._bucketed(part, "token"))

    def _write_index(self, part: dict, postings: DataFrame) -> None:
        columns = [c.split()[0] for c in SCHEMAS["posting"].split(", ")]
        options = {"parquet.bloom.filter.enabled#word": "true", "parquet.writer.version": "v2", "parquet.enable.dictionary#positions.list.element": "false"}
        self._write_sorted(postings.select(*columns), part, "posting", ["word", *KEYS], options)
        counts = self.spark.read.schema(SCHEMAS["posting"]).parquet(self._path(part, "posting"))
        by_book = counts.groupBy("run", "book", "word").agg(F.sum("n").alias("count"), F.count("*").alias("document_count"))
        self._write_sorted(by_book, part, "book_word", ["book", "run", "word"], {})
        by_run = self.spark.read.schema(SCHEMAS["book_word"]).parquet(self._path(part, "book_word")).groupBy("run", "word").agg(F.sum("count").alias("count"), F.sum("document_count").alias("document_count"))
        by_run.write.option("compression", "zstd").parquet(self._path(part, "word"))

    def _write_sorted(self, rows: DataFrame, part: dict, name: str, keys: list[str], options: dict[str, str]) -> None:
        """Rows in ranges of keys, and the table of the files' first and last keys."""
        path = self._path(part, name)
        rows.repartitionByRange(part["files"], *keys).sortWithinPartitions(*keys).write.options(**options).option("compression", "zstd").parquet(path)
        written = self.spark.read.schema(SCHEMAS[name]).parquet(path).select(F.col("_metadata.file_path").alias("path"), F.col(keys[0]).alias("k"))
        written.groupBy("path").agg(F.min("k").alias("low"), F.max("k").alias("high")).coalesce(1).write.parquet(f"{path}-files")  # a row a file

    def _write_positions(self, run_id: int, parts: list[dict], removed: list) -> str:
        """Run positions of the chapters' tokens, as the index has them; nothing but numbers of tokens is read."""
        path = f"{self.root}/run-{run_id}/positions-{uuid.uuid4().hex}"
        sizes = self._kept(self._all(parts, "posting"), removed).groupBy(*KEYS).agg(F.sum("n").alias("tokens"))
        positions_of(sizes).write.option("compression", "zstd").parquet(path)
        return path

    # Reading

    def _path(self, part: dict, name: str) -> str:
        if name == "chapter":
            return f"{part['folder']}/chapter"
        index = part.get("token", part["index"]) if name == "token" else part["index"]
        return f"{part['folder']}/{index}/{name}"

    def _bucketed(self, part: dict, name: str, keep: bool = False) -> DataFrame:
        """A bucketed table, made known to the session's catalog if need be. With ``keep`` tasks read whole buckets even where no join asks for it."""
        session = self.spark
        if keep:
            session = self.spark.newSession()
            session.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        path, keys = self._path(part, name), ", ".join(KEYS)
        session.sql(f"create table if not exists {_table(path)} ({SCHEMAS[name]}) using parquet clustered by ({keys}) sorted by ({keys}) into {part['buckets']} buckets location '{path}'")
        return session.table(_table(path))

    def _kept(self, rows: DataFrame, removed: list) -> DataFrame:
        """Rows of books that haven't been removed."""
        return rows.where(~_among(removed)) if removed else rows

    def _all(self, parts: list[dict], name: str) -> DataFrame:
        """The rows of a table of the index, of the parts that have one."""
        paths = [self._path(p, name) for p in parts if p["index"]]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def _holding(self, parts: list[dict], name: str, keys: list[str]) -> DataFrame:
        """Rows from the files of a sorted table in whose range one of ``keys`` is."""
        paths = [f"{self._path(p, name)}-files" for p in parts if p["index"]]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        files = self.spark.read.schema("path string, low string, high string").parquet(*paths)
        own = files.where(reduce(Column.__or__, [(F.col("low") <= k) & (F.col("high") >= k) for k in keys])).select("path").collect()  # files that are read
        if not own:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[r["path"] for r in own])

    def runs(self) -> list[dict]:
        """Completed runs with their numbers, the latest first."""
        found = self.manifest.read().get("runs", {})
        return [{"run_id": int(k), **r} for k, r in sorted(found.items(), key=lambda x: -int(x[0])) if r["status"] == "Completed"]

    def chapters(self, run_id: int) -> DataFrame:
        own = self._run(run_id)
        return self._kept(_union([self._bucketed(p, "chapter") for p in own["parts"]]), own["removed"])

    def indexed(self, run_id: int) -> bool:
        """Whether the run has an index of all its parts."""
        return all(p["index"] for p in self._run(run_id)["parts"])

    def tokens(self, run_id: int) -> DataFrame:
        own = self._run(run_id)
        parts = [self._bucketed(p, "token") for p in own["parts"] if p["index"]]
        return self._kept(_union(parts) if parts else self.spark.createDataFrame([], SCHEMAS["token"]), own["removed"])

    def indexed_chapters(self, run_id: int) -> DataFrame:
        """Chapters with their tokens, joined bucket by bucket."""
        own = self._run(run_id)
        return self._kept(_union([self._bucketed(p, "chapter").join(self._bucketed(p, "token"), KEYS) for p in own["parts"]]), own["removed"])

    def postings(self, run_id: int, word: str | None = None) -> DataFrame:
        """The inverted index, or the rows of one word (in the form it is counted in), for which few files are opened."""
        own = self._run(run_id)
        rows = self._all(own["parts"], "posting") if word is None else self._holding(own["parts"], "posting", [word]).where(F.col("word") == word)
        return self._kept(rows, own["removed"])

    def positions(self, run_id: int) -> DataFrame:
        return self.spark.read.schema(SCHEMAS["position"]).parquet(self._run(run_id)["positions"])

    def book_words(self, run_id: int, books: list[tuple[str, str]] | None = None) -> DataFrame:
        """Counts of words by book: of all, or of some books, for which few files are opened."""
        own = self._run(run_id)
        if books is None:
            return self._kept(self._all(own["parts"], "book_word"), own["removed"])
        return self._kept(self._holding(own["parts"], "book_word", sorted({b for _, b in books})).where(_among(books)), own["removed"])

    def words(self, run_id: int) -> DataFrame:
        """Word frequencies of a run: the parts' sums, less the counts of removed books. Without an index they are counted in the texts."""
        own = self._run(run_id)
        if not self.indexed(run_id):
            return word_frequencies(self.chapters(run_id))
        sums = self._all(own["parts"], "word")
        if own["removed"]:
            gone = self._holding(own["parts"], "book_word", sorted({b for _, b in own["removed"]})).where(_among(own["removed"]))
            sums = sums.union(gone.select("run", "word", -F.col("count"), -F.col("document_count")))
        words = sums.groupBy("run", "word").agg(F.sum("count").alias("count"), F.sum("document_count").alias("document_count")).where("count > 0")
        totals = self.positions(run_id).groupBy("run").agg(F.sum("tokens").alias("total"))
        return words.join(totals, "run").select("run", "word", "count", "document_count", per_million(F.col("count"), F.col("total")).alias("frequency_per_million"), X.is_stop_word(F.col("word"), F.col("run")).alias("is_stop_word"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir. Where that is unset, in a temporary one in local mode, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wordloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/wordloom/{name}-{uuid.uuid4().hex}"


def _table(path: str) -> str:
    """The name by which a folder is known to the session's catalog."""
    return f"wordloom_{hashlib.sha256(path.encode()).hexdigest()[:32]}"


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def _among(books: list) -> Column:
    return reduce(Column.__or__, [F.col("run").eqNullSafe(run) & F.col("book").eqNullSafe(book) for run, book in books], F.lit(False))


def _bytes_of(rows: DataFrame) -> int:
    """Size of the files that ``rows`` come from, as the planner knows it."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)
