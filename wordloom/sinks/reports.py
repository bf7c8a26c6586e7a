"""CSV and Markdown reports of a run's statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.measures import short_number

COLUMNS = {
    "words": ["word", "count", "document_count", "frequency_per_million", "is_stop_word"],
    "ngrams": ["n", "text", "count", "document_count", "frequency_per_million"],
    "next_words": ["word", "next_word", "count", "probability"],
    "failures": ["path", "name", "error_message", "exception_type"],
}
ORDERS = {"words": [F.desc, "count", F.asc, "word"], "ngrams": [F.asc, "n", F.desc, "count", F.asc, "text"], "next_words": [F.desc, "count", F.asc, "word", F.asc, "next_word"], "failures": [F.asc, "name"]}


#: What tells some spreadsheets that a file is UTF-8.
BYTE_ORDER_MARK = "\ufeff"


def write_csv(df: DataFrame, kind: str, path: str, mark: bool = False) -> None:
    """One run's table as CSV with a header: numbers with four decimals at most, quotes only where needed. It is a folder of files in order, as
    many as tasks wrote; with ``mark`` each begins with a byte-order mark."""
    order = ORDERS[kind]
    keys = [f(c) for f, c in zip(order[::2], order[1::2])]
    types = dict(df.dtypes)
    shown = [short_number(F.col(c)).alias(c) if types[c] == "double" else F.col(c).cast("string").alias(c) for c in COLUMNS[kind]]
    out = df.orderBy(*keys).select(*shown)
    if mark:
        out = out.withColumnRenamed(out.columns[0], BYTE_ORDER_MARK + out.columns[0])
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_text(chapters: DataFrame, path: str) -> None:
    """Texts of the chapters, one file or more."""
    chapters.orderBy("book", "chapter_id").select("text").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def _cell(value) -> str:
    if isinstance(value, float):
        return f"{value:.4f}".rstrip("0").rstrip(".")
    return str(value).replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def _section(title: str, headers: list[str], rows: list[tuple]) -> list[str]:
    return [f"## {title}", "", "| " + " | ".join(headers) + " |", "|" + "---|" * len(headers), *("| " + " | ".join(map(_cell, r)) + " |" for r in rows), ""]


def _top(df: DataFrame, columns: list[str], n: int, *order) -> list[tuple]:
    return [tuple(r) for r in df.orderBy(*order).select(*columns).limit(n).collect()]


def markdown_report(title: str, summary: DataFrame, words: DataFrame, ngrams: DataFrame, pairs: DataFrame, categories: DataFrame) -> str:
    """Summary, top words, n-grams, next words and sentence classes of one run. Only limited tables reach the driver."""
    s = summary.collect()[0].asDict()
    names = {"document_count": "Documents", "sentence_count": "Sentences", "token_count": "Tokens", "word_token_count": "Word tokens", "distinct_word_count": "Distinct words", "average_words_per_sentence": "Average words per sentence", "average_characters_per_word": "Average characters per word"}
    cols, heads = ["word", "count", "document_count", "frequency_per_million"], ["Word", "Count", "Documents", "Per million"]
    by = (F.desc("count"), F.asc("word"))
    lines = [f"# {title}", "", *_section("Summary", ["Metric", "Value"], [(label, s[k]) for k, label in names.items()])]
    for label, own in (("Top words", words), ("Top content words", words.where(~F.col("is_stop_word"))), ("Top function words", words.where("is_stop_word"))):
        lines += _section(label, heads, _top(own, cols, 30, *by))
    lines += _section("Top n-grams", ["N", "Text", *heads[1:]], _top(ngrams, ["n", "text", *cols[1:]], 40, "n", F.desc("count"), "text"))
    lines += _section("Next words", ["Word", "Next word", "Count", "Probability"], _top(pairs, ["word", "next_word", "count", "probability"], 50, F.desc("count"), "word", "next_word"))
    lines += _section("Sentence categories", ["Category", "Count"], _top(categories, ["category", "count"], 10, F.desc("count"), "category"))
    return "\n".join(lines)


def diagnostics_report(diagnostics: DataFrame, failures: DataFrame, terms: DataFrame, suspicious: DataFrame, shortest: DataFrame, longest: DataFrame) -> str:
    """What an import has found odd, as Markdown."""
    lines = ["# Import diagnostics", ""]
    for r in diagnostics.orderBy("run").collect():  # a row a run
        lines += _section(f"Run {r['run']}", ["Metric", "Value"], [(k, v) for k, v in r.asDict().items() if k != "run"])
    lines += _section("Import failures", ["File", "Exception", "Message"], _top(failures, ["name", "exception_type", "error_message"], 1000, "name"))
    lines += _section("Suspicious terms", ["Term", "Count"], _top(terms, ["term", "count"], 100, F.desc("count"), "term"))
    lines += _section("Suspicious chapters", ["Book", "Chapter", "Characters", "Reason"], _top(suspicious, ["book", "chapter_id", "character_count", "reason"], 25, "book", "chapter_id"))
    for label, df in (("Shortest chapters", shortest), ("Longest chapters", longest)):
        lines += _section(label, ["Book", "Chapter", "Characters", "Preview"], [tuple(r) for r in df.select("book", "chapter_id", "character_count", "preview").collect()])
    return "\n".join(lines)


def save_markdown(spark, text: str, path: str) -> None:
    """Write a report to any file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
