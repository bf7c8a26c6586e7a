"""Removal of boilerplate from imported chapters, and the test for chapters that are front matter only.

Each line that isn't blank gets a code: the letters of the classes of ``LINE_CLASSES`` that it falls into. What is cut, and what counts as
front matter, is then decided on the array of codes with the thresholds below. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import trimmed

# Patterns of marker lines and of headings.
END_MARKER = r"(?im)^\s*\*{3}\s*END OF (?:THE )?PROJECT GUTENBERG EBOOK.*?\*{3}\s*$"
START_MARKER = r"(?i)\A(?s:.*?)(?m:^)\s*\*{3}\s*START OF (?:THE )?PROJECT GUTENBERG EBOOK.*?\*{3}\s*(?m:$)[\r\n]*"
CONTENTS = r"(?imd)^\s*(?:contents|table of contents|indice|sommario)\s*$"
HEADING = r"(?:chapter|book|part|capitolo|parte)\s+(?:[ivxlcdm]+|\d+)\.?|(?:[ivxlcdm]+|\d+)\s*[–—-]\s+.+"

# Phrases of the imprint and of the front matter of a library's books.
IMPRINT_STARTS = ("questo e-book", "e-book", "titolo:", "autore:", "traduttore:", "curatore:", "licenza:", "codice isbn", "edizione:", "collana:")
IMPRINT_PARTS = ("distribuito con licenza", "liber liber", "liberliber", "http://", "https://", "@")
FRONT_LINES = ("informazioni", "copertina", "colophon", "liber liber", "indice")
FRONT_STARTS = (
    "questo e-book", "e-book", "titolo:", "autore:", "traduttore:", "curatore:", "note:", "codice isbn", "diritti d'autore", "licenza:", "copertina:", "tratto da:", "soggetto:",
    "digitalizzazione:", "revisione:", "impaginazione:", "pubblicazione:", "edizione:", "collana:",
)
FRONT_PARTS = ("distribuito con licenza", "liber liber", "liberliber", "fai una donazione", "migliaia di ebook")
LIBRARY_MARKERS = (
    "questo e-book", "e-book", "ebook", "licenza", "distribuito con licenza", "liber liber", "liberliber", "http://", "https://", "www.", "informazioni", "copertina", "colophon",
    "indice di affidabilità", "migliaia di ebook", "fai una donazione",
)
#: A text is of the library if it has all phrases of one of these.
LIBRARY_SIGNS = (("liber liber",), ("questo e-book",), ("licenza", "liberliber"), ("indice di affidabilità",))

# How far into a text, in characters and in lines, things are looked for; words of a long line.
CONTENTS_WITHIN, REPEAT_WITHIN, START_WITHIN = 3_000, 15_000, 35_000
LIBRARY_WITHIN, FRONT_WITHIN, OPENING_WITHIN, FOLLOWED_WITHIN, TOP_LINES, CONTENTS_LINES = 120, 260, 80, 4, 80, 8
LONG = 12
#: Least markers, least imprint lines, least imprint and listing lines, most words (0: any number), most long lines.
FRONT_MATTER = ((2, 0, 0, 450, 2), (3, 0, 4, 0, 4), (4, 2, 0, 1200, 5))
LICENSED, LICENSED_WORDS, LICENSED_LONG, CHAPTER_LIST = ("questo e-book", "licenza"), 1200, 5, 3


def _literal(phrase: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&#~" else c for c in phrase)


def _one_of(phrases: tuple[str, ...]) -> str:
    return "(?:" + "|".join(map(_literal, phrases)) + ")"


#: Letter and pattern of each class of trimmed lower-case lines.
LINE_CLASSES = {
    "contents": ("C", r"^(?:contents|table of contents|indice|sommario)$"),
    "heading": ("H", rf"^(?:{HEADING})$"),
    "opening": ("O", r"^(?:capitolo|parte)\s+(?:[ivxlcdm]+|\d+)\.?$"),
    "numeral": ("N", r"^[ivxlcdm]+\.?$"),
    "imprint": ("I", f"^{_one_of(IMPRINT_STARTS)}|{_one_of(IMPRINT_PARTS)}"),
    "listing": ("T", r"^(?:[ivxlcdm]+|\d+)\s*[–—-]\s+.+$|^indice |\(questa pagina\)"),
    "front": ("F", f"^{_one_of(FRONT_LINES)}$|^{_one_of(FRONT_STARTS)}|{_one_of(FRONT_PARTS)}|" + r"^(?:[ivxlcdm]+|\d+)\s*[–—-]\s+.+$|^indice |\(questa pagina\)"),
    "words": ("W", r"\p{L}"),
    "long": ("L", r"(?:\p{L}+[^\p{L}]+){%d}\p{L}" % (LONG - 1)),
}


def without_markers(text: Column) -> Column:
    """What stands between the START and END marker lines; the end is cut first."""
    end = F.regexp_instr(text, F.lit(END_MARKER))
    body = F.when(end > 0, F.substring(text, F.lit(1), end - 1)).otherwise(text)
    return F.regexp_replace(body, START_MARKER, "")


def _codes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.concat(*(F.when(x.rlike(pattern), letter).otherwise("") for letter, pattern in LINE_CLASSES.values())))


def _is(code: Column, name: str) -> Column:
    return code.contains(LINE_CLASSES[name][0])


def _n(codes: Column, *names: str) -> Column:
    """How many lines are of each of the classes, added up."""
    one = lambda name: F.size(F.filter(codes, lambda c: _is(c, name)))
    return sum(map(one, names[1:]), one(names[0]))


def _from_library(lines: Column, n: int) -> Column:
    top, out = F.array_join(F.slice(lines, 1, n), "\n"), F.lit(False)
    for signs in LIBRARY_SIGNS:
        every = F.lit(True)
        for sign in signs:
            every = every & top.contains(sign)
        out = out | every
    return out


def _first(places: Column) -> Column:
    return F.try_element_at(places, F.lit(1))


def _from(pieces: Column, i: Column) -> Column:
    return F.array_join(F.slice(pieces, i, F.size(pieces)), "")


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are made once, before what uses them: an explosion of one row, into which the optimizer doesn't push filters
    on them and which it doesn't repeat wherever they are read."""
    made = df.withColumn("_made", F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))
    return made.select(*(c for c in df.columns if c not in columns), *(F.col(f"_made.{k}").alias(k) for k in columns))


def _past_contents(df: DataFrame, column: str) -> DataFrame:
    """The column from the second occurrence of the first chapter heading on, when a list of contents near the top holds the first."""
    df = _settled(df, _pieces=F.split(column, rf"(?imd)(?=^[^\S\n]*(?:{HEADING})\s*?$)"))
    name = lambda s: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(s, rf"(?id)^\s*({HEADING})\s*?(?:\n|\z)", 1), r"\s*\.*\s*\z", ""), r"\s+", " "))
    df = _settled(df, _names=F.transform("_pieces", name))
    same = F.filter(F.sequence(F.lit(1), F.size("_names")), lambda i: F.element_at("_names", i) == _first(F.filter("_names", lambda x: x != "")))
    df = _settled(df, _again=F.try_element_at(same, F.lit(2)))
    before = F.length(F.regexp_replace(F.array_join(F.slice("_pieces", 1, F.col("_again") - 1), ""), r"\n\s*\z", "\n"))
    cut = F.regexp_instr(column, F.lit(CONTENTS)).between(1, CONTENTS_WITHIN + 1) & F.col("_again").isNotNull() & (before <= REPEAT_WITHIN)
    return _settled(df, **{column: F.when(cut, _from(F.col("_pieces"), F.col("_again"))).otherwise(F.col(column))}).drop("_pieces", "_names", "_again")


def _past_front(df: DataFrame, column: str) -> DataFrame:
    """The column from the first chapter or prose line on that follows the leading front lines of the library."""
    df = _settled(df, _pieces=F.split(column, r"(?<=\n)|(?<=\r)(?!\n)"))
    rows = F.transform("_pieces", lambda p, i: F.struct((i + 1).alias("at"), F.lower(trimmed(p)).alias("line")))
    df = _settled(df, _rows=F.filter(rows, lambda r: r["line"] != ""))
    df = _settled(df, _codes=F.when(_from_library(F.col("_rows.line"), LIBRARY_WITHIN), _codes(F.col("_rows.line"))))
    front = F.transform(F.slice("_codes", 1, FRONT_WITHIN), lambda c: _is(c, "front"))
    back = F.array_position(F.reverse(front), True).cast("int")
    df = _settled(df, _last=F.when(back > 0, F.size(front) - back + 1))
    n = F.size("_codes")
    near = F.when(F.col("_last") < n, F.sequence(F.col("_last") + 1, F.least(n, F.col("_last") + OPENING_WITHIN)))
    code = lambda i: F.element_at("_codes", i)
    text_after = lambda i: F.exists(F.slice("_codes", i + 1, FOLLOWED_WITHIN), lambda c: _is(c, "words") & ~_is(c, "imprint") & ~_is(c, "listing"))
    opening = _first(F.filter(near, lambda i: _is(code(i), "opening") | (_is(code(i), "numeral") & text_after(i))))
    prose = _first(F.filter(near, lambda i: _is(code(i), "long") & ~_is(code(i), "imprint")))
    df = _settled(df, _start=F.element_at("_rows", F.coalesce(opening, prose))["at"])
    size = F.length(F.array_join(F.slice("_pieces", 1, F.col("_start") - 1), ""))
    cut = F.col("_start").isNotNull() & (size > 0) & (size <= START_WITHIN)
    return _settled(df, **{column: F.when(cut, _from(F.col("_pieces"), F.col("_start"))).otherwise(F.col(column))}).drop("_pieces", "_rows", "_codes", "_last", "_start")


def with_front_matter(df: DataFrame, column: str, name: str = "is_front_matter") -> DataFrame:
    """``df`` and whether a chapter's text has nothing but contents or library metadata. Null and blank texts have nothing else."""
    lines = F.filter(F.transform(F.split(column, r"\r\n?|\n"), lambda x: F.lower(trimmed(x))), lambda x: x != "")
    df = _settled(_settled(df, _lines=F.coalesce(lines, F.array().cast("array<string>"))), _codes=_codes(F.col("_lines")))
    top = F.array_join(F.slice("_lines", 1, LIBRARY_WITHIN), "\n")
    df = _settled(df, **{
        "_library": _from_library(F.col("_lines"), TOP_LINES), "_contents": F.exists(F.slice("_codes", 1, CONTENTS_LINES), lambda c: _is(c, "contents")),
        "_markers": sum((top.contains(m).cast("int") for m in LIBRARY_MARKERS), F.lit(0)), "_words": F.regexp_count(F.array_join("_lines", "\n"), F.lit(r"\p{L}+")),
        "_long": _n(F.col("_codes"), "long"), "_imprint": _n(F.col("_codes"), "imprint"), "_listed": _n(F.col("_codes"), "imprint", "listing"),
        "_licensed": top.contains(LICENSED[0]) & top.contains(LICENSED[1]),
    })
    only = F.col("_licensed") & (F.col("_words") <= LICENSED_WORDS) & (F.col("_long") <= LICENSED_LONG)
    for markers, imprint, listed, words, long in FRONT_MATTER:
        few = F.lit(True) if not words else F.col("_words") <= words
        only = only | ((F.col("_markers") >= markers) & (F.col("_imprint") >= imprint) & (F.col("_listed") >= listed) & few & (F.col("_long") <= long))
    listing = (F.col("_long") == 0) & (_n(F.col("_codes"), "heading") >= CHAPTER_LIST)
    found = (F.size("_lines") == 0) | (F.col("_library") & only) | ((F.col("_library") | F.col("_contents")) & listing)
    return _settled(df, **{name: found}).drop("_lines", "_codes", "_library", "_contents", "_markers", "_words", "_long", "_imprint", "_listed", "_licensed")


def with_cleaned(df: DataFrame, text: Column, name: str = "text") -> DataFrame:
    """``df`` with ``name``, a chapter's text without marker lines, contents lists and library matter, and is_front_matter. Null: empty."""
    df = _settled(df, **{name: F.coalesce(without_markers(text), F.lit(""))})
    df = _past_front(_past_contents(df, name), name)
    return with_front_matter(_settled(df, **{name: trimmed(F.col(name))}), name)
