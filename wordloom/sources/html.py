"""Visible text of HTML pages, in built-in expressions.

A page is cut by regular expressions from left to right: first comments and elements that aren't shown are taken away as wholes, so that what looks
like a tag inside them is none; then all up to the first <body>; then tags of blocks become line breaks and other tags nothing. Character references
are looked up last, so what they stand for is never taken for a tag or a break.
"""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import trimmed

# Elements that begin and end a line, and those whose text isn't shown.
BLOCKS = tuple(
    "address article aside blockquote body dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
HIDDEN = ("script", "style", "noscript")

#: What may follow a tag's name: values in quotes may hold a ">". Where quotes don't match, the tag ends at the first one, or with the page.
_REST = r"""(?:(?:[^>"']|"[^"]*"|'[^']*')*>|[^>]*(?:>|\z))"""
_NAME_ENDS = r"(?:[\s/]|(?=>)|\z)"
COMMENT = r"<!--.*?(?:-->|\z)"
UNSEEN = "(?is)" + "|".join([COMMENT, *(rf"<{x}{_NAME_ENDS}[^>]*>?.*?(?:</{x}\s*>|\z)" for x in HIDDEN)])
BODY = rf"(?is)\A.*?<body{_NAME_ENDS}{_REST}"
BREAK = rf"(?is)</?(?:br|{'|'.join(BLOCKS)}){_NAME_ENDS}{_REST}"
TAG = rf"(?is)<[a-z/!?]{_REST}"
#: A character reference, or what stands between two.
REFERENCE = r"(?s)&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)|[^&]+|&"


def _character(code: Column) -> Column:
    """The character of a code point; the replacement character where there is none."""
    sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")


def unescaped(text: Column) -> Column:
    """Text with what its character references stand for; names that need no semicolon may be the beginning of a longer word."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    # What browsers take the control characters from 128 on for.
    controls = F.from_json(F.lit(json.dumps({str(k): html.unescape(f"&#{k};") for k in range(128, 160)})), "map<string,string>")
    bare = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))

    def plain(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#([0-9]+)", 1)
        hexes = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+)", 1)
        code = F.when(digits != "", digits).when(hexes != "", F.conv(hexes, 16, 10)).try_cast("bigint")
        start = F.regexp_extract(piece, f"^&({bare})", 1)
        named = F.when(start != "", F.concat(F.try_element_at(names, start), F.substring(piece, F.length(start) + 2, F.length(piece)))).otherwise(piece)
        numbered = F.coalesce(F.try_element_at(controls, code.cast("string")), _character(code))
        own = F.coalesce(F.try_element_at(names, F.substring(piece, F.lit(2), F.length(piece))), named)
        return F.when(~piece.startswith("&"), piece).when((digits != "") | (hexes != ""), F.coalesce(numbered, F.lit("�"))).otherwise(own)

    return F.when(text.contains("&"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), plain), "")).otherwise(text)


def one_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def visible_text(source: Column) -> Column:
    """Lines of visible text; empty for null or blank pages."""
    seen = F.regexp_replace(F.regexp_replace(F.coalesce(source, F.lit("")), UNSEEN, ""), BODY, "")
    broken = F.regexp_replace(F.regexp_replace(one_blank(seen), BREAK, "\n"), TAG, "")
    lines = F.transform(F.split(broken, "\n"), lambda x: trimmed(one_blank(unescaped(x))))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text of pages."""
    return pages.select("page_id", "url", visible_text(F.col("html")).alias("text"))
