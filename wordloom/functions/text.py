"""Column functions on texts: normalisation, sentences, tokens and sentence classes. All run inside the JVM.

Lengths and offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions import lexicon

QUOTES, STRAIGHT = "’‘‐‑–—", "''----"
#: White space of any kind.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
READING, PLAIN = "’‘“”—–", "''\"\"--"
#: Hyphens of words that reading leaves as they are.
HYPHENS = "‐‑"
#: Letters and marks, for a class of characters. Those of ASCII and Latin-1 are named one by one, as they are then told by a table.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha()) + r"\p{L}\p{M}"
WORD = rf"[{LETTERS}]++(?:['’‘\-‐‑–—][{LETTERS}]++)*+"
#: What stands before a word, and the word.
GAP_AND_WORD = rf"([^{LETTERS}]*+)({WORD})"
#: Words with nothing but white space between them.
STRETCH = rf"(?U){WORD}(?:\s++{WORD})*+"
NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
TOKEN = rf"(?U)({WORD})|({NUMBER})|\p{{P}}|\p{{S}}|\S"
CLOSERS = r"""["'”’»)\]}]"""
_ALONE, _ENDS = r"(?<![\p{L}.])", r"(?![\p{L}.])"
#: A full stop that ends no sentence: before another, between digits, or of an abbreviation.
_NO_END = (
    r"(?:\.(?=\.)|(?<=\p{Nd})\.(?=\p{Nd})"
    rf"|(?<={_ALONE}(?i:mr|mrs|ms|dr|prof|sr|jr|st|vs|etc))\.{_ENDS}"
    rf"|(?<={_ALONE}(?i:e))\.(?=(?i:g)\.{_ENDS})|(?<={_ALONE}(?i:i))\.(?=(?i:e)\.{_ENDS})|(?<={_ALONE}(?i:u))\.(?=(?i:[sk])\.{_ENDS})"
    rf"|(?<={_ALONE}(?i:e\.g|i\.e|u\.s|u\.k))\.{_ENDS})"
)
_BODY = rf"[^.?!]*+(?:{_NO_END}[^.?!]*+)*+"
#: A sentence up to its end mark and closers; after closers, a lower-case continuation ("...?" said he.) belongs to it.
SENTENCE = rf"(?sU)(?:{_BODY}[.?!](?:{CLOSERS}++(?:[\s,;]*+(?=\p{{Ll}}){_BODY}[.?!]{CLOSERS}*+)?)?|.+)"


def none() -> Column:
    """An empty array of strings."""
    return F.array().cast("array<string>")


def trimmed(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def for_reading(c: Column) -> Column:
    """Plain line breaks, quotes and dashes; runs of blanks as one space; at most one empty line; trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.translate(c, READING, PLAIN)
    c = F.regexp_replace(c, r"[\t\f\x0B ]+", " ")
    c = F.regexp_replace(c, " {2,}", " ")
    return trimmed(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def inline(c: Column) -> Column:
    """Normalised for reading, in one line."""
    return trimmed(F.regexp_replace(F.regexp_replace(for_reading(c), "\n", " "), " {2,}", " "))


def key(c: Column) -> Column:
    return F.lower(inline(c))


def word_form(c: Column) -> Column:
    """The form in which words are counted."""
    return F.lower(F.translate(c, QUOTES, STRAIGHT))


def query_form(word: str) -> str:
    """A word given by a user, as words are counted."""
    return word.strip().translate(str.maketrans(QUOTES, STRAIGHT)).lower()


def raw_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(GAP_AND_WORD), F.lit(2))


def words(c: Column) -> Column:
    """Array of the text's words, normalised."""
    return F.regexp_extract_all(word_form(c), F.lit(WORD), F.lit(0))


def gaps(c: Column) -> Column:
    """Array of what stands before each word."""
    return F.regexp_extract_all(c, F.lit(GAP_AND_WORD), F.lit(1))


def gaps_and_words(c: Column) -> Column:
    """Array of the words as they are written, each with what stands before it."""
    return F.regexp_extract_all(c, F.lit(GAP_AND_WORD), F.lit(0))


def without_gap(c: Column) -> Column:
    """The word of one of :func:`gaps_and_words`."""
    return F.regexp_replace(c, r"^[^\p{L}\p{M}]+", "")


def sentences(c: Column) -> Column:
    """Array of the sentences of a text normalised for reading; blank ones are left out."""
    found = F.transform(F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)), trimmed)
    return F.filter(found, lambda s: s != "")


def cut_text(c: Column) -> Column:
    """Array of a text's pieces, a piece for each of its :func:`sentences` normalised for reading and maybe blank ones, for counts: white space neither
    ends a sentence nor is part of a token, so only quotes and dashes are made plain."""
    return F.regexp_extract_all(F.translate(c, READING, PLAIN), F.lit(SENTENCE), F.lit(0))


def sentence_words(c: Column) -> Column:
    """Array of the words of each sentence of a text, as of its :func:`sentences` normalised for reading. Blanks and line ends neither end a sentence
    nor are part of words, so only quotes and dashes are made plain,
    those of words too, so that nothing is translated sentence by sentence."""
    plain = F.translate(c, READING + HYPHENS, PLAIN + "--")
    return F.transform(F.regexp_extract_all(plain, F.lit(SENTENCE), F.lit(0)), lambda s: F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0)))


def cut_sentences(c: Column) -> Column:
    """Array of a text's words, with a null after those of each sentence."""
    return F.flatten(F.transform(sentence_words(c), lambda ws: F.concat(ws, F.array(F.lit(None).cast("string")))))


def stretches(c: Column) -> Column:
    """Array of a text's words, with a null after each stretch of words that have nothing but white space between them."""
    return F.flatten(F.transform(F.regexp_extract_all(word_form(c), F.lit(STRETCH), F.lit(0)), lambda s: F.concat(F.split(s, r"(?U)\s+"), F.array(F.lit(None).cast("string")))))


def cut_words(own_words: Column, own_gaps: Column) -> Column:
    """Array of words, with a null before each that has more than white space before it."""
    cut = F.array(F.lit(None).cast("string"))
    return F.flatten(F.zip_with(own_words, own_gaps, lambda w, g: F.when(g.rlike(r"(?U)^\s*$"), F.array(w)).otherwise(F.concat(cut, F.array(w)))))


def tokens(c: Column) -> Column:
    """Array of a sentence's tokens: words, numbers, punctuation, symbols and others."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_kind(c: Column) -> Column:
    return (
        F.when(c.rlike(r"^[\p{L}\p{M}]"), "Word")
        .when(c.rlike(r"^\p{N}"), "Number")
        .when(c.rlike(r"^\p{P}"), "Punctuation")
        .when(c.rlike(r"^\p{S}"), "Symbol")
        .otherwise("Other")
    )


def _among(words: Column, some: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, some)))


def sentence_category(sentence: Column, own_words: Column) -> Column:
    """Question or Exclamation by its end mark or that of leading quoted speech; Greeting, Negation, Request by its words."""
    end = F.regexp_extract(trimmed(sentence), rf"(?s)([?!])(?:{CLOSERS})*$", 1)
    quoted = F.regexp_extract(sentence, r"""(?sU)^\s*["'“‘«][^?!]*+([?!][^"'”’»]*+)["'”’»]""", 1)
    mark = F.when(end != "", end).otherwise(F.regexp_extract(quoted, r"(?s)([?!])[^?!]*$", 1))
    greetings = F.array(*map(F.lit, lexicon.GREETINGS))
    greeted = F.array_contains(greetings, F.try_element_at(own_words, F.lit(1))) | F.array_contains(greetings, F.array_join(F.slice(own_words, 1, 2), " "))
    return (
        F.when(mark == "?", "Question")
        .when(mark == "!", "Exclamation")
        .when((F.size(own_words) > 0) & greeted, "Greeting")
        .when(_among(own_words, lexicon.NEGATIONS), "Negation")
        .when(_among(own_words, lexicon.REQUEST_MARKERS), "Request")
        .when(F.size(own_words) > 0, "Statement")
        .otherwise("Other")
    )


def left_snippet(c: Column) -> Column:
    """Context left of a word, on one line, without punctuation before the word."""
    return F.regexp_replace(trimmed(F.regexp_replace(c, r"(?U)\s+", " ")), r"""(?U)[\s,;:.!?…"'”’»)\]}]+$""", "")


def right_snippet(c: Column) -> Column:
    return F.regexp_replace(trimmed(F.regexp_replace(c, r"(?U)\s+", " ")), r"""(?U)^[\s,;:.!?…"'“‘«(\[{]+""", "")


def language_code(language: Column) -> Column:
    """The language of a name like "en-GB", without regular expressions."""
    return F.substring_index(F.substring_index(F.lower(F.btrim(language, F.lit(WHITE))), "-", 1), "_", 1)


def is_stop_word(word: Column, language: Column) -> Column:
    """Whether the word is a stop word of its language; unknown languages have none."""
    return is_stop_word_of(word, language_code(language))


def is_stop_word_of(word: Column, code: Column) -> Column:
    """:func:`is_stop_word` where the :func:`language_code` is a column already, as for rows exploded from a chapter."""
    out = F.lit(False)
    for lang, some in lexicon.STOP_WORDS.items():
        out = F.when(code == lang, word.isin(*some)).otherwise(out)
    return out


def grams(words: Column, low: int, high: int, gaps: Column | None = None, min_length: int = 1) -> Column:
    """Array of the runs of low to high words, as text; with gaps, only of those with nothing but white space between. A run with a
    word shorter than min_length is left out."""

    def runs(n: int) -> Column:
        size = F.size(words)

        def run(i: Column) -> Column:
            own = F.slice(words, i, n)
            ok = F.lit(True)
            if gaps is not None:
                ok = ok & F.forall(F.slice(gaps, i + 1, n - 1), lambda g: g.rlike(r"(?U)^\s*$"))
            if min_length > 1:
                ok = ok & F.forall(own, lambda w: F.length(w) >= min_length)
            return F.when(ok, F.array_join(own, " "))

        found = F.transform(F.sequence(F.lit(1), size - n + 1), run)
        return F.when(size >= n, found if gaps is None and min_length <= 1 else F.array_compact(found))

    return F.concat(*(F.coalesce(runs(n), none()) for n in range(low, high + 1)))


def n_words(gram: Column) -> Column:
    """Number of words of a run of words."""
    return F.size(F.split(gram, " ")).cast("bigint")
