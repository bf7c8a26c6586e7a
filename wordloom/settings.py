"""Knobs of an analysis and the limits that queries clamp their arguments to."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class AnalysisSettings:
    """How statistics are made. ``lowercase_words`` is kept for its place in the settings' JSON; words are always lower-cased."""

    min_word_length: int = 1
    lowercase_words: bool = True
    include_punctuation_tokens: bool = False
    ngram_min_n: int = 2
    ngram_max_n: int = 5
    min_ngram_count: int = 2
    top_words_for_next_word_analysis: int = 1000
    min_next_word_pair_count: int = 2

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


#: Most rows of a ranked result, and of one that an explorer shows.
MOST_ROWS, MOST_SHOWN = 1000, 100
#: Least and most words of a window, of a context and of a phrase.
WINDOW, CONTEXT, PHRASE = (1, 10), (1, 30), (2, 8)


def bounded(what: str, value: int, low: int, high: int, compat: bool = False) -> int:
    """A value from low to high. Others are an error, lest less be counted or shown than was asked for; with compat they become the nearest."""
    if not compat and not low <= value <= high:
        raise ValueError(f"{what}: {value} isn't from {low} to {high}")
    return clamp(value, low, high)


def limit_of(n: int, most: int = MOST_ROWS, compat: bool = False) -> int:
    """The number of rows of a ranked result."""
    return bounded("rows of a ranked result", n, 1, most, compat)


def window_of(n: int, compat: bool = False) -> int:
    """How many words a collocation window reaches to each side."""
    return bounded("words of a window", n, *WINDOW, compat)


def context_of(n: int, compat: bool = False) -> int:
    """How many words a concordance line shows on each side."""
    return bounded("words of a context", n, *CONTEXT, compat)


def phrase_lengths(low: int, high: int, compat: bool = False) -> tuple[int, int]:
    """Least and most words of a phrase; with compat, the most is the least if it was smaller."""
    low, high = bounded("words of a phrase", low, *PHRASE, compat), bounded("words of a phrase", high, *PHRASE, compat)
    if high < low and not compat:
        raise ValueError(f"words of a phrase: from {low} to {high}")
    return low, max(low, high)
