"""Column formulas of the statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def per_million(count: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(count * F.lit(1000000.0) / total)


def ratio_of(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def dice(together: Column, target: Column, collocate: Column) -> Column:
    """Dice coefficient; overlapping windows count an occurrence more than once, so the count is bounded."""
    return F.when(target + collocate == 0, F.lit(0.0)).otherwise(F.lit(2.0) * F.least(together, target, collocate) / (target + collocate))


def difficulty_score(words_per_sentence: Column, chars_per_word: Column, long_share: Column, very_long_share: Column, content_share: Column, diversity: Column) -> Column:
    return words_per_sentence * 2.0 + chars_per_word * 8.0 + long_share * 100.0 * 0.6 + very_long_share * 100.0 * 0.8 + content_share * 100.0 * 0.2 + diversity * 0.08


def comparison(left: Column, right: Column) -> dict[str, Column]:
    """Measures of two frequencies per million."""
    diff = left - right
    return {
        "difference_per_million": diff,
        "absolute_difference_per_million": F.abs(diff),
        "ratio": F.when(right == 0, F.when(left == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(left, right)),
        "direction": F.when(F.abs(diff) < 0.000001, "tie").when(diff > 0, "left").otherwise("right"),
    }


def short_number(c: Column) -> Column:
    """At most four decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def shown(c: Column, digits: int = 2, signed: bool = False) -> Column:
    """A number as reports show it: so many decimals at most, without trailing zeros, on demand with its sign."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", c.cast("double")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.when(plain == "-0", "0").otherwise(plain)
    return F.when((plain != "0") & (c > 0), F.concat(F.lit("+"), plain)).otherwise(plain) if signed else plain


def shown_ratio(c: Column) -> Column:
    """A ratio: inf, n/a, <0.01, or two decimals at most."""
    return F.when(F.isnan(c), "n/a").when(c == float("inf"), "inf").when((c > 0) & (c < 0.01), "<0.01").otherwise(shown(c))


def shown_share(c: Column) -> Column:
    """A probability as a percentage with two decimals."""
    return F.format_string("%.2f%%", c * 100.0)


def shown_size(c: Column) -> Column:
    """Bytes in the largest binary unit that leaves one or more, GiB at most; null: n/a."""
    units = ("B", "KiB", "MiB", "GiB")
    out = F.concat_ws(" ", shown(c / float(1024 ** (len(units) - 1))), F.lit(units[-1]))
    for k in range(len(units) - 2, -1, -1):
        out = F.when(c < 1024 ** (k + 1), F.concat_ws(" ", shown(c / float(1024**k)), F.lit(units[k]))).otherwise(out)
    return F.when(c.isNull(), "n/a").otherwise(out)


def shortened(c: Column, most: int) -> Column:
    """Text of at most so many characters, the last an ellipsis if some were cut off."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))
