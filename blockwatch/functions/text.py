"""Text helpers: tokens, the hashed token vector (F7 default encoder), keyword scores (K1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIM = 32  # one dimension per hex digit of md5
WHITESPACE = r"[ \t\n\r\f]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Whitespace tokens of the lower-cased text, empty strings removed. Whole text, no cap."""
    return F.array_remove(F.split(F.lower(_c(text)), WHITESPACE), "")


def hashed_sum(tok: Column) -> Column:
    """Sum of token vectors; token vector dim j = (hex digit j of md5(token) - 7.5) / 7.5."""
    hexes = F.transform(tok, lambda t: F.md5(t))
    zero = F.array_repeat(F.lit(0.0), HASH_DIM)

    def digits(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(HASH_DIM)),
                           lambda j: (F.conv(F.substring(h, j, F.lit(1)), 16, 10).cast("double")
                                      - 7.5) / 7.5)

    return F.aggregate(hexes, zero, lambda acc, h: F.zip_with(acc, digits(h), lambda a, b: a + b))


def hashed_vector(text: Column | str) -> Column:
    """Mean token vector of a whole text; zero vector for an empty text."""
    tok = tokens(text)
    n = F.size(tok)
    return F.transform(hashed_sum(tok), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


# The surveyed keyword lists.
NEGATIVE_WORDS = ("panic", "interrupt", "error")
GOOD_WORDS = ("corrected", "detected")


def keyword_score(content: Column | str, negative=NEGATIVE_WORDS, good=GOOD_WORDS,
                  sep: str = "|") -> Column:
    """K1: per segment, +1 for each negative word contained, -1 for each good word.

    Case-sensitive substring containment, as in the surveyed code.
    """
    segs = F.split(_c(content), "[" + sep + "]", -1)

    def seg_score(s: Column) -> Column:
        total = F.lit(0)
        for w in negative:
            total = total + F.when(F.contains(s, F.lit(w)), 1).otherwise(0)
        for w in good:
            total = total - F.when(F.contains(s, F.lit(w)), 1).otherwise(0)
        return total

    return F.aggregate(segs, F.lit(0), lambda acc, s: acc + seg_score(s))
