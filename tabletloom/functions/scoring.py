"""How far a text reads as Akkadian, as English, or as German, Turkish or French."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabletloom.functions import fixed as X
from tabletloom.functions.text import EDGE, SPACE, bound, strip, text

#: What is no white space, and the punctuation that words are stripped of.
SOLID = SPACE.replace("[", "[^", 1)
PUNCTUATION = r"""[.,!?;:'"()\[\]]"""


def akkadian_score(c: Column | str) -> Column:
    """5 x share of diacritics + 2 x Sumerograms (of 3) + gaps (of 2) + 2 x keywords (of 3); 0 below 5 characters."""

    def score(t: Column, low: Column) -> Column:
        marks = F.length(F.regexp_replace(t, f"[^{X.DIACRITICS}]", "")) / F.greatest(F.length(t), F.lit(1))
        signs = F.regexp_count(t, F.lit(f"{EDGE}{X.SCORE_SUMEROGRAM}{EDGE}"))
        gaps = F.regexp_count(t, F.lit(X.SCORE_GAP))
        words = reduce(lambda a, b: a + b, (F.contains(low, F.lit(k)).cast("int") for k in X.KEYWORDS))
        total = marks * 5.0 + F.least(signs / 3.0, F.lit(1.0)) * 2.0 + F.least(gaps / 2.0, F.lit(1.0)) + F.least(words / 3.0, F.lit(1.0)) * 2.0
        return F.when(F.length(strip(t)) < 5, 0.0).otherwise(total)

    return bound(text(c), lambda t: bound(F.lower(t), lambda low: score(t, low)))


def _trie(words: list[str]) -> str:
    """The words as alternatives, those of one first letter together."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(rest, reverse=True))})" for c, rest in sorted(by.items()))


def _count(low: Column, words: list[str]) -> Column:
    """How many words of a text in small letters are among the given ones, punctuation at their ends aside."""
    return F.regexp_count(low, F.lit(f"(?<!{SOLID}){PUNCTUATION}*(?:{_trie(words)}){PUNCTUATION}*(?!{SOLID})"))


def english_score(c: Column | str) -> Column:
    """3 x share of function words + 2 x share of trade words, at most 2; 0 below 10 characters."""

    def score(t: Column, low: Column) -> Column:
        total = F.least((_count(low, X.ENGLISH) * 3.0 + _count(low, X.TRADE) * 2.0) / F.greatest(F.regexp_count(low, F.lit(f"{SOLID}+")), F.lit(1)), F.lit(2.0))
        return F.when(F.length(strip(t)) < 10, 0.0).otherwise(total)

    return bound(text(c), lambda t: bound(F.lower(t), lambda low: score(t, low)))


def non_english_score(c: Column | str) -> Column:
    """The greatest of 15, 20 and 12 x the share of German, Turkish and French function words; 0 below 10 characters."""

    def score(t: Column, low: Column) -> Column:
        most = F.greatest(_count(low, X.GERMAN) * 15.0, _count(low, X.TURKISH) * 20.0, _count(low, X.FRENCH) * 12.0)
        return F.when(F.length(strip(t)) < 10, 0.0).otherwise(most / F.greatest(F.regexp_count(low, F.lit(f"{SOLID}+")), F.lit(1)))

    return bound(text(c), lambda t: bound(F.lower(t), lambda low: score(t, low)))


__all__ = ["SPACE", "akkadian_score", "english_score", "non_english_score"]
