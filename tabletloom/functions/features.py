"""Names, Sumerograms and determinatives of transliterations: array-valued functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabletloom.functions import fixed as X
from tabletloom.functions.text import EDGE, is_upper, text

NAME = f"{EDGE}[{X.UPPER}][{X.LOWER}{X.UPPER}{X.INDEX}-]*{EDGE}"
SUMEROGRAM = rf"{EDGE}[{X.UPPER}]{{2,}}[₀-₉]*(?:\.[{X.UPPER}]+[₀-₉]*)*{EDGE}"


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def proper_nouns(c: Column | str) -> Column:
    """Capitalised words that are not all capitals, in text order, repeats kept."""
    return F.filter(all_matches(text(c), NAME), lambda x: ~is_upper(x))


def sumerograms(c: Column | str, min_length: int = 2) -> Column:
    """Words of capitals, once determinatives are deleted."""
    bare = F.regexp_replace(text(c), X.DETERMINATIVE, "")
    return F.filter(all_matches(bare, SUMEROGRAM), lambda x: F.length(x) >= min_length)


def determinatives(c: Column | str) -> Column:
    return F.transform(all_matches(text(c), X.DETERMINATIVE), lambda x: F.regexp_replace(x, "^[{}]+|[{}]+$", ""))


def all_features(c: Column | str) -> Column:
    return F.struct(proper_nouns(c).alias("proper_nouns"), sumerograms(c).alias("sumerograms"), determinatives(c).alias("determinatives"))
