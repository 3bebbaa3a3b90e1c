"""Cleaning of scanned pages: leading headers and white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabletloom.functions import fixed as X
from tabletloom.functions.text import SPACE, strip, text


def is_header_line(line: Column) -> Column:
    """Blank, a page number (maybe with a journal's title), or short capitals without marks of transliteration."""
    s = strip(line)
    number = s.rlike("(?U)" + X.PAGE_NUMBER)
    capitals = (s == F.upper(s)) & (F.length(s) < 80) & ~s.rlike(f"[{X.HEADER_MARKS}]") & s.rlike(r"\p{L}")
    return (s == "") | number | capitals


def strip_headers(c: Column) -> Column:
    """Without the leading lines that are headers; what follows the first other line stays."""
    lines = F.split(c, "\n")
    first = F.array_position(F.transform(lines, lambda x: ~is_header_line(x)), True)
    return F.when(first == 0, "").otherwise(F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)), "\n"))


def fold_blanks(c: Column) -> Column:
    """Blanks and tabs to one blank, none before a line feed; line feeds stay."""
    return F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), " +\n", "\n")


def correct(c: Column | str) -> Column:
    return strip(fold_blanks(strip_headers(text(c))))


__all__ = ["SPACE", "correct", "fold_blanks", "is_header_line", "strip_headers"]
