"""Scalar text functions: ``Column`` to ``Column``, without Python in the plan.

Null counts as the empty string throughout; no function here returns null. White space and word characters are
Unicode's, as in Python's ``re``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabletloom.functions import fixed as X

#: White space and word characters as Java regular expressions, and the boundary between words and others.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it; a filter would compute it each time."""
    return F.transform(F.array(value), f)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def fold_space(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def any_of(literals: tuple[str, ...]) -> str:
    return "|".join(re.sub(r"([\[\]?.])", r"\\\1", x) for x in literals)


def normalize_gaps(c: Column) -> Column:
    """Gaps of several signs, then of one."""
    return F.regexp_replace(F.regexp_replace(c, any_of(X.BIG_GAPS), X.BIG_GAP), any_of(X.SINGLE_GAPS), X.SINGLE_GAP)


def normalize(c: Column | str) -> Column:
    """Erasures out, gaps to tokens, editorial signs out, white space folded."""
    bare = F.regexp_replace(text(c), f"(?d){X.ERASURE}", "")
    return fold_space(F.regexp_replace(normalize_gaps(bare), f"[{X.DELETED}]", ""))


def dedup_key(c: Column | str) -> Column:
    """Lower case without white space and ``!?.``."""
    return F.regexp_replace(F.lower(text(c)), rf"{SPACE}|[!?.]", "")


def match_key(c: Column | str) -> Column:
    """Lower case with plain vowels and consonants and without hyphens."""
    return F.translate(F.replace(F.lower(text(c)), F.lit("š"), F.lit("sh")), X.KEY_FROM + "-", X.KEY_TO)


def trigrams(key: Column) -> Column:
    """The distinct three-character sequences of a key."""
    return F.array_distinct(F.regexp_extract_all(key, F.lit("(?s)(?=(...))"), F.lit(1)))


def tokens(c: Column) -> Column:
    """Words at white space, lower case, without punctuation at the ends; words of punctuation alone stay, empty."""
    words = F.filter(F.split(F.lower(strip(c)), f"{SPACE}+"), lambda w: w != "")
    return F.transform(words, lambda w: F.regexp_replace(w, r"""^[.,!?;:'"()\[\]]+|[.,!?;:'"()\[\]]+$""", ""))


def source_sentences(c: Column | str) -> Column:
    """Lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text(c), "\n"), strip), lambda x: x != "")


def target_sentences(c: Column | str) -> Column:
    """Pieces between line feeds and full stops, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text(c), r"[\n.]"), strip), lambda x: x != "")


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def prefix(c: Column, n: int | Column) -> Column:
    """``c[:n]`` with Python's meaning of a negative n."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(c, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.length(c) + n, F.lit(0))))


def dictionary_base(c: Column) -> Column:
    """A dictionary word without its homonym numeral."""
    return strip(F.regexp_replace(c, rf" +({'|'.join(X.NUMERALS)})$", ""))


def clean_definition(c: Column) -> Column:
    return strip(F.regexp_replace(text(c), r'^"+|"+$', ""))


def undotted(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit(""))


def with_task_prefix(c: Column) -> Column:
    return F.concat(F.lit(X.TASK_PREFIX), text(c))
