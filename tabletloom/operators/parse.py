"""Pairs of transliteration and translation on the pages of publications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletloom.functions import fixed as X
from tabletloom.functions.scoring import akkadian_score, english_score, non_english_score
from tabletloom.functions.text import fold_space, strip, text
from tabletloom.session import spread

#: Stands before a header or behind a candidate; it occurs in no text.
CUT = "\x01"


def segments(c: Column | str) -> Column:
    """The text cut before each ``Text N.`` header. What precedes the first is stripped, and left out if blank."""
    t = text(c)
    parts = F.split(F.regexp_replace(t, f"({X.TEXT_HEADER})", f"{CUT}$1"), CUT)
    first = strip(parts[0])
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.when(F.size(parts) == 1, F.array(t)).when(first == "", rest).otherwise(F.concat(F.array(first), rest))


def candidate_ends(c: Column) -> Column:
    """Positions (characters before) right after each colon or full stop with the blanks that follow it."""
    parts = F.split(F.regexp_replace(c, "([:.][ \t\n]+)", f"$1{CUT}"), CUT)
    sizes = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.length)
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(sizes, zero, lambda a, x: F.struct((a["n"] + x).alias("n"), F.concat(a["all"], F.array(a["n"] + x)).alias("all")), lambda a: a["all"])


def _from_first(lines: Column, stop) -> Column:
    """The lines from the first one for which ``stop`` holds, none if there is none."""
    at = F.array_position(F.transform(lines, stop), True)
    return F.when(at == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), F.size(lines)))


def clean_transliteration(c: Column) -> Column:
    """Without headers, labels and leading lines that hold no diacritics (up to a blank one); empty below 20."""
    lines = F.split(F.regexp_replace(c, X.TEXT_HEADER, ""), "\n")
    kept = _from_first(lines, lambda x: (strip(x) == "") | x.rlike(f"[{X.DIACRITICS}]"))
    out = fold_space(F.regexp_replace(F.array_join(kept, "\n"), X.LABEL, ""))
    return F.when(F.length(out) >= 20, out).otherwise("")


def clean_translation(c: Column) -> Column:
    """Up to the next header or line of transliteration, without a trailing reference; empty below 15."""
    lines = F.split(F.split(c, X.TEXT_HEADER, 2)[0], "\n")

    def begins_text(line: Column) -> Column:
        s = strip(line)
        return (F.length(s) > 25) & s.rlike(f"[{X.DIACRITICS}]") & (akkadian_score(s) > 1.0) & (english_score(s) < 0.3)

    at = F.array_position(F.transform(lines, begins_text), True)
    kept = F.when(at == 0, lines).otherwise(F.slice(lines, 1, F.greatest(at - 1, F.lit(0)).cast("int")))
    out = fold_space(F.regexp_replace(F.array_join(kept, "\n"), X.REFERENCE, ""))
    return F.when(F.length(out) >= 15, out).otherwise("")


def first_splits(segments_: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with what stands ``before`` and ``after`` the first candidate of each segment that passes the gates.

    Every candidate brings its surroundings only, and only those that pass are moved: to the first of each segment.
    """
    def around(at: Column, left: int, right: int) -> tuple[Column, Column]:
        before = strip(F.substring(F.col("segment"), F.greatest(at - left, F.lit(0)) + 1, F.least(at, F.lit(left))))
        return before, strip(F.substring(F.col("segment"), at + 1, F.lit(right)))

    def candidate(at: Column) -> Column:
        b, a = around(at, 200, 300)
        return F.struct(at.alias("_at"), b.alias("b"), a.alias("a"))

    # made in the array, so that the gates read them and don't make them again
    c = segments_.select(*keys, "segment", F.inline(F.transform(candidate_ends(F.col("segment")), candidate)))
    before, after = around(F.col("_at"), 800, 2000)
    c = c.where((F.length("b") >= 20) & (F.length("a") >= 15))
    c = c.where(akkadian_score("b") >= 0.3).where(english_score("a") >= 0.15).where(english_score("b") <= 0.3).where(non_english_score("a") <= 1.0)
    found = c.select(*keys, "_at", before.alias("before"), after.alias("after"))
    return found.groupBy(*keys).agg(F.min_by(F.struct("before", "after"), "_at").alias("s")).select(*keys, "s.*")


def extract_pairs(pages: DataFrame, id_column: str = "row_id", text_column: str = "page_text", keep: list[str] | None = None) -> DataFrame:
    """(id, columns to keep, segment_no, transliteration, translation): the pair of each segment of a page that has one."""
    keep = keep or []
    keys = [id_column, *keep, "segment_no"]
    found = first_splits(spread(pages).select(id_column, *keep, F.posexplode(segments(text_column)).alias("segment_no", "segment")), keys)
    out = found.select(*keys, clean_transliteration(F.col("before")).alias("transliteration"), clean_translation(F.col("after")).alias("translation"))
    s, t = F.col("transliteration"), F.col("translation")
    out = out.where((F.length(s) >= 100) & (F.length(t) >= 100))
    return (
        out.where(akkadian_score(s) >= 1.0).where(english_score(s) <= 0.2).where(non_english_score(s) <= 0.5)
        .where(english_score(t) >= 0.4).where(english_score(F.substring(t, 1, 300)) >= 0.15).where(non_english_score(t) <= 0.5)
    )
