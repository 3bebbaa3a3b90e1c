"""Synthetic gaps in transliterations, as Column expressions: every draw is a hash of what it is for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletloom.functions import fixed as X
from tabletloom.functions.text import SPACE, is_upper
from tabletloom.session import spread


def is_name(word: Column) -> Column:
    return is_upper(F.substring(word, 1, 1))


def is_sumerogram(word: Column) -> Column:
    bare = F.translate(word, "{}[]", "")
    return (F.length(bare) >= 2) & is_upper(bare)


def draw(*parts: Column) -> Column:
    """A number from 0 up to 1 that depends on the parts only."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / 2.0**32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_gaps(words: Column, key: list[Column], big_ratio: float) -> Column:
    """The words with one to three inner ones, no names or Sumerograms, turned into gaps; a big gap may take two words.

    Of chosen words that are neighbours only the first becomes a gap. Words without a candidate stay as they are.
    """
    n = F.size(words)
    inner = F.filter(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: (i < n - 1) & ~is_name(F.get(words, i)) & ~is_sumerogram(F.get(words, i)))
    big = lambda i: draw(*key, F.lit("big"), i) < big_ratio

    def picked(inner: Column) -> Column:
        ranked = F.array_sort(F.transform(inner, lambda i: F.struct(draw(*key, F.lit("place"), i).alias("u"), i.alias("i"))))
        many = 1 + F.floor(draw(*key, F.lit("many")) * F.least(F.size(inner), F.lit(3))).cast("int")
        return F.transform(F.slice(ranked, F.lit(1), many), lambda x: x["i"])

    def filled(gaps: Column, taken: Column) -> Column:
        kept = F.transform(words, lambda w, i: F.when(F.array_contains(gaps, i), F.when(big(i), X.BIG_GAP).otherwise(X.SINGLE_GAP)).when(~F.array_contains(taken, i), w))
        return F.filter(kept, lambda w: w.isNotNull())

    def first_ones(chosen: Column) -> Column:
        return F.filter(chosen, lambda i: ~F.array_contains(chosen, i - 1))

    def second_words(gaps: Column) -> Column:
        return F.transform(F.filter(gaps, lambda i: big(i) & (draw(*key, F.lit("span"), i) >= 0.5)), lambda i: i + 1)

    out = let(inner, lambda x: let(picked(x), lambda c: let(first_ones(c), lambda g: let(second_words(g), lambda t: filled(g, t)))))
    return F.when(F.size(inner) == 0, words).otherwise(out)


def augment(df: DataFrame, column: str = "transliteration", factor: int = 1, gap_prob: float = 0.2, big_ratio: float = 0.3, seed: int = 42, id_column: str = "row_id") -> DataFrame:
    """Each row as copy 0, unchanged, and ``factor`` copies with gaps: the columns of ``df`` and ``copy``.

    A copy is changed with probability ``gap_prob``, if it has three or more words. The draws depend on the seed, the id
    and the copy only. Null and empty texts stay as they are.
    """
    names = [c for c in df.columns if c != "copy"]
    key = [F.lit(seed), F.col(id_column), F.col("copy")]
    words = F.filter(F.split(F.col(column), f"{SPACE}+"), lambda w: w != "")
    many = spread(df.select(*names)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor)))).withColumn("_words", words)
    changed = (F.col("copy") > 0) & (F.size("_words") >= 3) & (draw(*key, F.lit("copy")) <= gap_prob)
    text = F.when(changed, F.array_join(with_gaps(F.col("_words"), key, big_ratio), " ")).otherwise(F.col(column))
    return many.withColumn(column, text).select(*names, "copy")
