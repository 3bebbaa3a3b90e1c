"""Prompts from lexicon entries, retrieved examples and the text itself, within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletloom.functions.text import prefix, text
from tabletloom.operators.lexicon import text_names, text_sumerograms

BUDGET = 800


def lexicon_section(df: DataFrame, names: DataFrame, table: DataFrame, id_column: str = "row_id", column: str = "transliteration") -> DataFrame:
    """(id, lexicon): names, then Sumerograms, one an entry, repeats once, in text order."""
    a = text_names(df, names, id_column, column).select(id_column, F.struct(F.lit(0).alias("k"), "pos", F.concat(F.lit("- "), "form", F.lit(" = "), "norm", F.lit(" ("), "type", F.lit(")")).alias("e")).alias("x"))
    b = text_sumerograms(df, table, id_column, column).select(id_column, F.struct(F.lit(1).alias("k"), "pos", F.concat(F.lit("- "), "sumerogram", F.lit(" = "), "definition").alias("e")).alias("x"))
    entries = F.array_distinct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]))
    return a.union(b).groupBy(id_column).agg(F.concat(F.lit("Lexicon:\n"), F.array_join(entries, "\n")).alias("lexicon"))


def examples_section(hits: DataFrame, id_column: str = "query_id") -> DataFrame:
    """(id, examples): the hits in order of rank, shortened."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring(text("transliteration"), 1, 80), F.lit(" → "), F.substring(text("translation"), 1, 100))
    rows = hits.select(id_column, F.struct("rank", line.alias("e")).alias("x"))
    return rows.groupBy(id_column).agg(F.concat(F.lit("Similar translations:\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]), "\n")).alias("examples"))


def assemble(lexicon: Column, examples: Column, source: Column | None, budget: int = BUDGET) -> Column:
    """The sections that are not empty, blank lines between, within ``budget`` characters.

    The last section is kept whole; the one before gets the rest of the budget, two before half of it each. A negative
    rest drops so many characters from a section's end, as slices do, so the result may exceed the budget.
    """
    parts = F.filter(F.array(lexicon, examples, *([F.concat(F.lit("Translate: "), text(source))] if source is not None else [])), lambda x: x.isNotNull() & (x != ""))
    whole = F.array_join(parts, "\n\n")
    n = F.size(parts)
    last = F.element_at(parts, -1)
    rest = F.lit(budget) - F.length(last) - 4
    half = F.floor(rest / 2).cast("int")
    two = F.concat(prefix(parts[0], rest), F.lit("\n\n"), last)
    three = F.concat(prefix(parts[0], half), F.lit("\n\n"), prefix(F.get(parts, F.lit(1)), half), F.lit("\n\n"), last)
    return F.when(F.length(whole) <= budget, whole).when(n == 1, F.substring(whole, 1, budget)).when(n == 2, two).otherwise(three)


def assemble_all(df: DataFrame, names: DataFrame, table: DataFrame, hits: DataFrame | None = None, id_column: str = "row_id", column: str = "transliteration", budget: int = BUDGET) -> DataFrame:
    """(id, prompt, estimate) of all rows: lexicon entries, the hits (query_id, rank, transliteration, translation) as
    examples, and the text itself. Rows without entries or hits have fewer sections."""
    out = df.select(id_column, column).join(lexicon_section(df, names, table, id_column, column), id_column, "left")
    if hits is None:
        out = out.withColumn("examples", F.lit(None).cast("string"))
    else:
        out = out.join(examples_section(hits).withColumnRenamed("query_id", id_column), id_column, "left")
    return out.select(id_column, assemble(F.col("lexicon"), F.col("examples"), F.col(column), budget).alias("prompt"), estimated_length(F.col(column)).alias("estimate"))


def estimated_length(source: Column) -> Column:
    return F.lit(100 + 300 + 12) + F.length(text(source))
