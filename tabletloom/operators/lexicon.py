"""Lexicon tables and lookups."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletloom.functions import fixed as X
from tabletloom.functions.features import NAME, SUMEROGRAM, all_matches
from tabletloom.functions.text import clean_definition, dictionary_base, is_upper, text, undotted
from tabletloom.operators.flat import flat
from tabletloom.session import cut, spread

SIMILAR = 0.8
#: A lookup table of at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, known: int | None = None) -> DataFrame:
    """``df`` marked for a broadcast if it is counted to be small."""
    return F.broadcast(df) if (df.count() if known is None else known) <= BROADCAST_ROWS else df


def proper_noun_table(lexicon: DataFrame) -> DataFrame:
    """(form, norm, lexeme, type, pos) of PN and GN rows: the last row of a form wins, at the place of its first.

    A null norm is the form, a null lexeme the norm. Rows of a null form are left out.
    """
    rows = lexicon.where("type in ('PN', 'GN') and form is not null")
    last = F.max_by(F.struct(F.coalesce("norm", "form").alias("norm"), F.coalesce("lexeme", "norm", "form").alias("lexeme"), "type"), "row_id")
    return rows.groupBy("form").agg(last.alias("e"), F.min("row_id").alias("pos")).select("form", "e.*", "pos")


def dictionary_table(dictionary: DataFrame) -> DataFrame:
    """(word, definition): the last non-empty definition of each word."""
    rows = dictionary.where("word is not null and definition <> ''")
    return rows.groupBy("word").agg(F.max_by("definition", "row_id").alias("definition"))


def base_table(dictionary: DataFrame) -> DataFrame:
    """(base, definition): the first non-empty cleaned definition of each word without its homonym numeral."""
    rows = dictionary.select("row_id", dictionary_base(F.col("word")).alias("base"), clean_definition(F.col("definition")).alias("definition"))
    return rows.where("base is not null and base <> '' and definition <> ''").groupBy("base").agg(F.min_by("definition", "row_id").alias("definition"))


def _endings(root: Column) -> Column:
    stem = F.substring(root, F.lit(1), F.length(root) - 1)
    plain = F.array(root, F.concat(root, F.lit("u")), F.concat(root, F.lit("um")))
    cut_m = F.array(stem, F.concat(stem, F.lit("u")), F.concat(stem, F.lit("um")))
    some = F.when(root.endswith("m") & (F.length(root) > 2), F.concat(plain, cut_m)).otherwise(plain)
    return F.when(root.isNull() | (root == ""), F.array().cast("array<string>")).otherwise(some)


def sumerogram_table(lexicon: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(form, definition) of all-capital forms of two or more characters: the first row of a form counts; its definition
    is that of the first of its roots and their endings in the dictionary, else the norm."""
    first = lexicon.where("form is not null and length(form) >= 2").where(is_upper(F.col("form"))).groupBy("form").agg(F.min_by(F.struct("lexeme", "norm"), "row_id").alias("e")).select("form", "e.*")
    tried = first.select("form", F.posexplode(F.concat(_endings(F.col("lexeme")), _endings(F.col("norm")))).alias("pos", "base"))
    hit = tried.join(small(base_table(dictionary)), "base").groupBy("form").agg(F.min_by("definition", "pos").alias("definition"))
    return first.join(hit, "form", "left").select("form", F.coalesce("definition", "norm").alias("definition"))


def lookup_exact(terms: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """The terms with their entry and similarity 1, or nulls."""
    n = names.select(F.col("form").alias(column), "norm", "lexeme", "type", F.lit(1.0).alias("similarity"))
    return terms.join(small(n), column, "left")


def lookup_sumerograms(terms: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """The terms with their definition: by the form, else by the form without its dots."""
    t = cut(table)
    a = t.select(F.col("form").alias(column), F.col("definition").alias("_exact"))
    b = t.select(F.col("form").alias("_bare"), F.col("definition").alias("_loose"))
    joined = terms.withColumn("_bare", undotted(F.col(column))).join(small(a), column, "left").join(small(b), "_bare", "left")
    return joined.select(*terms.columns, F.coalesce("_exact", "_loose").alias("definition"))


def lookup_dictionary(terms: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    d = dictionary_table(dictionary).withColumnRenamed("word", column)
    return terms.join(small(d), column, "left")


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


class _Forms:
    """Forms with their letter counts, to find the one most alike to a term."""

    def __init__(self, forms: list[str]) -> None:
        self.forms, self.low = forms, [f.lower() for f in forms]
        cp, row = flat(self.low)
        self.letters = np.unique(cp)
        self.size = np.array([len(x) for x in self.low], np.int64)
        self.counts = np.zeros((len(forms), len(self.letters)), np.int16)
        np.add.at(self.counts, (row, np.searchsorted(self.letters, cp)), 1)

    def best(self, term: str, threshold: float) -> tuple[str, float] | None:
        """The earliest form of the greatest ratio. No ratio exceeds twice the common letters over both lengths, so forms are
        tried by falling bound, as long as that could still win."""
        query = term.lower()
        cp = np.frombuffer(query.encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.bincount(np.searchsorted(self.letters, cp[np.isin(cp, self.letters)]), minlength=len(self.letters))
        used = np.flatnonzero(own)
        common = np.minimum(self.counts[:, used], own[used]).sum(axis=1) if len(used) else np.zeros(len(self.forms), np.int64)
        bound = 2 * common / np.maximum(self.size + len(query), 1)
        near = np.flatnonzero(bound >= threshold - 1e-12)
        top, found = 0.0, -1
        for i in near[np.argsort(-bound[near], kind="stable")].tolist():
            if bound[i] < top:
                break
            ratio = _ratio(query, self.low[i])
            if ratio > top or ratio == top and 0 <= i < found:
                top, found = ratio, i
        return (self.forms[found], top) if found >= 0 and top >= threshold else None


def _pieces(c: Column) -> Column:
    """Pairs of neighbouring letters, and single ones of words of up to five."""
    low = F.lower(c)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2)))
    return F.array_distinct(F.when(F.length(low) <= 5, F.concat(pairs, F.split(low, ""))).otherwise(pairs))


def fuzzy_matches(terms: DataFrame, column: str, names: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(term, form, norm, lexeme, type, similarity) of each distinct term: its own form at similarity 1, else the form of
    the greatest matching-blocks ratio in lower case, the earliest among equals, if that reaches ``threshold`` (0.8 or more).

    Each distinct term is compared once. Beyond ``BROADCAST_ROWS`` forms, terms and forms meet at common pairs of letters:
    with a ratio of 0.8 over S letters at most 0.2 S letters are unmatched, so there are at most 0.2 S + 1 blocks and at
    least 0.2 S - 1 common pairs, one or more from S = 10 on; shorter words meet at single letters.
    """
    if threshold < SIMILAR:
        raise ValueError(f"threshold must be at least {SIMILAR}")
    distinct = terms.select(F.col(column).alias("term")).where("term is not null").distinct()
    t = cut(names)
    exact = distinct.join(small(t.select(F.col("form").alias("term"), F.col("form"), "norm", "lexeme", "type")), "term").withColumn("similarity", F.lit(1.0))
    missing = cut(distinct.join(small(t.select(F.col("form").alias("term"))), "term", "left_anti"))
    n = t.count()
    if n <= BROADCAST_ROWS:  # the forms travel to the terms
        shared = names.sparkSession.sparkContext.broadcast([r["form"] for r in t.select("form", "pos").orderBy("pos").collect()])

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            forms = _Forms(shared.value)
            for pdf in batches:
                found = [(term, *got) for term in pdf["term"] if (got := forms.best(term, threshold))]
                yield pd.DataFrame(found, columns=["term", "form", "similarity"])

        near = spread(missing).mapInPandas(best, "term string, form string, similarity double")
    else:

        def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf["similarity"] = [_ratio(a.lower(), b.lower()) for a, b in zip(pdf["term"], pdf["form"], strict=True)]
                yield pdf[pdf["similarity"] >= threshold]

        a = missing.select("term", F.explode(_pieces(F.col("term"))).alias("piece"))
        b = t.select("form", "pos", F.explode(_pieces(F.col("form"))).alias("piece"))
        x, y = F.length("term"), F.length("form")
        pairs = a.join(b, "piece").where(2 * F.least(x, y) >= threshold * (x + y) - 1e-9).select("term", "form", "pos").distinct()
        pairs = pairs.mapInPandas(ratios, "term string, form string, pos long, similarity double")
        w = Window.partitionBy("term").orderBy(F.desc("similarity"), "pos")
        near = pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("term", "form", "similarity")
    near = near.join(small(t.select("form", "norm", "lexeme", "type"), n), "form").select("term", "form", "norm", "lexeme", "type", "similarity")
    return exact.select("term", "form", "norm", "lexeme", "type", "similarity").union(near)


def text_names(df: DataFrame, names: DataFrame, id_column: str = "row_id", column: str = "transliteration", threshold: float = SIMILAR) -> DataFrame:
    """(id, pos, form, norm, type, similarity) of each name in each text that has an entry; all-capital words are none."""
    letters = lambda x: F.regexp_replace(x, f"[^{X.PLAIN_LETTERS}]", "")
    found = df.select(id_column, F.posexplode(all_matches(text(column), NAME)).alias("pos", "term")).where(~((letters(F.col("term")) != "") & is_upper(letters(F.col("term")))))
    return found.join(fuzzy_matches(found, "term", names, threshold), "term").select(id_column, "pos", "form", "norm", "type", "similarity")


def text_sumerograms(df: DataFrame, table: DataFrame, id_column: str = "row_id", column: str = "transliteration") -> DataFrame:
    """(id, pos, sumerogram, definition) of each all-capital word of the raw text that has a non-empty definition."""
    found = df.select(id_column, F.posexplode(all_matches(text(column), SUMEROGRAM)).alias("pos", "sumerogram"))
    return lookup_sumerograms(found, "sumerogram", table).where("definition <> ''")


def query_context(df: DataFrame, names: DataFrame, table: DataFrame, id_column: str = "row_id", column: str = "transliteration") -> DataFrame:
    """(id, context): the norms of a text's names, then its Sumerograms' definitions; without any the text itself."""
    a = text_names(df, names, id_column, column).select(id_column, F.struct(F.lit(0).alias("k"), "pos", F.col("norm").alias("w")).alias("x"))
    b = text_sumerograms(df, table, id_column, column).select(id_column, F.struct(F.lit(1).alias("k"), "pos", F.col("definition").alias("w")).alias("x"))
    words = a.union(b).groupBy(id_column).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]), " ").alias("context"))
    return df.select(id_column, text(column).alias("_text")).join(words, id_column, "left").select(id_column, F.coalesce("context", "_text").alias("context"))


def lexicon_stats(lexicon: DataFrame, dictionary: DataFrame) -> DataFrame:
    a = proper_noun_table(lexicon).agg(F.count("*").alias("proper_nouns"))
    b = sumerogram_table(lexicon, dictionary).where("definition <> ''").agg(F.count("*").alias("sumerograms"))
    c = dictionary_table(dictionary).agg(F.count("*").alias("dictionary"))
    return a.join(b).join(c)  # of one row each
