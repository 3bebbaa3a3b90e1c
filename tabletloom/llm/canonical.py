"""Problem 2: freely written values mapped to the entries of a reference list by a prefix-filter similarity join.

A value is folded (look, case, accents, index digits, determinatives, damage marks) to a few plain variants, a variant
to the set of its character pairs. Pairs are ordered by global rarity. Two sets of Jaccard similarity ``t`` share one
of the ``n - ceil(t n) + 1`` rarest pairs of each, so only these prefixes are joined; sizes and positions then bound the
overlap that is still possible, the rest is verified exactly, and the best entry is kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabletloom.llm.look import consistent_arrow
from tabletloom.session import cut, shuffle_partitions, spread

#: Entries of the reference list up to which it is broadcast; a longer list is joined by a shuffle.
BROADCAST_ENTRIES = 20_000
THRESHOLD = 0.4
#: Below this similarity the best entry must lead the next one by ``MARGIN``.
SURE, MARGIN = 0.5, 0.08

_BRACES = re.compile(r"\{[^}]*\}")
_MARKS = re.compile(r"[\[\]˹˺<>!?]")
_OPEN = re.compile(r"(?:…|\.\.\.|-x|\bx|-)\W*$")
_AFTER = re.compile(r"(?:…|\.\.\.).*$|(?:-?\bx)+\W*$")
_WORDS = re.compile(r"[\s,()]+")
# Other spellings of one consonant, and an ending that is no part of a name.
_SPELLINGS = (("sz", "s"), ("sh", "s"), ("kh", "h"))
_ENDING = "-ma"


def letters(word: str) -> str:
    """Plain small letters of a word."""
    s = unicodedata.normalize("NFD", word.lower())
    s = "".join(c for c in s if "a" <= c <= "z")
    for a, b in _SPELLINGS:
        s = s.replace(a, b)
    return s


def variants(word: str) -> set[str]:
    """Folded forms of one written name: ``^`` opens each, ``$`` closes those whose end is not broken away."""
    word = _BRACES.sub("", word)
    bare = _MARKS.sub("", word)
    broken = bool(_OPEN.search(bare)) and len(letters(bare)) > 1
    bare = _AFTER.sub("", bare)
    forms = {letters(bare)}
    if bare.endswith(_ENDING):
        forms.add(letters(bare[: -len(_ENDING)]))
    return {f"^{f}" + "$" * (not broken) for f in forms if f}


def name_key(word: str) -> str:
    return "|".join(sorted(variants(word)))


def value_key(value: str) -> str:
    """All variants of a free value: of its capitalised words, and of all its words run together."""
    words = [w for w in _WORDS.split(value) if w]
    names = [w for w in words if w[:1].isupper() and len(letters(w)) > 2] or words
    found = set().union(*map(variants, names), variants("".join(words))) if words else set()
    return "|".join(sorted(found))


def is_name(word: str) -> bool:
    """A word that begins with a capital, maybe behind a determinative in braces, and is not all capitals."""
    m = re.match(r"(?:\{[^}]*\})?(.)", word)
    bare = _BRACES.sub("", word)
    return bool(m) and m[1].isupper() and bare.upper() != bare


def keyed_names(df: DataFrame, column: str, id_column: str, inside: bool) -> DataFrame:
    """(row_id, key): distinct names in each text (``inside``), or the key of each whole value. Null texts have none."""
    narrow = df.select(F.col(id_column).cast("long").alias("row_id"), F.col(column).cast("string").alias("text")).where("text is not null")
    narrow = spread(narrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, str | None] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids, keys = [], []
                for i, text in zip(batch.column("row_id").to_pylist(), consistent_arrow(batch.column("text")).to_pylist(), strict=True):
                    found = set()
                    for w in set(text.split()) if inside else (text,):
                        if w not in seen:
                            if len(seen) > 500_000:
                                seen.clear()
                            seen[w] = (name_key(w) if is_name(w) else None) if inside else value_key(w)
                        if (k := seen[w]) is not None:
                            found.add(k)
                    ids += [i] * len(found)
                    keys += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=["row_id", "key"])

    return narrow.mapInArrow(run, "row_id long, key string")


def pairs_of(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))


def _prefixes(df: DataFrame, keys: list[str], rank: DataFrame, threshold: float) -> DataFrame:
    """``df`` (keys, v) with (tokens, n) and one row per token of the prefix: (tok, pos)."""
    tokens = df.select(*keys, "v", F.explode(pairs_of(F.col("v"))).alias("pair")).join(F.broadcast(rank), "pair")
    sets = tokens.groupBy(*keys, "v").agg(F.sort_array(F.collect_list("rank")).alias("tokens")).withColumn("n", F.size("tokens"))
    last = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    return sets.select("*", F.posexplode(F.slice("tokens", F.lit(1), F.greatest(last, F.lit(1)).cast("int"))).alias("pos", "tok"))


def match_keys(keys: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, ref_id, similarity) of each distinct key: its best entry, or -1 without one.

    ``entries`` has (ref_id, form): several rows an entry are allowed. Ties go to the least ref_id. Keys without letters
    and keys whose best entries are too close below ``SURE`` stay unmatched.
    """
    spark = keys.sparkSession

    @F.pandas_udf("string")
    def fold(forms: pd.Series) -> pd.Series:
        return forms.map(name_key)

    known = cut(entries.where("form is not null").select("ref_id", F.explode(F.split(fold("form"), r"\|")).alias("v")).where("v <> ''").distinct())
    asked = keys.select("key", F.explode(F.split("key", r"\|")).alias("v")).where("v <> ''")
    # character pairs over a-z, ^ and $: at most 28 * 28 of them, whatever the data
    counts = asked.select("v").union(known.select("v")).select(F.explode(pairs_of(F.col("v"))).alias("pair")).groupBy("pair").count().collect()
    order = {r["pair"]: i for i, r in enumerate(sorted(counts, key=lambda r: (r["count"], r["pair"])))}
    rank = spark.createDataFrame(list(order.items()) or [("", 0)], "pair string, rank int")
    q = _prefixes(asked, ["key"], rank, threshold)
    e = _prefixes(known, ["ref_id"], rank, threshold).select("tok", "ref_id", F.col("tokens").alias("etokens"), F.col("n").alias("en"), F.col("pos").alias("epos"))
    if known.count() <= BROADCAST_ENTRIES:
        e = F.broadcast(e)
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("en")) - 1e-9)
    possible = F.lit(1) + F.least(F.col("n") - F.col("pos"), F.col("en") - F.col("epos")) - 1 + F.least("pos", "epos")
    close = q.repartition(shuffle_partitions(spark)).join(e, "tok").where((F.col("n") >= F.col("en") * threshold - 1e-9) & (F.col("en") >= F.col("n") * threshold - 1e-9) & (possible >= need))
    both = F.size(F.array_intersect("tokens", "etokens"))
    scored = close.select("key", "ref_id", (both / (F.col("n") + F.col("en") - both)).alias("j")).where(F.col("j") >= threshold)
    # the best two entries of each key; the others of a key are dropped before they are moved
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("j"), "ref_id"))
    two = scored.groupBy("key", "ref_id").agg(F.max("j").alias("j")).withColumn("place", place).where("place <= 2")
    of = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    best = two.groupBy("key").agg(of(1, "ref_id").alias("ref_id"), of(1, "j").alias("similarity"), of(2, "j").alias("next"))
    good = (F.col("similarity") >= SURE) | (F.col("similarity") - F.coalesce("next", F.lit(THRESHOLD - 0.1)) >= MARGIN)
    found = best.select("key", F.when(good, F.col("ref_id")).alias("ref_id"), "similarity")
    return keys.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("ref_id", F.lit(-1)).cast("long").alias("ref_id"), "similarity")


def map_fields(fields: dict[str, DataFrame], entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(field, row_id, ref_id): the distinct entries of each row's names; -1 where a name stands for none.

    ``fields`` maps a field's name to its (row_id, key) rows from ``keyed_names``. Each distinct key is matched once.
    """
    out = None
    for name, df in fields.items():
        one = df.select(F.lit(name).alias("field"), "row_id", "key")
        out = one if out is None else out.unionByName(one)
    rows = cut(out)
    matched = match_keys(cut(rows.select("key").distinct()), entries, threshold)
    return rows.join(matched, "key").select("field", "row_id", "ref_id").distinct()
