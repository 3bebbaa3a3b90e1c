"""Problem 3: near-duplicate records with small edits, found by anchor-point covering.

Each text becomes a fingerprint: a word of symbols over a large alphabet, one least trigram hash a symbol, in which two
texts agree symbol by symbol with the probability of their Jaccard similarity. The fingerprint is cut into blocks of
``agree + 1`` symbols. The anchors of a block are the words of the single parity-check code of that length, a covering
code of radius 1: changing any one symbol of a word reaches exactly one code word, so each word has ``agree + 1``
anchors within the radius, and a code word is named by the ``agree`` symbols that stay. Fingerprints are replicated to
all of them; two words at distance 1 or less in a block always meet. At each anchor they are compared by 192 sketch bits,
and the remaining pairs exactly by their trigram sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletloom.llm import sketch as S
from tabletloom.session import cut


#: Symbols of a block that must agree (one more may differ), and blocks. At Jaccard 0.7 a pair misses all blocks with a
#: probability of 0.5 %, at 0.75 of 0.1 %. Larger collections may ask for more selective anchors, such as (5, 10).
AGREE, BLOCKS = 4, 7


def anchor_keys(symbols: np.ndarray, agree: int, blocks: int) -> np.ndarray:
    """rows x (blocks * (agree + 1)) 64-bit names of the anchors within the covering radius."""
    n = agree + 1
    out = np.empty((len(symbols), blocks * n), np.uint64)
    for b in range(blocks):
        word = symbols[:, b * n : b * n + n]
        weighed = S.mix(word ^ np.uint64(0x632BE59BD9B4E019) * np.arange(1, n + 1, dtype=np.uint64))
        total = weighed.sum(axis=1, dtype=np.uint64)
        for i in range(n):
            out[:, b * n + i] = S.mix((total - weighed[:, i]) ^ np.uint64((b * n + i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return out


def similar_classes(rows: DataFrame, known: DataFrame, n: int, threshold: float = 0.7, agree: int = AGREE, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (a, b, jaccard) of alike classes of equal keys; ``rows`` as in ``sketch.ROWS``, ``known`` their members."""
    anchors = blocks * (agree + 1)
    parts = S.part_count(rows.sparkSession, n * anchors)
    def anchors_of(cp: np.ndarray, row: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, row = S.trigrams(cp, row)
        h = S.mix(code)
        return anchor_keys(S.densify(S.bin_minima(h, row, texts, anchors)), agree, blocks), h, row

    hot = S.hot_keys(rows, n, lambda texts, _: anchors_of(*S.flat_keys(texts), len(texts))[0].ravel())

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = S.Parts(parts, hot, entry=S.NARROW), np.empty(0, np.uint64)
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                cp, row = S.flat_keys(whole.slice(at, 4000).column("text").to_pylist())
                n_rows = min(4000, whole.num_rows - at)
                size = np.bincount(row, minlength=n_rows)
                ids = S.class_ids(cp, row, n_rows, np.zeros(n_rows, np.int64))
                _, first = np.unique(ids, return_index=True)  # copies are sent once, as far as a task sees them
                new = np.zeros(n_rows, bool)
                new[first] = True
                new &= (size >= 3) & ~np.isin(ids, seen)
                seen = np.concatenate([seen, ids[new]])[-1_000_000:]
                if not new.any():
                    continue
                keep = new[row]
                cp, row, ids = cp[keep], (np.cumsum(new) - 1)[row[keep]], ids[new]
                keys, h, row = anchors_of(cp, row, len(ids))
                bits, filled = S.sketch_bits(h, row, len(ids))
                rep = np.repeat(np.arange(len(ids)), anchors)
                yield from out.add(keys.ravel(), ids[rep], bits[rep], filled[rep], np.zeros(len(rep), np.uint8))
        yield from out.flush()

    entries = rows.select("text").mapInArrow(replicate, "part int, blob binary")
    return S.verify(cut(S.compare_parts(entries, parts, cross=False, entry=S.NARROW)), rows, known, threshold)


def table_rows(tables: dict[str, DataFrame], column: str, id_column: str = "row_id") -> DataFrame:
    """All rows of the tables with a text, as in ``sketch.ROWS``."""
    out = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("tbl"), F.col(id_column).cast("long").alias("row_id"), F.lit(0).cast("tinyint").alias("flag"), F.lit(0).cast("tinyint").alias("side"), F.col(column).cast("string").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out.where("text is not null and row_id is not null")


def near_duplicate_links(tables: dict[str, DataFrame], column: str, threshold: float = 0.7, id_column: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal keys, and the membership: (a, b, jaccard) and (tbl, row_id, cls).

    Null texts, rows with a null id, and texts of fewer than three characters without white space and ``!?.`` belong to
    no class and have no link. Repeated rows share a class; extra columns and columns of clashing names are ignored; empty tables
    give empty results.
    """
    rows = table_rows(tables, column, id_column)
    known = cut(S.members(rows))
    n = sum(df.count() for df in tables.values())
    return cut(similar_classes(rows, known, n, threshold)), known.select("tbl", "row_id", "cls")


def near_duplicate_pairs(tables: dict[str, DataFrame], column: str, threshold: float = 0.7, id_column: str = "row_id") -> DataFrame:
    """All pairs of alike rows: (tbl_a, row_id_a, tbl_b, row_id_b), the smaller (table, id) first."""
    links, known = near_duplicate_links(tables, column, threshold, id_column)
    a = known.select(F.col("tbl").alias("tbl_a"), F.col("row_id").alias("row_id_a"), F.col("cls").alias("a"))
    b = known.select(F.col("tbl").alias("tbl_b"), F.col("row_id").alias("row_id_b"), F.col("cls").alias("b"))
    # classes are linked both ways and to themselves, so that one join gives all pairs, each in one order
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    several = known.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    pairs = both.union(several)
    return pairs.join(a, "a").join(b, "b").where(F.struct("tbl_a", "row_id_a") < F.struct("tbl_b", "row_id_b")).select("tbl_a", "row_id_a", "tbl_b", "row_id_b")


def near_duplicate_groups(tables: dict[str, DataFrame], column: str, threshold: float = 0.7, id_column: str = "row_id") -> DataFrame:
    """One row per record: (tbl, row_id, cls, links): its class of equal keys, named by its least (table, id), and its number
    of alike records.

    ``cls`` is null for records without a class.
    """
    links, known = near_duplicate_links(tables, column, threshold, id_column)
    size = known.groupBy("cls").agg(F.count("*").alias("n"), F.min(F.struct("tbl", "row_id")).alias("least"))
    name = F.concat("least.tbl", F.lit("/"), F.col("least.row_id").cast("string"))
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(size.select(F.col("cls").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "cls")
    count = size.join(linked, "cls", "left").select("cls", name.alias("name"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    every = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("tbl"), F.col(id_column).cast("long").alias("row_id"))
        every = one if every is None else every.unionByName(one)
    return every.join(known.join(count, "cls").dropDuplicates(["tbl", "row_id"]), ["tbl", "row_id"], "left").select("tbl", "row_id", F.col("name").alias("cls"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
