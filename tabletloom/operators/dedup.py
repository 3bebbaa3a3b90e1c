"""Exact and near duplicates.

Near duplicates are found by the exact similarity join of ``simjoin`` over the distinct keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletloom.functions.text import dedup_key
from tabletloom.operators.simjoin import join_texts
from tabletloom.session import cut

THRESHOLD = 0.7


def keep_first(df: DataFrame, keys: list[str], order: str = "row_id") -> DataFrame:
    """The row of least ``order`` of each combination of keys; nulls are one value."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unique_in_order(df: DataFrame, column: str, order: str = "row_id") -> DataFrame:
    """Distinct values with the first order at which each appears."""
    return df.groupBy(column).agg(F.min(order).alias("first"))


def trigram_sets(df: DataFrame, column: str, order: str = "row_id") -> DataFrame:
    """(id, sid, key): rows with trigrams, with a number of their key (rows of equal keys share it)."""
    key = dedup_key(column)
    return df.select(F.col(order).alias("id"), key.alias("key")).where("length(key) >= 3").withColumn("sid", F.xxhash64("key"))


def similar_sets(left: DataFrame, right: DataFrame | None, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) of keys with Jaccard similarity of at least ``threshold``: of left and right (equal ones, too), or different
    ones within left. Both are read several times."""
    side = lambda df, k: df.select("sid", F.lit(k).cast("tinyint").alias("side"), "key")
    sets = side(left, 0) if right is None else side(left, 0).union(side(right, 1))
    return join_texts(sets, threshold, two=right is not None)


def existing_duplicates(new: DataFrame, existing: DataFrame, column: str, threshold: float = THRESHOLD, order: str = "row_id") -> DataFrame:
    """Orders of the new rows that are alike to an existing row, or have no trigram."""
    keys = cut(new.select(F.col(order).alias("id"), dedup_key(column).alias("key")).withColumn("sid", F.xxhash64("key")))
    n, e = keys.where("length(key) >= 3"), cut(trigram_sets(existing, column, order).select("sid", "key"))
    # equal keys are alike, too
    alike = keys.join(similar_sets(n, e, threshold).select(F.col("a").alias("sid")).distinct(), "sid", "left_semi")
    return alike.union(keys.where("length(key) < 3").select(alike.columns)).select("id")


def greedy_survivors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (id) without those that an earlier survivor is linked to: the first maximal independent set in id order.

    ``edges`` has (a, b), a < b. Only nodes with an edge are decided. Each round keeps those all of whose earlier neighbours
    are out, puts out the later neighbours of what is kept, and drops the edges of both, so that rounds shrink; they are
    checkpointed, so the plan stays short. There are as many rounds as the longest chain of decisions.
    """
    edges = cut(edges.select("a", "b").distinct())
    gone = None
    rest = edges
    while not rest.isEmpty():
        kept = rest.select(F.col("a").alias("id")).distinct().join(rest.select(F.col("b").alias("id")), "id", "left_anti")
        out = cut(rest.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        gone = out if gone is None else cut(gone.union(out))
        rest = rest.join(out.withColumnRenamed("id", "a"), "a", "left_anti").join(out.withColumnRenamed("id", "b"), "b", "left_anti")
        rest = cut(rest.select("a", "b"))
    return nodes.select("id") if gone is None else nodes.select("id").join(gone, "id", "left_anti")


def near_dedup(new: DataFrame, column: str, existing: DataFrame | None = None, threshold: float = THRESHOLD, order: str = "row_id") -> DataFrame:
    """The new rows that survive: first those alike to existing rows (and those without trigrams) go, then in order each
    row that is alike to an earlier survivor. ``order`` may be of any type that sorts, such as a struct."""
    if existing is not None:
        out = existing_duplicates(new, existing.select(F.col(column)).withColumn(order, F.lit(None)), column, threshold, order)
        rest = cut(new.join(out.withColumnRenamed("id", order), order, "left_anti"))
    else:
        rest = new
    sets = cut(trigram_sets(rest, column, order))
    # of rows with equal keys only the first can survive
    first = cut(sets.groupBy("sid").agg(F.min("id").alias("id")))
    links = similar_sets(sets, None, threshold).join(first.select(F.col("sid").alias("a"), F.col("id").alias("ia")), "a").join(first.select(F.col("sid").alias("b"), F.col("id").alias("ib")), "b")
    kept = greedy_survivors(links.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")), first)
    return rest.join(kept.withColumnRenamed("id", order), order, "left_semi")


def numbered(df: DataFrame, order: str = "row_id", name: str = "row_no") -> DataFrame:
    """What is left of a filtered table with new dense numbers from 0 in the old order."""
    from tabletloom.operators.submit import with_positions

    return with_positions(df, order).withColumnRenamed("pos", name)
