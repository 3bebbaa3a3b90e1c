"""Seeded samples and splits. The draw is by a digest of seed and key, so it depends on no partitioning and on no engine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletloom.functions.text import strip


#: Draws are numbers of so many bits.
BITS = 60


def draw(key: Column, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), key.cast("string"))), 1, BITS // 4), 16, 10).cast("long")


def sample_rows(df: DataFrame, n: int, key: str = "row_id", seed: int = 42) -> DataFrame:
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def sample_groups(df: DataFrame, column: str, n: int, seed: int = 42) -> DataFrame:
    """The rows of ``n`` distinct values, of all if there are no more."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    chosen = values.orderBy(draw(F.col(column), seed), column).limit(n)
    return df.join(chosen, column, "left_semi")


def non_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (F.length(strip(F.col(c))) > 0))
    return df


def split_sizes(n: int, val: float, test: float) -> tuple[int, int, int]:
    """Rows of train, val and test: shares are rounded up, test is taken first."""
    n_test = math.ceil(n * test - 1e-9)
    n_val = math.ceil((n - n_test) * (val / (1 - test)) - 1e-9)
    return n - n_test - n_val, n_val, n_test


def random_split(df: DataFrame, val: float = 0.1, test: float = 0.1, key: str = "row_id", seed: int = 42) -> DataFrame:
    """``df`` with ``split``: exact sizes in an order drawn by hash.

    The cut points are the values of the hash at two ranks, found by counts of hash ranges; no row is moved to one task.
    """
    n = df.count()
    train, n_val, n_test = split_sizes(n, val, test)
    h = draw(F.col(key), seed)
    tagged = df.withColumn("_h", F.struct(h.alias("h"), F.col(key).alias("k")))

    def at_rank(rank: int) -> tuple | None:
        """The tag that ``rank`` rows precede: narrowed by counts of 4,096 ranges each time."""
        if rank >= n:
            return None
        lo, hi, before = 0, 2**BITS - 1, 0
        while True:
            width = max(1, -(-(hi - lo + 1) // 4096))
            inside = tagged.where((F.col("_h.h") >= F.lit(lo)) & (F.col("_h.h") <= F.lit(hi)))
            if hi - lo < 4096 or inside.count() <= 10_000:
                rows = sorted((r[0], r[1]) for r in inside.select("_h.h", "_h.k").collect())
                return rows[rank - before]
            bucket = F.expr(f"(_h.h - {lo}) div {width}")
            for b, c in sorted((r[0], r[1]) for r in inside.groupBy(bucket).count().collect()):
                if before + c > rank:
                    lo, hi = lo + b * width, min(hi, lo + b * width + width - 1)
                    break
                before += c

    def below(cut: tuple | None):  # noqa: ANN202
        return F.lit(True) if cut is None else F.col("_h") < F.struct(F.lit(cut[0]).alias("h"), F.lit(cut[1]).alias("k"))

    first, second = at_rank(n_test), at_rank(n_test + n_val)
    return tagged.withColumn("split", F.when(below(first), "test").when(below(second), "val").otherwise("train")).drop("_h")


def first_rows(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    return df.orderBy(order).limit(n)


def training_steps(rows: int, batch: int, accumulate: int = 1, epochs: int = 1) -> int:
    return math.ceil(rows / (batch * accumulate)) * epochs
