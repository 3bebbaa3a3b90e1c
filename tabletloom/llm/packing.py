"""Problem 9: items packed into containers of fixed capacity by bounded-space online best fit.

A fixed number of containers is open at a time. Open containers stand in a bitset keyed by their free space, so the
best fit is the lowest set bit at or above the item's size; when too many are open, the fullest closes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_fit(sizes: list[int], capacity: int, open_bins: int) -> Iterator[tuple[int, int, int, int]]:
    """(item, offset, size, container) of each placed piece. An item is divided only if it exceeds the capacity: into
    full containers and a rest, which is placed like any item. Items of size 0 are placed nowhere."""
    by_free: dict[int, list[int]] = {}
    bits, n_open, made = 0, 0, 0
    for item, size in enumerate(sizes):
        offset = 0
        while size > capacity:
            yield item, offset, capacity, made
            made, offset, size = made + 1, offset + capacity, size - capacity
        if not size:
            continue
        fitting = bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                bits ^= 1 << free
        else:
            if n_open == open_bins:
                fullest = (bits & -bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    bits ^= 1 << fullest
                n_open -= 1
            free, at, made, n_open = capacity, made, made + 1, n_open + 1
        yield item, offset, size, at
        left = free - size
        if left:
            by_free.setdefault(left, []).append(at)
            bits |= 1 << left
        else:
            n_open -= 1


def pack(sized: DataFrame, rows: int, capacity: int, id_column: str = "doc_id", size_column: str = "n_tokens", open_bins: int = 256, rows_a_shard: int = 100_000, shards: int | None = None) -> DataFrame:
    """(id, piece_no, begin, size, container): where each item, or each piece of an oversized one, is.

    Items are spread over shards by the last bits of a hash of their id: as many bits as keep shards within about
    ``rows_a_shard`` items, so a shard is only ever cut in two, at each doubling of the table, or given by ``shards``. A shard
    is packed in id order and shares no container with another, so the result is the same whatever the partitioning, and a
    shard leaves at most ``open_bins`` containers short of full. Items of size 0 or null keep one row with a null container. Repeated ids are separate items.
    """
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be at least 1")
    shards = shards or 1 << max(0, (-(-rows // rows_a_shard) - 1).bit_length())
    narrow = sized.select(F.col(id_column).alias("id"), F.coalesce(F.col(size_column), F.lit(0)).cast("long").alias("size"))
    keyed = narrow.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("long"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("size", "ascending")])
        sizes = table.column("size").to_pylist()
        rows = [(i, b, n, c + (key[0].as_py() << 40)) for i, b, n, c in best_fit(sizes, capacity, open_bins)]
        rows += [(i, 0, 0, None) for i, n in enumerate(sizes) if not n]
        rows.sort(key=lambda r: r[:2])
        item = [r[0] for r in rows]
        piece = [1 if not k or item[k - 1] != i else 0 for k, i in enumerate(item)]
        for k, first in enumerate(piece):
            piece[k] = 1 if first else piece[k - 1] + 1
        columns = [table.column("id").combine_chunks().take(pa.array(item, pa.int64())), *(pa.array(x, pa.int64()) for x in (piece, *([r[j] for r in rows] for j in (1, 2, 3))))]
        return pa.Table.from_arrays(columns, names=["id", "piece_no", "begin", "size", "container"])

    id_type = narrow.schema["id"].dataType.simpleString()
    return keyed.groupBy("shard").applyInArrow(run, f"id {id_type}, piece_no long, begin long, size long, container long").withColumnRenamed("id", id_column)
