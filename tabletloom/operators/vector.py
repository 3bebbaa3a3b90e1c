"""Nearest neighbours over embedding columns: exact in blocks, and by an inverted file of cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLAT_UP_TO = 100_000
#: Queries of a block: a block travels to the vectors, so the bytes of a block are bounded whatever their number.
QUERY_BLOCK = 4_096


def check_dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The one length of all vectors; ValueError if there are several."""
    sizes = [r[0] for r in vectors.where(F.col(column).isNotNull()).select(F.size(column)).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    return sizes[0] if sizes else 0


def index_kind(rows: int, kind: str | None = None) -> str:
    kind = kind or ("flat" if rows < FLAT_UP_TO else "ivf")
    if kind not in ("flat", "ivf"):
        raise ValueError(f"unknown index type: {kind}")
    return kind


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """rows of a x rows of b: squared distances."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, id_column: str = "vec_id", column: str = "embedding", exclude_self: bool = False, centers: np.ndarray | None = None, nprobe: int = 1) -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` vectors of least squared distance to each query, equal ones by id.

    With ``centers`` vectors have a ``cell``, and a query is only compared with those of its ``nprobe`` nearest cells.

    Queries are cut into blocks; each partition of vectors keeps its ``k`` best for each query of a block (a matrix
    product), and the partitions' best are merged, so what is shuffled is k rows a query and partition, not all pairs.
    """
    check_dimension(vectors, column)
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, math.ceil(n / QUERY_BLOCK))
    q = queries.where(F.col(column).isNotNull()).select(F.pmod(F.xxhash64(id_column), F.lit(blocks)).alias("block"), F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v"))
    v = vectors.where(F.col(column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v"), *([F.col("cell").cast("int").alias("cell")] if centers is not None else []))
    out, schema = None, "query_id long, id long, distance double"
    for b in range(blocks):
        got = q.where(F.col("block") == b).select("id", "v").toArrow()  # at most about QUERY_BLOCK rows
        if not got.num_rows:
            continue
        qid = np.asarray(got.column("id"), np.int64)
        qv = np.stack([np.asarray(x, np.float64) for x in got.column("v").to_pylist()])
        probes = None if centers is None else np.argsort(_squared(qv, centers), axis=1, kind="stable")[:, :nprobe]
        shared = spark.sparkContext.broadcast((qid, qv, probes))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, qv, probes = shared.value
            best_d, best_i = np.full((len(qid), k), np.inf), np.zeros((len(qid), k), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = np.asarray(batch.column("id"), np.int64)
                flat = np.asarray(batch.column("v").flatten(), np.float64).reshape(len(ids), -1)
                cells = np.zeros(len(ids), np.int64) if probes is None else np.asarray(batch.column("cell"), np.int64)
                for c in np.unique(cells):
                    asked = np.arange(len(qid)) if probes is None else np.flatnonzero((probes == c).any(axis=1))
                    inside = np.flatnonzero(cells == c)
                    for at in range(0, len(inside) if len(asked) else 0, 8192):
                        x, i = flat[inside[at : at + 8192]], ids[inside[at : at + 8192]]
                        d = _squared(qv[asked], x).round(9)
                        if exclude_self:
                            d[qid[asked, None] == i[None]] = np.inf
                        d, j = np.concatenate([best_d[asked], d], axis=1), np.concatenate([best_i[asked], np.broadcast_to(i, d.shape)], axis=1)
                        order = np.lexsort((j, d), axis=1)[:, :k]
                        best_d[asked], best_i[asked] = np.take_along_axis(d, order, 1), np.take_along_axis(j, order, 1)
            ok = np.isfinite(best_d).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, best_d.shape[1])[ok]), pa.array(best_i.ravel()[ok]), pa.array(best_d.ravel()[ok])], names=["query_id", "id", "distance"])

        part = v.mapInArrow(nearest, schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def build_ivf(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", cells: int | None = None, sample: int = 50_000, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(all vectors with their ``cell``, the centroids). Cells are fitted on at most ``sample`` vectors; every vector is
    indexed. There are min(sqrt(n), 256) cells."""
    check_dimension(vectors, column)
    n = vectors.count()
    cells = cells or max(1, min(int(math.sqrt(n)), 256))
    chosen = vectors.orderBy(F.xxhash64(id_column), id_column).limit(sample).select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=20).fit(chosen)
    centers = np.stack(model.clusterCenters())
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    @F.pandas_udf("int")
    def cell(s):  # noqa: ANN001, ANN202
        x = np.stack(s.to_list()).astype(float)
        return __import__("pandas").Series(((x**2).sum(1)[:, None] - 2 * x @ shared.value.T + (shared.value**2).sum(1)[None]).argmin(1).astype("int32"))

    return vectors.select(F.col(id_column), F.col(column), cell(F.col(column)).alias("cell")), centers


def search_ivf(queries: DataFrame, index: DataFrame, centers: np.ndarray, k: int = 5, nprobe: int = 1, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Like ``search``, among the vectors of the ``nprobe`` cells nearest to each query. Vectors stay where they are, so a large
    cell is no single task."""
    return search(queries, index, k, id_column, column, centers=centers, nprobe=nprobe)


class Index:
    """Vectors to be searched exactly (``flat``) or by cells (``ivf``), whichever suits their number."""

    def __init__(self, vectors: DataFrame, kind: str | None = None, id_column: str = "vec_id", column: str = "embedding") -> None:
        self.rows, self.dimension = vectors.count(), check_dimension(vectors, column)
        self.kind, self.id_column, self.column = index_kind(self.rows, kind), id_column, column
        self.vectors, self.centers = build_ivf(vectors, id_column, column) if self.kind == "ivf" else (vectors, None)

    def search(self, queries: DataFrame, k: int = 5, nprobe: int = 1) -> DataFrame:
        if self.kind == "flat":
            return search(queries, self.vectors, k, self.id_column, self.column)
        return search_ivf(queries, self.vectors, self.centers, k, nprobe, self.id_column, self.column)

    def stats(self) -> DataFrame:
        """One row (kind, n_vectors, dimension, cells)."""
        cells = 0 if self.centers is None else len(self.centers)
        return self.vectors.sparkSession.createDataFrame([(self.kind, self.rows, self.dimension, cells)], "kind string, n_vectors long, dimension int, cells int")


def entry_at(corpus: DataFrame, position: int, order: str = "row_id") -> DataFrame:
    """The row at a position from 0 on in the order of a unique key; a position out of bounds is a ValueError."""
    n = corpus.count()
    if not 0 <= position < n:
        raise ValueError(f"position {position} is not within 0 to {n - 1}")
    from tabletloom.operators.submit import with_positions

    return with_positions(corpus, order).where(F.col("pos") == position).drop("pos")


def with_corpus(hits: DataFrame, corpus: DataFrame, id_column: str = "row_id") -> DataFrame:
    """The hits with their row of the corpus; hits without one are dropped."""
    return hits.join(corpus.select(F.col(id_column).alias("id"), "transliteration", "translation"), "id")


def check_sizes(corpus: DataFrame, vectors: DataFrame) -> None:
    a, b = corpus.count(), vectors.count()
    if a != b:
        raise ValueError(f"corpus has {a} rows, the index {b}")
