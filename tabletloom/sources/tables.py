"""Tables, lists, settings and metrics: sources and sinks."""

from __future__ import annotations

import json
import logging
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the public pandas CSV reader takes for null.
PANDAS_NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, required: list[str] | None = None, pandas_na: bool = False) -> DataFrame:
    """A CSV file with a header; quoted fields may span lines. FileNotFoundError without the file, ValueError without a
    required column. With ``pandas_na`` the usual null words are null."""
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    if pandas_na:
        df = df.select(*(F.when(~F.col(f"`{f.name}`").isin(*PANDAS_NULLS), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields))
    return require_columns(df, required or [])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_table(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """Parquet, ORC, JSON lines or CSV, by the name's ending."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "csv":
        return read_csv(spark, path, required=required)
    df = spark.read.format({"json": "json", "jsonl": "json", "orc": "orc"}.get(kind, "parquet")).load(path)
    return require_columns(df, required or [])


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a text file, stripped, without blank lines and comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """``df`` with dense numbers in the order of its source."""
    from tabletloom.operators.submit import with_positions

    return with_positions(df, None).withColumnRenamed("pos", name)


def write_vectors(df: DataFrame, path: str, column: str = "embedding", cell: str | None = None) -> None:
    """Vectors as Parquet, by cell for an inverted file; other formats are a ValueError."""
    if path.rstrip("/").rpartition(".")[2] in ("npy", "pkl", "csv"):
        raise ValueError(f"vectors are written as Parquet, not as {path}")
    w = df.withColumn(column, F.col(column).cast("array<float>")).write.mode("overwrite")
    (w.partitionBy(cell) if cell else w).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_index(index: DataFrame, centers: Any, path: str, column: str = "embedding") -> None:
    """An inverted file: the vectors by cell, and the centroids beside them, so that it can be searched after a restart."""
    write_vectors(index, f"{path}/vectors", column, "cell")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    index.sparkSession.createDataFrame(rows, "cell int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, Any]:
    """(vectors with their cell, centroids in the order of cells) of ``write_index``."""
    import numpy as np

    rows = spark.read.parquet(f"{path}/centers").orderBy("cell").collect()  # one a cell
    return read_vectors(spark, f"{path}/vectors"), np.array([r["center"] for r in rows])


def write_json(value: Any, path: str) -> None:
    ensure_dir(str(Path(path).parent))
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def read_json(path: str) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_yaml(path: str) -> Any:
    try:
        import yaml
    except ImportError as e:
        raise ImportError("settings in YAML need the yaml package") from e
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def write_metrics(df: DataFrame, path: str) -> None:
    """A one-row table as a JSON object."""
    row = df.limit(1).collect()
    write_json(row[0].asDict(recursive=True) if row else {}, path)


def write_frequencies(df: DataFrame, path: str) -> None:
    """(term, n) as JSON lines, by falling count."""
    df.orderBy(F.desc("n"), "term").write.mode("overwrite").json(path)


def ensure_dir(path: str) -> str:
    Path(path).mkdir(parents=True, exist_ok=True)
    return path


def setup_logging(level: str = "INFO") -> logging.Logger:
    logging.basicConfig(level=level, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    return logging.getLogger("tabletloom")
