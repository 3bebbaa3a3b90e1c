"""Extension: the normaliser and the term counts over a stream of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabletloom.functions.features import proper_nouns
from tabletloom.functions.text import normalize


def read_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def normalized(stream: DataFrame, column: str = "transliteration") -> DataFrame:
    return stream.withColumn(column, normalize(column))


def name_counts(stream: DataFrame, column: str, time_column: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of names by event time; rows later than ``late`` are dropped."""
    names = stream.withWatermark(time_column, late).select(time_column, F.explode(proper_nouns(column)).alias("term"))
    return names.groupBy(F.window(time_column, window), "term").agg(F.count("*").alias("n"))
