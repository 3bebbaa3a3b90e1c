"""Submissions: predictions joined to ids by position, and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletloom.session import cut
from tabletloom.sources.tables import require_columns, write_csv


def with_positions(df: DataFrame, order: str | None) -> DataFrame:
    """``df`` with ``pos``, the rank of its rows by a unique key (or, without one, in the order of its source), from counts of
    its partitions."""
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
    ranged = cut(sorted_.withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()))
    counts = {r["_p"]: (r["c"], r["m"]) for r in ranged.groupBy("_p").agg(F.count("*").alias("c"), F.min("_n").alias("m")).collect()}
    rows, before = [], 0
    for p in sorted(counts):
        rows.append((p, before - counts[p][1]))
        before += counts[p][0]
    shift = spark.createDataFrame(rows or [(0, 0)], "_p int, _s long")
    return ranged.join(F.broadcast(shift), "_p").withColumn("pos", F.col("_n") + F.col("_s")).drop("_p", "_n", "_s")


def zip_predictions(test: DataFrame, predictions: DataFrame, test_order: str = "id", order: str = "row_id") -> DataFrame:
    """(id, translation): the i-th prediction for the i-th test row; ValueError if the numbers differ. Null is empty."""
    require_columns(test, ["id"])
    require_columns(predictions, ["prediction"])
    a, b = test.count(), predictions.count()
    if a != b:
        raise ValueError(f"{a} test rows, {b} predictions")
    x = with_positions(test.select(test_order, *([] if test_order == "id" else ["id"])), test_order)
    y = with_positions(predictions.select(order, "prediction"), order)
    return x.join(y, "pos").select("id", F.coalesce("prediction", F.lit("")).alias("translation"))


def validate_submission(df: DataFrame) -> DataFrame:
    """One row (rows, valid, null_ids, null_texts, non_integer_ids, missing_columns): null ids and missing columns make it
    invalid, the others are warnings."""
    missing = [c for c in ("id", "translation") if c not in df.columns]
    if missing:
        return df.agg(F.count("*").alias("n_rows"), F.lit(False).alias("valid"), F.lit(0).cast("long").alias("null_ids"), F.lit(0).cast("long").alias("null_texts"), F.lit(0).cast("long").alias("non_integer_ids"), F.lit(",".join(missing)).alias("missing_columns"))
    whole = F.col("id").cast("string").rlike(r"^[+-]?\d+$")
    return df.agg(
        F.count("*").alias("n_rows"), (F.count_if(F.col("id").isNull()) == 0).alias("valid"), F.count_if(F.col("id").isNull()).alias("null_ids"),
        F.count_if(F.col("translation").isNull()).alias("null_texts"), F.count_if(F.col("id").isNotNull() & ~whole).alias("non_integer_ids"), F.lit("").alias("missing_columns"),
    )


def write_submission(test: DataFrame, predictions: DataFrame, path: str, test_order: str = "id", order: str = "row_id") -> DataFrame:
    """Zip, validate and write (id, translation) as CSV; the validation's row is returned, and an invalid submission is a
    ValueError and not written."""
    out = cut(zip_predictions(test, predictions, test_order, order))
    found = cut(validate_submission(out))
    row = found.first()
    if not row["valid"]:
        raise ValueError(f"invalid submission: {row.asDict()}")
    write_csv(out, path)
    return found
