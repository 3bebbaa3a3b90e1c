"""Spark session and lineage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tabletloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect: UTC, adaptive execution, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names in ``spark.checkpoint.dir``, or
    (only where nothing is set and driver and executors are one process) a folder of our own. A cluster without a shared
    folder is a ValueError."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = "file://" + os.path.join(tempfile.gettempdir(), f"tabletloom-checkpoints-{os.getpid()}")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared checkpoint folder; survives the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship(spark: SparkSession) -> None:
    """Give the executors this package (once per application), so that functions over Arrow batches can import it."""
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    name = "tabletloom_package.zip"
    if any(str(p).endswith(name) for p in getattr(sc, "_python_includes", [])):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    target = Path(tempfile.mkdtemp(prefix="tabletloom-")) / name  # on the driver only: Spark serves it from there
    target.write_bytes(data.getvalue())
    sc.addPyFile(str(target))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, should a small file give fewer: for work that costs much more than
    moving the rows. What comes out of a shuffle, which may have been made few partitions, gets the session's number of them."""
    spark = df.sparkSession
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # counting its partitions would run it
        return df.repartition(shuffle_partitions(spark))
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
