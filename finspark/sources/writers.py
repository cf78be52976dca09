"""Sinks: immutable runs with a manifest of hashes, guarded CSV, and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(df: DataFrame, root: str, run_id: str, compressed: bool = True) -> str:
    """One immutable run as JSON lines; a run that exists is not overwritten."""
    path = f"{root}/runs/run_id={run_id}"
    df.write.mode("errorifexists").option("compression", "gzip" if compressed else "none").json(path)
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, length, sha256 of every data file of a run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """file, state (missing, unknown, changed) of what differs from the manifest; empty when all is as written."""
    now = manifest(spark, path).select("file", F.col("sha256").alias("now"))
    j = expected.select("file", "sha256").join(now, "file", "full")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("now") != F.col("sha256"), "changed")
    return j.select("file", state.alias("state")).where("state is not null")


def guarded(df: DataFrame) -> DataFrame:
    """String columns safe to open in a spreadsheet: a leading =, +, - or @ gets a quote before it."""
    safe = {c: F.when(F.col(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)) for c, t in df.dtypes if t == "string"}
    return df.withColumns(safe) if safe else df


def append_log(df: DataFrame, root: str, stream: str) -> None:
    """Rows of one of the log streams, appended."""
    df.withColumn("stream", F.lit(stream)).write.mode("append").partitionBy("stream").parquet(f"{root}/log")
