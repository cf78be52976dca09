"""Session, table access and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per context, so that they need no path of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_finspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = os.path.join(sc._temp_dir, "finspark_package.zip")  # the folder Spark's driver hands files out from
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(to)
    sc._finspark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Filters and column lists given later reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a folder of our own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"finspark-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The same rows, written as Parquet to the checkpoint folder so that later reads survive lost executors.

    Columnar and compressed, so later steps read only the columns they use. The tables are removed when the
    driver's process ends.
    """
    spark = df.sparkSession
    to = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(to)
    _remove_at_end(spark, to)
    return spark.read.schema(df.schema).parquet(to)


_WRITTEN: dict[int, list[str]] = {}


def _remove_at_end(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if id(sc) not in _WRITTEN:
        _WRITTEN[id(sc)] = []
        atexit.register(remove_cuts, spark)
    _WRITTEN[id(sc)].append(path)


def remove_cuts(spark: SparkSession) -> None:
    """Removes what ``cut`` wrote in this context; results that were not read yet are lost."""
    sc = spark.sparkContext
    paths = _WRITTEN.get(id(sc), [])
    while paths:
        try:
            at = sc._jvm.org.apache.hadoop.fs.Path(paths.pop())
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the context may be gone
            return


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` with this package on the workers, whether or not ``table`` was used before."""
    ship(df.sparkSession)
    return df.mapInPandas(function, schema)
