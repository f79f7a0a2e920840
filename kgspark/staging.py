"""Tables written once to the folder that all machines share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see.

    Only where that setting is missing, as in tests on one machine, a temporary folder is used.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        top = f"file://{tempfile.mkdtemp(prefix='kgspark-')}"
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/kgspark-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def staged(df: DataFrame, **options: object) -> DataFrame:
    """Write df once and read it back: cuts the lineage, and a lost executor loses nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def unstaged(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more; other tables, and those deleted before, are left alone."""
    for df in tables:
        if df is not None and (path := _PATHS.pop(df, None)):
            fs, p = _file(df.sparkSession, path)
            fs.delete(p, True)


def resumed(df_or_make, spark: SparkSession, path: str) -> DataFrame:
    """The table at path if an earlier run finished writing it, else df (or what a function makes) written there first."""
    fs, p = _file(spark, f"{path}/_SUCCESS")
    if not fs.exists(p):
        df = df_or_make() if callable(df_or_make) else df_or_make
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
