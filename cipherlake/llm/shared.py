"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests on one machine, a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="cipherlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. One of fewer splits than there are cores is small, and is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; files apart by a column if given. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    if not _WRITTEN:
        atexit.register(forget)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget() -> None:
    """Delete the written tables."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            return
