"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_TEMPORARY: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet under spark.checkpoint.dir, read back; on one machine without that setting, under a temporary folder."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="cipherlake-")
        spark.conf.set("spark.checkpoint.dir", where)
        _TEMPORARY.append(where)
        atexit.register(lambda: [shutil.rmtree(p, ignore_errors=True) for p in _TEMPORARY])
    path = f"{where.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
