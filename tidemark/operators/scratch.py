"""Tables that a query needs more than once: written to the shared folder and read again, so that they are computed once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def folder(spark: SparkSession) -> str:
    """Where a session's tables lie: below spark.checkpoint.dir; where that is unset, as in tests on one machine, a folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder()
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df from a table of its own: survives lost executors, and no plan computes it twice. drop() removes a session's tables."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession) -> None:
    """Removes the session's tables; what is still to be read of them must have been read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
