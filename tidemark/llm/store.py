"""Where intermediate tables live, and small helpers that the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (tests on one machine), a folder of this process."""
    return (spark.conf.get("spark.checkpoint.dir", None) or _own_folder()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that one operator needs until its own result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, new_path(spark, "scratch")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Nothing that is read later may depend on these tables."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int, *, share: int = 256) -> DataFrame:
    """rows with the columns of facts, which has at most one row for each key (none: nulls).

    size is a column of facts: how many rows have the key; total is about all of them.
    Keys with more than one in `share` of all rows are at most `share`, or what total
    falls short by: they are broadcast, so that no task gets all rows of a hot key.
    """
    hot = facts.where(F.col(size) > F.lit(max(1, total // share)))
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    calm = marked.where(f"_hot is null and `{key}` is not null").drop("_hot").join(facts, key, "left")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema.fields if f.name != key]
    out = marked.where("_hot").drop("_hot").join(F.broadcast(hot), key).unionByName(calm)
    return out.unionByName(rows.where(F.col(key).isNull()).select(*rows.columns, *none))


class Passed:
    """Columns that a row-wise operator hands on as they are; the text is not sent to Python twice."""

    def __init__(self, docs: DataFrame, names: tuple[str, ...], text_col: str):
        kinds = dict(docs.dtypes)
        self.extra = [c for c in names if c != text_col]
        self.schema = "".join(f", `{c}` {kinds[c]}" for c in names)
        self.names, self.place = list(names), {c: 2 + k for k, c in enumerate(self.extra)} | {text_col: 1}

    def of(self, batch, lo: int, n: int) -> list:
        """Slices of a batch whose columns are id, text and the extra ones."""
        return [batch.column(self.place[c]).slice(lo, n) for c in self.names]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
