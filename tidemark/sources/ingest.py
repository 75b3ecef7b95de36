"""Ingest of a catalogue of local data sets: each one is isolated, and a status table tells what became of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import sinks

#: Formats that are read as they are: kind -> (Spark format, options).
KINDS: dict[str, tuple[str, dict[str, str]]] = {
    "parquet": ("parquet", {}),
    "csv": ("csv", {"header": "true"}),
    "jsonl": ("json", {}),
    "text": ("text", {}),
    "binary": ("binaryFile", {}),
}


@dataclass(frozen=True)
class DataSet:
    """Where a data set lies, of what kind it is, and what is done to its rows."""

    path: str
    kind: str
    shape: Callable[[DataFrame], DataFrame] = lambda df: df

    def read(self, spark: SparkSession) -> DataFrame:
        if self.kind not in KINDS:
            raise ValueError(f"no reader of kind {self.kind}; there are: {', '.join(sorted(KINDS))}")
        name, options = KINDS[self.kind]
        return self.shape(spark.read.format(name).options(**options).load(self.path))


def ingest(spark: SparkSession, catalogue: dict[str, DataSet], names: Iterable[str], *, out: str | None = None, done: set[str] | None = None, force: bool = False) -> DataFrame:
    """name, kind, status, rows, note of each wanted name, in their order.

    A name that the catalogue lacks fails; one that is done already is skipped unless forced; an
    error of one does not stop the others.  With `out`, rows are written below it, guarded.
    """
    rows = []
    for place, name in enumerate(names):
        item = catalogue.get(name)
        if item is None:
            rows.append((place, name, None, "failed", None, "not in the catalogue"))
        elif not force and name in (done or set()):
            rows.append((place, name, item.kind, "skipped", None, "there already"))
        else:
            try:
                df = item.read(spark)
                if out is not None:
                    sinks.guarded(df, f"{out}/{name}", force=force)
                    df = spark.read.parquet(f"{out}/{name}")
                rows.append((place, name, item.kind, "ok", df.count(), None))
            except Exception as e:  # one data set's error is a row
                rows.append((place, name, item.kind, "failed", None, type(e).__name__))
    return spark.createDataFrame(rows, "place int, name string, kind string, status string, rows long, note string")


def exit_code(status: DataFrame) -> int:
    """1 if anything failed."""
    return int(not status.where("status = 'failed'").isEmpty())


def overview(parts: dict[str, DataFrame]) -> DataFrame:
    """modality, status, n over the status tables of several modalities."""
    out = None
    for modality, part in parts.items():
        rows = part.select(F.lit(modality).alias("modality"), "status")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("modality", "status").agg(F.count("*").alias("n"))


def sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file beside a data set; none where it is missing or bad."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.select("r.*").where("_bad is null").drop("_bad")
