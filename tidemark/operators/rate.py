"""Rate curves: per-chunk rates of static and online coding, their difference, and when it turns positive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.streams import running_before


def rate(bits: Column, length: Column) -> Column:
    return F.coalesce(F.try_divide(bits, length), F.lit(0.0))


def rolling(df: DataFrame, value: str, window: int, *, run: str = "run", order: str = "chunk", out: str = "rolling") -> DataFrame:
    """Trailing mean of `window` rows, of fewer at the start."""
    if window < 1:
        raise ValueError("the window must be at least 1")
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(run).orderBy(order).rowsBetween(1 - window, 0)))


def cumulative_saving(df: DataFrame, *, run: str = "run", order: str = "chunk") -> DataFrame:
    """Adds saved: static minus online bits so far, each in whole millionths, summed in two levels; order is an integer."""
    own = F.round((F.col("static") - F.col("online")) * 1e6).cast("bigint")
    return running_before(df, own, keys=(run,), order=order, out="_before").withColumn("saved", (F.col("_before") + own) / 1e6).drop("_before")


def break_even(df: DataFrame, *, run: str = "run", order: str = "chunk") -> DataFrame:
    """run, first: the first place with a positive cumulative saving (null: never)."""
    return cumulative_saving(df, run=run, order=order).groupBy(run).agg(F.min(F.when(F.col("saved") > 0, F.col(order))).alias("first"))


def check_layout(long: DataFrame) -> DataFrame:
    """run, same_layout of rows (run, mode, chunk, length): static and online must cut the stream alike."""
    a = long.where("mode = 'static'").select("run", "chunk", F.col("length").alias("ls"))
    b = long.where("mode = 'online'").select("run", "chunk", F.col("length").alias("lo"))
    return a.join(b, ["run", "chunk"], "full_outer").groupBy("run").agg(F.bool_and(F.col("ls").eqNullSafe(F.col("lo"))).alias("same_layout"))


def summary(df: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """run, length, static and online payload bytes, rates, delta, percent, saved; archive: run, mode, bytes for header sizes."""
    s, o = F.sum("static"), F.sum("online")
    out = df.groupBy("run").agg(
        F.sum("length").alias("length"), F.floor(s / 8).alias("static_payload"), F.floor(o / 8).alias("online_payload"),
        rate(s, F.sum("length")).alias("static_rate"), rate(o, F.sum("length")).alias("online_rate"), (s - o).alias("saved"),
        F.when(s == 0, F.lit(0.0)).otherwise((s - o) / s * 100).alias("delta_pct"),
    )
    if archive is None:
        return out
    sizes = archive.groupBy("run").pivot("mode", ["static", "online"]).agg(F.sum("bytes"))
    sized = sizes.select("run", F.col("static").alias("_s"), F.col("online").alias("_o"))
    return out.join(sized, "run").withColumns({"static_header": F.col("_s") - F.col("static_payload"), "online_header": F.col("_o") - F.col("online_payload")}).drop("_s", "_o")
