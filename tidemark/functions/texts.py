"""Column functions for sizes, tags, labels and character differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_size(text: Column) -> Column:
    """Bytes of sizes such as 10MB, 1_000, 2.5g: 1024-based suffixes, underscores ignored, truncated."""
    clean = F.upper(F.regexp_replace(F.trim(text), "_", ""))
    number = F.regexp_extract(clean, r"^([0-9]*\.?[0-9]+)\s*([KMGT]?)I?B?$", 1)
    unit = F.regexp_extract(clean, r"^([0-9]*\.?[0-9]+)\s*([KMGT]?)I?B?$", 2)
    scale = F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).when(unit == "T", 1024.0**4).otherwise(1.0)
    return F.floor(F.nullif(number, F.lit("")).cast("double") * scale)


def human_bytes(n: Column) -> Column:
    """1024-based, one decimal; whole bytes below that."""
    out = None
    for power, name in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        shown = F.concat(F.format_string("%.1f", F.bround(n / 1024.0**power, 1)), F.lit(name))
        out = F.when(n >= 1024**power, shown) if out is None else out.when(n >= 1024**power, shown)
    return out.otherwise(F.concat(F.format_string("%.1f", n.cast("double")), F.lit("B")))


def tokenizer_tag(name: Column) -> Column:
    """The family and version where the name has one, else a slug of its last part."""
    base = F.lower(F.element_at(F.split(F.regexp_replace(name, "/+$", ""), "/"), -1))
    family = F.regexp_extract(base, r"^(qwen[0-9.]+)", 1)
    slug = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9.]+", "-"), "^-+|-+$", "")
    return F.when(family != "", family).otherwise(slug)


def char_label(c: Column) -> Column:
    """U+XXXX and the character itself, if it can be printed."""
    code = F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))
    return F.when(c.rlike(r"^[\p{L}\p{M}\p{N}\p{P}\p{S} ]$"), F.concat(code, F.lit(" '"), c, F.lit("'"))).otherwise(code)


def substitutions(df: DataFrame, a: str, b: str) -> DataFrame:
    """old, new, n: characters that differ place by place between two columns of like length."""
    same = df.where(F.char_length(a) == F.char_length(b)).where(F.col(a) != F.col(b))
    pairs = F.arrays_zip(F.split(F.col(a), "").alias("x"), F.split(F.col(b), "").alias("y"))
    return same.select(F.explode(F.filter(pairs, lambda p: p["x"] != p["y"])).alias("p")).groupBy(F.col("p.x").alias("old"), F.col("p.y").alias("new")).agg(F.count("*").alias("n"))


def multiset_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """char, removed, added: by how much the columns' character counts differ."""
    def counts(c: str, name: str) -> DataFrame:
        return df.select(F.explode(F.filter(F.split(F.col(c), ""), lambda x: x != "")).alias("char")).groupBy("char").agg(F.count("*").alias(name))

    both = counts(a, "na").join(counts(b, "nb"), "char", "full_outer").select("char", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    zero = F.lit(0).cast("bigint")
    return both.select("char", F.greatest(F.col("na") - F.col("nb"), zero).alias("removed"), F.greatest(F.col("nb") - F.col("na"), zero).alias("added")).where("removed > 0 or added > 0")


def changed_chunks(df: DataFrame, a: str, b: str, width: int = 2048) -> DataFrame:
    """Adds n_chunks and n_changed: character slices that differ between two columns."""
    n = F.greatest(F.ceil(F.greatest(F.char_length(a), F.char_length(b)) / width).cast("int"), F.lit(0))
    cut = lambda c, i: F.substring(F.col(c), i * width + 1, F.lit(width))
    where = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("n_chunks", n.cast("bigint")).withColumn("n_changed", F.size(F.filter(where, lambda i: cut(a, i) != cut(b, i))).cast("bigint"))


def varint_length(n: Column) -> Column:
    """Bytes of a non-negative integer in groups of seven bits."""
    bits = F.length(F.bin(n))
    return F.greatest(F.lit(1), F.ceil(bits / 7)).cast("bigint")


def first_present(fields: list[str]) -> Column:
    """Chosen fields joined by newlines, without null or empty ones."""
    return F.array_join(F.filter(F.array(*(F.col(f).cast("string") for f in fields)), lambda x: x.isNotNull() & (x != "")), "\n")


def strict_concat(fields: list[str]) -> Column:
    """All fields without a separator; a null one is an error."""
    checked = [F.coalesce(F.col(f).cast("string"), F.raise_error(F.lit(f"missing {f}")).cast("string")) for f in fields]
    return F.concat(*checked)


def widest_text_column(df: DataFrame) -> DataFrame:
    """column, chars: the string column with most characters."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    sums = df.agg(*(F.coalesce(F.sum(F.char_length(n)), F.lit(0)).alias(n) for n in names))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.col(n).cast("bigint").alias("chars")) for n in names))).alias("x")).select("x.*")
    return rows.orderBy(F.desc("chars"), "column").limit(1)


def normalised(df: DataFrame, column: str, step) -> DataFrame:
    """Adds normalised and passes: step applied once, and once more where that changes the text again, but no more."""
    once, twice = step(F.col(column)), step(F.col("_once"))
    rows = df.withColumn("_once", once).withColumn("normalised", twice)
    return rows.withColumn("passes", F.when(F.col("_once").eqNullSafe(F.col("normalised")), 1).otherwise(2)).drop("_once")


def pending(wanted: DataFrame, done: DataFrame, *, key: str = "dataset", force: bool = False) -> DataFrame:
    """What has no summary yet; with force everything."""
    return wanted if force else wanted.join(done.select(key), key, "left_anti")


def top_substitutions(df: DataFrame, a: str, b: str, *, by: str, top: int) -> DataFrame:
    """by, old, new, n: the commonest place-by-place replacements of each group."""
    pairs = F.arrays_zip(F.split(F.col(a), "").alias("x"), F.split(F.col(b), "").alias("y"))
    found = df.where((F.char_length(a) == F.char_length(b)) & (F.col(a) != F.col(b))).select(by, F.explode(F.filter(pairs, lambda p: p["x"] != p["y"])).alias("p"))
    n = found.groupBy(by, F.col("p.x").alias("old"), F.col("p.y").alias("new")).agg(F.count("*").alias("n"))
    over = Window.partitionBy(by).orderBy(F.desc("n"), "old", "new")  # a row for each pair of characters
    return n.withColumn("_r", F.row_number().over(over)).where(F.col("_r") <= top).drop("_r")


#: The least probability that a normalised distribution gives.
TINY = 1e-30


def pdf_normalised(df: DataFrame, mass: str, *keys: str) -> DataFrame:
    """Adds p: mass over its sum, at least TINY, brought to a sum of one; without any mass an error. Keys have few rows each."""
    over = Window.partitionBy(*keys)
    total = F.sum(F.col(mass).cast("double")).over(over)
    checked = F.when(total > 0, total).otherwise(F.raise_error(F.lit("a distribution without mass")).cast("double"))
    rows = df.withColumn("_w", F.greatest(F.col(mass) / checked, F.lit(TINY)))
    return rows.withColumn("p", F.col("_w") / F.sum("_w").over(over)).drop("_w")


def padded_bits(bits: Column) -> Column:
    """Bits with zeros before them, to whole bytes."""
    return F.lpad(bits, (8 * F.ceil(F.length(bits) / 8)).cast("int"), F.lit("0"))


def bits_to_bytes(bits: Column) -> Column:
    """Bytes of padded bits."""
    eights = F.transform(F.sequence(F.lit(0), (F.length(bits) / 8).cast("int") - 1), lambda i: F.lpad(F.conv(F.substring(bits, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.unhex(F.array_join(F.when(F.length(bits) > 0, eights).otherwise(F.array().cast("array<string>")), ""))


def bytes_to_bits(data: Column) -> Column:
    """Eight bits of each byte."""
    digits = F.filter(F.split(F.hex(data), "(?<=\\G..)"), lambda x: x != "")
    return F.array_join(F.transform(digits, lambda x: F.lpad(F.conv(x, 16, 2), 8, "0")), "")
