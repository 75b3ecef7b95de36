"""Readers: text shards, JSON lines, directories of media, archives' members, run results, synthetic signals."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "tiff")
AUDIO = ("wav", "flac", "mp3", "ogg")

GK = "phase: int, curr: struct<tokens: long, bytes: long, bits_pre: double, bits_post: double, bits_base: double>, next: struct<tokens: long, bytes: long, bits_pre: double, bits_post: double>"
BRANCH = "phase: int, ref_lr: double, curr: struct<tokens: long, bytes: long, bits_base: double>, next: struct<tokens: long, bytes: long, bits_base: double>, candidates: array<struct<lr: double, curr_bits: double, next_bits: double, nonfinite: boolean>>"
ADJACENCY = "phase: int, boundary_k: int, domain: string, horizons: array<int>, future_static_bits: double, control_starts: array<int>, curr_pre_bits: double, curr_post_bits: double, adj_pre: array<double>, adj_post: array<double>, ctrl_pre: array<double>, ctrl_post: array<double>"
MODES = f"array<struct<mode: string, orig: long, comp: long, ratio: double, bpb: double, bpsp: double, comp_s: double, decomp_s: double, chunk_lengths: array<long>, chunk_bits: array<long>, gk: array<struct<{GK}>>, branch: array<struct<{BRANCH}>>, adjacency: array<struct<{ADJACENCY}>>>>"
RESULT = f"args map<string, string>, config map<string, string>, results {MODES}, _corrupt_record string"

_registry: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def loader(name: str):
    """Registers a loader for paths whose last part holds the name."""

    def add(f):
        _registry.setdefault(name, f)
        return f

    return add


def _plain(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].lower().replace("-", "_")


def load(spark: SparkSession, path: str) -> DataFrame:
    """By the first registered loader that the path's last part names."""
    for name, f in _registry.items():
        if name in _plain(path):
            return f(spark, path)
    raise ValueError(f"no loader for {path}; there are: {', '.join(sorted(_registry))}")


def matching_loader(paths: DataFrame, names: list[str]) -> DataFrame:
    """path, loader: the first of names within the path's last part (null: none)."""
    base = F.lower(F.regexp_replace(F.element_at(F.split(F.regexp_replace("path", "/+$", ""), "/"), -1), "-", "_"))
    return paths.select("path", F.coalesce(*(F.when(F.contains(base, F.lit(n)), F.lit(n)) for n in names)).alias("loader"))


def text_shards(spark: SparkSession, path: str, *, cap: int | None = None, glob: str = "part-*.txt") -> DataFrame:
    """stream, seq, data, start of a directory's shards in order of name, up to cap bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    w = Window.orderBy("path")  # one row a shard
    rows = files.select(F.lit(path).alias("stream"), "path", F.col("content").alias("data"), "length")
    rows = rows.withColumns({"seq": (F.row_number().over(w) - 1).cast("bigint"), "start": F.sum("length").over(w) - F.col("length")})
    if cap is not None:
        rows = rows.where(F.col("start") < cap).withColumn("data", F.col("data").substr(F.lit(1), F.least(F.col("length"), F.lit(cap) - F.col("start")).cast("int")))
    return rows.select("stream", "seq", "data", "start")


def valid_text(data: Column) -> Column:
    """UTF-8 text of bytes, without what is not valid."""
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), "�", "")


def json_lines(spark: SparkSession, path: str, *, field: str = "text", skip: int = 0, n: int | None = None) -> DataFrame:
    """seq, text: skip counts lines that are not blank, before parsing; bad JSON is dropped; n counts texts that are not empty."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")).where("trim(value) <> ''")
    order = Window.orderBy("at")
    if skip:
        lines = lines.withColumn("_r", F.row_number().over(order)).where(F.col("_r") > skip)
    rows = lines.select("at", F.get_json_object("value", f"$.{field}").alias("text")).where("text is not null and text <> ''")
    if n is not None:
        rows = rows.orderBy("at").limit(n)
    return rows.select(F.col("at").alias("seq"), "text")


def records(df: DataFrame, order: str, *, field: str = "text", skip: int = 0, n: int | None = None) -> DataFrame:
    """skip, then n records, then without empty texts: fewer than n may remain."""
    part = df.orderBy(order)
    if n is not None or skip:
        part = part.offset(skip) if n is None else part.offset(skip).limit(n)
    return part.where(F.col(field).isNotNull() & (F.col(field) != ""))


def media(spark: SparkSession, path: str, kinds: tuple[str, ...], *, n: int | None = None, recursive: bool = False) -> DataFrame:
    """path, data of files with one of the extensions, in either case, by name; none is an error."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    rows = r.load(path).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*kinds)).select("path", F.col("content").alias("data"))
    if rows.isEmpty():
        raise FileNotFoundError(f"{path} has no file of {', '.join(kinds)}")
    rows = rows.orderBy("path")
    return rows.limit(n) if n is not None else rows


def nested_audio(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """bytes, path of a Parquet file's audio column."""
    rows = spark.read.parquet(path).select("audio.*")
    return rows.limit(n) if n is not None else rows


def members(spark: SparkSession, path: str, *, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """archive, name, data of zip and tar members; resource forks are skipped."""

    def skip(name: str) -> bool:
        return "__MACOSX" in name or name.rsplit("/", 1)[-1].startswith("._") or bool(suffixes) and not name.lower().endswith(suffixes)

    def run(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                raw = io.BytesIO(content)
                if zipfile.is_zipfile(raw):
                    with zipfile.ZipFile(raw) as z:
                        rows += [(file, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and not skip(i.filename)]
                else:
                    raw.seek(0)
                    with tarfile.open(fileobj=raw) as t:
                        rows += [(file, m.name, t.extractfile(m).read()) for m in t if m.isfile() and not skip(m.name)]
            yield pd.DataFrame(rows, columns=["archive", "name", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, data binary")


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """run_id, args, config, results of result files; run_id is the folder's name where the file is result.json."""
    rows = spark.read.schema(RESULT).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    stem = F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1)
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    return rows.select(F.when(stem == "result", folder).otherwise(stem).alias("run_id"), "args", "config", "results", F.col("_corrupt_record").alias("corrupt"))


def invalid_results(results: DataFrame) -> DataFrame:
    """run_id, problem of results that no analysis can use."""
    modes = F.size(F.coalesce("results", F.array().cast(MODES)))
    bad = F.when(F.col("corrupt").isNotNull(), "not JSON").when(modes == 0, "no results").when(F.exists("results", lambda r: r["chunk_bits"].isNull()), "no record of chunks").when(F.exists("results", lambda r: F.size(r["chunk_bits"]) != F.size(r["chunk_lengths"])), "records of different lengths").when(F.size(F.array_distinct(F.transform("results", lambda r: r["chunk_lengths"]))) > 1, "layouts differ between modes")
    return results.select("run_id", bad.alias("problem")).where("problem is not null")


def chunk_records(results: DataFrame) -> DataFrame:
    """run, mode, chunk, length, bits."""
    r = results.select(F.col("run_id").alias("run"), F.explode("results").alias("r"))
    z = r.select("run", "r.mode", F.posexplode(F.arrays_zip(F.col("r.chunk_lengths").alias("length"), F.col("r.chunk_bits").alias("bits"))).alias("chunk", "x"))
    return z.select("run", "mode", "chunk", "x.length", "x.bits")


def gk_boundaries(results: DataFrame) -> DataFrame:
    """Boundaries of results that measured transfer, as operators.gk takes them."""
    g = results.select(F.col("run_id").alias("run"), F.explode("results").alias("r")).select("run", F.explode("r.gk").alias("g"))
    return g.select("run", F.col("g.phase").alias("phase"), F.col("g.curr.tokens").alias("curr_tokens"), F.col("g.curr.bytes").alias("curr_bytes"), F.col("g.curr.bits_pre").alias("curr_pre"), F.col("g.curr.bits_post").alias("curr_post"), F.col("g.curr.bits_base").alias("curr_base"), F.col("g.next.tokens").alias("next_tokens"), F.col("g.next.bytes").alias("next_bytes"), F.col("g.next.bits_pre").alias("next_pre"), F.col("g.next.bits_post").alias("next_post"))


def branch_candidates(results: DataFrame) -> DataFrame:
    """Candidates of results that branched, as operators.branch takes them."""
    g = results.select(F.col("run_id").alias("run"), F.explode("results").alias("r")).select("run", F.explode("r.branch").alias("b"))
    return g.select("run", F.col("b.phase").alias("phase"), F.col("b.next.bytes").alias("next_bytes"), F.posexplode("b.candidates").alias("pos", "c")).select("run", "phase", "next_bytes", "pos", "c.*")


def adjacency_records(results: DataFrame) -> DataFrame:
    """One row per boundary and horizon; a missing domain is 'stream'."""
    g = results.select(F.col("run_id").alias("run"), F.explode("results").alias("r")).select("run", F.explode("r.adjacency").alias("a"))
    z = F.arrays_zip(*(F.col(f"a.{c}").alias(c) for c in ("horizons", "adj_pre", "adj_post", "ctrl_pre", "ctrl_post")))
    return g.select("run", F.col("a.boundary_k").alias("k"), F.coalesce("a.domain", F.lit("stream")).alias("domain"), F.explode(z).alias("x")).select("run", "k", "domain", F.col("x.horizons").alias("h"), "x.adj_pre", "x.adj_post", "x.ctrl_pre", "x.ctrl_post")


def signal(spark: SparkSession, n: int, rate: int) -> DataFrame:
    """i, x: a mixture of tones of 220, 440 and 110 Hz."""
    wave = lambda a, f: a * F.sin(2 * F.pi() * f * F.col("i") / rate)
    return spark.range(n).select(F.col("id").alias("i")).select("i", (wave(0.5, 220) + wave(0.3, 440) + wave(0.2, 110)).alias("x"))


def ladder(endpoints: DataFrame, *, prefer_fast: bool) -> DataFrame:
    """attempt, endpoint, fast: every endpoint, the fast transport first where it is wanted, the plain one always last."""
    kinds = F.array(F.lit(True), F.lit(False)) if prefer_fast else F.array(F.lit(False))
    rows = endpoints.select("place", "endpoint", F.posexplode(kinds).alias("p", "fast"))
    return rows.select((F.row_number().over(Window.orderBy("place", "p")) - 1).cast("bigint").alias("attempt"), "endpoint", "fast")
