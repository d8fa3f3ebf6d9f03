"""Reading, caching, checking and writing tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import nan_to_null
from .specs import TableSpec

POSITIVE_RATE_TOLERANCE = 5e-4
#: Bytes of a file that an executor reads whole; bytes of a longer one read at once, and such files read side by side.
WHOLE_FILE, STREAM_BUFFER, PARALLEL_STREAMS = 64 << 20, 1 << 20, 4


# ----------------------------------------------------------------------------------------------
# Reading
# ----------------------------------------------------------------------------------------------
def read_csv(spark: SparkSession, path: str, schema: T.StructType, formats: dict[str, str] | None = None) -> DataFrame:
    """A CSV table with a fixed schema; a malformed line stops the job.

    Columns in ``formats`` are read as text and parsed with their own pattern.
    """
    formats = formats or {}
    raw = T.StructType([T.StructField(f.name, T.StringType() if f.name in formats else f.dataType, f.nullable) for f in schema.fields])
    df = spark.read.schema(raw).option("header", True).option("mode", "FAILFAST").csv(path)
    return nan_to_null(df.select(*[
        parse_time(F.col(f.name), formats[f.name], f.dataType).alias(f.name) if f.name in formats else F.col(f.name) for f in schema.fields]))


def parse_time(text: Column, pattern: str, dtype: T.DataType) -> Column:
    """Text to date or timestamp by an explicit pattern; NULL where it does not fit."""
    parsed = F.try_to_timestamp(text, F.lit(pattern))
    return parsed.cast(dtype)


def parse_failures(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Per column: rows with text and rows whose text does not fit the pattern."""
    cells = [
        F.struct(
            F.lit(n).alias("column"), F.count(n).alias("n"),
            F.count_if(F.col(n).isNotNull() & F.try_to_timestamp(F.col(n), F.lit(p)).isNull()).alias("n_bad")).alias(n)
        for n, p in patterns.items()]
    return df.agg(*cells).select(F.explode(F.array(*patterns)).alias("x")).select("x.*")


def with_file_order(df: DataFrame, name: str = "seq") -> DataFrame:
    """Attach the row's place in its file, the tie-break of tables without a unique order.

    Rows of different files are told apart by the file name, which comes first.
    """
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))


# ----------------------------------------------------------------------------------------------
# Cache by content
# ----------------------------------------------------------------------------------------------
def source_digest(spark: SparkSession, path: str) -> str:
    """Digest of the names, lengths and modification times of the files under a path.

    Reads the file listing only; the digest changes whenever a file is written again.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = files.select(F.xxhash64("path", "length", "modificationTime").alias("h")).agg(
        F.bit_xor("h").alias("x"), F.count(F.lit(1)).alias("n")).collect()[0]
    return hashlib.sha256(f"{parts['x']}:{parts['n']}".encode()).hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, key: str, source: str, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The parquet copy of a source, built on first use; a finished copy is marked by _SUCCESS."""
    path = f"{folder}/{key}__{source_digest(spark, source)}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _stream_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any length, read in order through the file system Spark reads it with, a buffer at a time."""
    jvm = spark._jvm
    digest, where = jvm.java.security.MessageDigest.getInstance("SHA-256"), jvm.org.apache.hadoop.fs.Path(path)
    source = jvm.java.security.DigestInputStream(where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, jvm.java.io.OutputStream.nullOutputStream(), STREAM_BUFFER, True)
    return bytes(digest.digest()).hex()


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and length of every file under a path, whatever its length.

    Executors hold a file whole, so they digest files up to ``WHOLE_FILE`` bytes. SHA-256 is a chain that no two tasks can share:
    a longer file passes through the driver's JVM as a stream, some such files side by side.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    whole = files.where(F.col("length") <= WHOLE_FILE).select(name, "length", F.sha2("content", 256).alias("sha256"))
    long = files.where(F.col("length") > WHOLE_FILE).select("path", name, "length").collect()  # the listing, no content
    if not long:
        return whole
    with ThreadPool(min(PARALLEL_STREAMS, len(long))) as pool:
        digests = pool.map(lambda row: _stream_digest(spark, row["path"]), long)
    rows = [(row["file"], row["length"], digest) for row, digest in zip(long, digests)]
    return whole.unionByName(spark.createDataFrame(rows, whole.schema))


def table_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a table of any size: row count, exclusive or and sum of row hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"))


# ----------------------------------------------------------------------------------------------
# Checking
# ----------------------------------------------------------------------------------------------
def narrowing_plan(df: DataFrame) -> DataFrame:
    """Smallest integer type that holds every value of each integer column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    cells = [F.struct(F.lit(n).alias("column"), F.min(n).cast("bigint").alias("low"), F.max(n).cast("bigint").alias("high")).alias(n) for n in names]
    ranges = df.agg(*cells).select(F.explode(F.array(*names)).alias("r")).select("r.*")
    fits = lambda bits: (F.col("low") >= -(1 << (bits - 1))) & (F.col("high") <= (1 << (bits - 1)) - 1)
    kind = F.when(fits(8), "tinyint").when(fits(16), "smallint").when(fits(32), "int").otherwise("bigint")
    return ranges.withColumn("narrow_type", kind)


def narrow(df: DataFrame) -> DataFrame:
    """Cast integer columns by the plan; doubles stay doubles."""
    plan = {r["column"]: r["narrow_type"] for r in narrowing_plan(df).collect()}  # one row per column
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if c in plan else F.col(c) for c in df.columns])


def schema_audit(df: DataFrame, spec: TableSpec, strict: bool = False) -> DataFrame:
    """Rows, columns, presence of the target and its rate against the contract, from one aggregate."""
    has_target = spec.target in df.columns
    binary = spec.positive_rate is not None and has_target
    rate = F.avg(F.col(spec.target).cast("double")) if binary else F.lit(None).cast("double")
    measured = df.agg(F.count(F.lit(1)).alias("rows"), rate.alias("positive_rate"))
    ok = lambda c: F.coalesce(c, F.lit(True))
    out = measured.select(
        F.lit(spec.key).alias("dataset"), "rows", F.lit(len(df.columns)).alias("cols"), F.lit(has_target).alias("has_target"), "positive_rate",
        ok(F.col("rows") == F.lit(spec.expected_rows).cast("bigint")).alias("rows_ok"),
        ok(F.lit(len(df.columns)) == F.lit(spec.expected_cols).cast("int")).alias("cols_ok"),
        ok(F.abs(F.col("positive_rate") - F.lit(spec.positive_rate).cast("double")) <= POSITIVE_RATE_TOLERANCE).alias("rate_ok"))
    out = out.withColumn("schema_ok", F.col("rows_ok") & F.col("cols_ok") & F.col("rate_ok") & F.col("has_target"))
    if strict:
        row = out.collect()[0]
        if not row["schema_ok"]:
            raise ValueError(f"{spec.key} does not match its contract: {row.asDict()}")
    return out


def overview(tables: dict[str, tuple[DataFrame, TableSpec]]) -> DataFrame:
    """One audit row per table."""
    return reduce(lambda a, b: a.unionByName(b), [schema_audit(df, spec) for df, spec in tables.values()])


def feature_columns(df: DataFrame, spec: TableSpec, extra_drop: tuple[str, ...] = (), keep: list[str] | None = None) -> list[str]:
    """Columns a model may use, from the schema alone."""
    forbidden = spec.forbidden_features | set(extra_drop)
    names = [c for c in df.columns if c not in forbidden and (keep is None or c in keep)]
    if not names:
        raise ValueError(f"no admissible feature is left in {spec.key}")
    return names


def feature_frame(df: DataFrame, spec: TableSpec, extra_drop: tuple[str, ...] = (), keep: list[str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Admissible features with the target as ``label``; ``carry`` columns (keys, dates) ride along."""
    return df.select(*carry, *feature_columns(df, spec, extra_drop, keep), F.col(spec.target).alias("label"))


def check_contract(df: DataFrame, features: list[str], strict: bool = True) -> DataFrame:
    """Exactly the trained features in their trained order; decided from the schema before anything runs."""
    missing = [f for f in features if f not in df.columns]
    extra = [c for c in df.columns if c not in features]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    if strict and extra:
        raise ValueError(f"unexpected columns: {', '.join(extra)}")
    return df.select(*features)


# ----------------------------------------------------------------------------------------------
# Writing
# ----------------------------------------------------------------------------------------------
def write_features(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result table as a single CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Add run records; the log is JSON lines and only ever grows."""
    runs.write.mode("append").json(path)


def read_runs(spark: SparkSession, *paths: str) -> DataFrame:
    """All run records; a field some run lacks is NULL there."""
    parts = [spark.read.json(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_contract(spark: SparkSession, contract: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(contract),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_contract(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).head()[0])
