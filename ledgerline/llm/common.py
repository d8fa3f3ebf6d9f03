"""What the operators share: reading tables, the alphabet of white space, rows and tables written between jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir

#: White space between words. A word is a run of anything else.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark removes the shuffle files of a query at its end where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, by: str | None = None) -> str:
    """The path of the table, written to the folder all executors share; what was shuffled for it goes once it is there."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write if by is None else df.write.partitionBy(by)
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written and read again: several jobs read it, none computes it anew."""
    return df.sparkSession.read.parquet(stored(df, name))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, wherever Spark wrote it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def split_id(df: DataFrame) -> list[Column]:
    """The id as a plain number and whether there is one: pandas would turn a column of ids with nulls into doubles."""
    own = df["doc_id"].cast("long")
    return [F.coalesce(own, F.lit(0)).alias("doc_id"), own.isNotNull().alias("known")]


def joined_id(df: DataFrame) -> DataFrame:
    """The id as it was, from the columns of ``split_id``."""
    return df.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")


def body(docs: DataFrame, text: str = "text") -> Column:
    """The text of a row, empty where it is null."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))
