"""Session settings shared by every job of the package."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class SplitSettings:
    """When one ordered group is too large for a single task."""

    partitions: int
    min_rows: int

    def threshold(self, total_rows: int) -> int:
        # At most 4 x partitions groups can lie above total / (4 x partitions), so the list
        # of groups to split is bounded by the cluster's own setting, not by the data.
        return max(self.min_rows, total_rows // (4 * self.partitions))


def split_settings(spark: SparkSession) -> SplitSettings:
    return SplitSettings(
        partitions=max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2),
        min_rows=int(spark.conf.get("spark.ledgerline.minSplitRows", "500000")),
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local session, as used in tests, may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="ledgerline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new sub-folder path inside the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{os.urandom(6).hex()}")


def materialise(df: DataFrame, name: str, spread: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where several jobs start from the same derived table: it is computed once, later scans
    read only the columns they need, and it outlives any executor.  ``spread`` evens out the files
    for iterative fits, which wait for the slowest partition in every step.
    """
    path = fresh_dir(df.sparkSession, name)
    (df.repartition(split_settings(df.sparkSession).partitions) if spread else df).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "ledgerline") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
