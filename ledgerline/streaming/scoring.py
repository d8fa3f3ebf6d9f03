"""Row-wise decisions on a stream: the same function as on a table, nothing kept between rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_arrivals(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def run_to_date(scored: DataFrame, sink: str, checkpoint: str) -> None:
    """Process everything that has arrived, append the decisions as parquet and stop.

    The checkpoint makes the sink exactly-once over restarts.
    """
    writer = scored.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(sink).awaitTermination()


def decide(arrivals: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a row-wise scoring function."""
    if not arrivals.isStreaming:
        raise ValueError("expected a streaming table")
    return score(arrivals)
