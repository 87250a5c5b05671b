"""Incremental runs over new artifacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Reads JSON lines that came since the last call, transforms them row by row and appends Parquet, each file once."""
    rows = spark.readStream.schema(schema).json(path)
    query = transform(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a result yet."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")
