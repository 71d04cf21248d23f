"""Fitted transforms on streams: what is fitted on a batch is a projection afterwards."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


class Transform(Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...


def read_tables(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def apply(stream: DataFrame, steps: Sequence[Transform]) -> DataFrame:
    for s in steps:
        stream = s.transform(stream)
    return stream


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a folder exactly once, until what is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
