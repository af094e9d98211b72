"""Model replies as a table: text plus token usage per request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import schemas


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(schemas.REPLIES)
    return reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)


def write_replies(replies: DataFrame, path: str) -> None:
    """Replies as JSON lines."""
    replies.select("request_id", "text", "input_tokens", "output_tokens").write.json(path)
