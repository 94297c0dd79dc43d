"""The commit log of a store as a stream of records (an extension: the log itself is plain JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECORD = "txn long, at double, note string, token long, previous string, hash string, changed array<string>, schema_version int"


def commit_stream(spark: SparkSession, store_path: str) -> DataFrame:
    """One row for each transaction record, as they appear; for stores with a local or Hadoop path."""
    return spark.readStream.schema(RECORD).json(f"{store_path.rstrip('/')}/meta/transactions")
