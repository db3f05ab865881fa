"""The access log: one row per API call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ACCESS_LOG = (
    "id BIGINT, ts TIMESTAMP_NTZ, method STRING, path STRING, query STRING, "
    "app_id_header STRING, authorization_header STRING, request_body STRING, "
    "upstream_status INT, upstream_body STRING"
)
PAYLOAD = "id BIGINT, kind STRING, params STRING, body STRING"


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Access log Parquet files as a table."""
    return spark.read.schema(ACCESS_LOG).parquet(path)


def stream_access_log(
    spark: SparkSession, path: str, max_bytes: int = 2**30
) -> DataFrame:
    """Access log Parquet files as a stream, new files as they arrive.

    ``max_bytes`` bounds a micro-batch, and with it what one key can bring at once.
    """
    reader = spark.readStream.schema(ACCESS_LOG).option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Raw upstream bodies with the kind of payload and the params asked for."""
    return spark.read.schema(PAYLOAD).parquet(path)
