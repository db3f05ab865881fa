"""Session settings that the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Report times and event times are in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: fitting partition counts, split hot keys, small-side broadcasts.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM does not compile methods of more than 8000 bytes. Request classification
    # generates such methods, which run faster split up than fused and interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(builder: SparkSession.Builder) -> SparkSession:
    """Session of ``builder`` with the settings above."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
