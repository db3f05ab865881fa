"""Checks made before a request reaches its handler."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from swellframe.functions.query_text import either_value, with_query_values


def app_id(header: Column, q: Column) -> Column:
    """App id of a request: the header, else the ``app_id`` query value, else ''."""
    return F.coalesce(F.nullif(header, F.lit("")), q["app_id"], F.lit(""))


def app_allowed(header: Column, q: Column, allowed: Sequence[str]) -> Column:
    """Whether the app id is in ``allowed``; an empty list admits everyone.

    An empty element in the list admits requests without an id.
    """
    if not allowed:
        return F.lit(True)
    return app_id(header, q).isin([name.strip() for name in allowed])


def has_api_key(header: Column, q: Column, default_key: str) -> Column:
    """Whether a key comes with the request or a default one is configured.

    Only the flag leaves this function, so that no key is stored.
    """
    if default_key:
        return F.lit(True)
    return either_value(header, q["key"]).isNotNull()


def authorize_app(access_log: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Access log with ``app_id`` and ``authorized``."""
    return (
        with_query_values(access_log)
        .withColumn("app_id", app_id(F.col("app_id_header"), F.col("q")))
        .withColumn("authorized", app_allowed(F.col("app_id_header"), F.col("q"), allowed))
        .drop("q")
    )


def authorize_app_by_table(access_log: DataFrame, allowed: DataFrame) -> DataFrame:
    """As :func:`authorize_app`, with the allow list in column ``app_id`` of a table.

    The ids are made unique, so the left join keeps one row per request.
    """
    ids = (
        allowed.select(F.btrim("app_id").alias("app_id"))
        .distinct()
        .withColumn("authorized", F.lit(True))
    )
    if allowed.isEmpty():
        return authorize_app(access_log, [])
    with_id = (
        with_query_values(access_log)
        .withColumn("app_id", app_id(F.col("app_id_header"), F.col("q")))
        .drop("q")
    )
    # No hint: adaptive execution broadcasts the list if its measured size allows that.
    return with_id.join(ids, "app_id", "left").withColumn(
        "authorized", F.coalesce("authorized", F.lit(False))
    )


def resolve_api_key(access_log: DataFrame, default_key: str = "") -> DataFrame:
    """Access log with ``has_key``."""
    has_key = has_api_key(F.col("authorization_header"), F.col("q"), default_key)
    return with_query_values(access_log).withColumn("has_key", has_key).drop("q")
