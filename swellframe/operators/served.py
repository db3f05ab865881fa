"""Facts of requests that the service answered without asking upstream.

Overrides, the first answer of a cell and stored responses are answered with 200, whatever
upstream would have said. The facts of such requests say so here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from swellframe.operators.facts import cache_requests, request_facts
from swellframe.operators.geocode import CELL, PLACE, geocode_coordinates, geocode_resolve, with_cell
from swellframe.operators.payloads import decode
from swellframe.operators.response_cache import ttl_labels
from swellframe.operators.upstream import BIGDATACLOUD
from swellframe.sources.workspace import written


def geocode_points(classified: DataFrame) -> DataFrame:
    """Geocode requests that pass their checks, with the coordinates asked for."""
    lat, lng = geocode_coordinates(F.col("q"))
    passed = classified.filter(
        (F.col("kind") == "geocode") & (F.col("backend") == BIGDATACLOUD) & (F.col("status_code") != 400)
    )
    return passed.withColumns({"lat": lat, "lng": lng})


def geocode_answers(classified: DataFrame) -> DataFrame:
    """Geocode requests with what upstream answers, or would answer, to each."""
    body = F.when(F.col("upstream_status") == 200, F.col("upstream_body"))
    decoded = decode(geocode_points(classified).withColumn("body", body), "geocode")
    place = [
        F.nullif(F.col(f"doc.{name}").cast("string"), F.lit("")).alias(name) for name in PLACE
    ]
    return decoded.select("id", "ts", "lat", "lng", F.col("decoded").alias("answered"), *place)


def served_ids(classified: DataFrame, overrides: DataFrame) -> DataFrame:
    """``id`` of the requests answered by an override, a first answer or a stored response.

    ``classified`` is read several times and should be a stored table.
    """
    answers = written(geocode_answers(classified), "geocode-answers")
    places = geocode_resolve(answers, overrides).filter(F.col("source").isin("override", "cache"))
    requests = written(cache_requests(classified), "cache-requests")
    hits = ttl_labels(requests).filter(F.col("cache") == "HIT")
    return places.select("id").unionByName(hits.select("id"))


def override_ids(classified: DataFrame, overrides: DataFrame) -> DataFrame:
    """``id`` of the requests answered by an override, which needs no cache."""
    named = overrides.select(*CELL)
    return with_cell(geocode_points(classified)).join(named, CELL, "left_semi").select("id")


def as_served(classified: DataFrame, served: DataFrame) -> DataFrame:
    """``classified`` with the requests in ``served`` (``id``) as successes.

    Facts, error rows, countable requests and all reports follow from the result.
    """
    marked = classified.join(served.select("id", F.lit(True).alias("_served")), "id", "left")
    by_cache = F.col("_served").isNotNull()
    return marked.withColumns(
        {
            "status_code": F.when(by_cache, F.lit(200)).otherwise(F.col("status_code")),
            "error_type": F.when(by_cache, F.lit("")).otherwise(F.col("error_type")),
        }
    ).drop("_served")


def service_rows(classified: DataFrame, overrides: DataFrame, use_cache: bool = True) -> DataFrame:
    """Classified requests as the service logs them: served requests are successes.

    Without ``use_cache`` only overrides are answered without asking upstream.
    """
    ids = served_ids(classified, overrides) if use_cache else override_ids(classified, overrides)
    return as_served(classified, ids)


def service_facts(classified: DataFrame, overrides: DataFrame, use_cache: bool = True) -> DataFrame:
    """Request facts of :func:`service_rows`."""
    return request_facts(service_rows(classified, overrides, use_cache))
