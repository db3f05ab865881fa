"""Access log to request facts, error rows and countable locations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from swellframe.functions.grid import countable_location, grid_cell
from swellframe.functions.numbers import parse_float_lenient, parse_float_strict
from swellframe.functions.plain import with_plain_column
from swellframe.functions.query_text import either_value, with_query_values
from swellframe.functions.request_text import filter_params, tide_key, weather_key
from swellframe.functions.times import aligned_window
from swellframe.operators.admission import app_allowed, has_api_key
from swellframe.operators.payloads import decodable
from swellframe.operators.upstream import (
    BIGDATACLOUD,
    OPENWATERS,
    PARSE_ERROR,
    STORMGLASS,
    classify_upstream,
)
from swellframe.operators.validation import (
    rejection,
    validate_geocode,
    validate_openwaters,
    validate_tide,
    validate_weather,
    weather_source,
)

# Route paths with their backend, payload kind and need of an API key.
ROUTES = (
    ("/v2/weather/point", STORMGLASS, "weather", True),
    ("/v2/tide/extremes/point", STORMGLASS, "tide_extremes", True),
    ("/v2/tide/sea-level/point", STORMGLASS, "sea_level", True),
    ("/tides/extremes", OPENWATERS, "ow_extremes", False),
    ("/tides/timeline", OPENWATERS, "ow_timeline", False),
    ("/data/reverse-geocode-client", BIGDATACLOUD, "geocode", False),
)
ROUTE_METHOD = "GET"
# Outcomes of the checks made before a handler runs.
UNAUTHORIZED_APP = (401, "Unauthorized App ID", "Unauthorized: invalid or missing App ID")
MISSING_KEY = (403, "Missing API Key", "No API key provided")
UNKNOWN_BACKEND = "Unknown"
# Kinds of request whose responses are cached.
CACHED_KINDS = ("weather", "tide_extremes", "sea_level")
UNKNOWN_ERROR = "Unknown Error"


def route_table(spark: SparkSession) -> DataFrame:
    """The six routes as ``(path, route_backend, kind, needs_key)``."""
    rows = ", ".join(
        f"('{path}', '{backend}', '{kind}', {str(key).lower()})"
        for path, backend, kind, key in ROUTES
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(path, route_backend, kind, needs_key)")


def with_route(access_log: DataFrame) -> DataFrame:
    """Access log rows on a known route. Other paths and methods are not logged at all."""
    routes = F.broadcast(route_table(access_log.sparkSession))
    return access_log.filter(F.col("method") == ROUTE_METHOD).join(routes, "path")


def request_coordinates(q: Column) -> tuple[Column, Column]:
    """(lat, lng) of any route's query; both 0.0 unless both are given."""
    lat_text = either_value(q["lat"], q["latitude"])
    lng_text = either_value(q["lng"], q["longitude"])
    both = lat_text.isNotNull() & lng_text.isNotNull()
    return (
        F.when(both, parse_float_lenient(lat_text)).otherwise(F.lit(0.0)),
        F.when(both, parse_float_lenient(lng_text)).otherwise(F.lit(0.0)),
    )


def extract_coords(access_log: DataFrame) -> DataFrame:
    """Access log with ``lat`` and ``lng`` read from the raw query."""
    lat, lng = request_coordinates(F.col("q"))
    return with_query_values(access_log).withColumns({"lat": lat, "lng": lng}).drop("q")


def _validate(kind: Column, q: Column) -> Column:
    return (
        F.when(kind == "weather", validate_weather(q))
        .when(kind.isin("tide_extremes", "sea_level"), validate_tide(q))
        .when(kind.isin("ow_extremes", "ow_timeline"), validate_openwaters(q))
        .when(kind == "geocode", validate_geocode(q))
    )


def classify(
    access_log: DataFrame, allowed_apps: Sequence[str] = (), default_key: str = ""
) -> DataFrame:
    """Access log rows on known routes with the outcome of each request.

    Adds ``backend, status_code, error_type, message, passed_on, lat, lng`` and the
    query values ``q``. The checks run in order and the first that fails decides: app
    id, API key, validation, then the upstream call. A log may have a column
    ``upstream_called`` that tells requests which never asked upstream from those without
    an answer. ``passed_on`` marks a failed answer
    handed on from upstream. ``lat`` and ``lng`` are the raw coordinates, 0.0 where
    missing.
    """
    q = F.col("q")
    admitted = F.coalesce(
        F.when(
            ~app_allowed(F.col("app_id_header"), q, allowed_apps), rejection(*UNAUTHORIZED_APP)
        ),
        F.when(
            F.col("needs_key") & ~has_api_key(F.col("authorization_header"), q, default_key),
            rejection(*MISSING_KEY),
        ),
    )
    body_ok = decodable("upstream_body", "kind")
    answered = classify_upstream(F.col("route_backend"), F.col("upstream_status"), body_ok)
    if "upstream_called" in access_log.columns:
        # Not called is no failed call: such requests were served from what is stored.
        called = F.coalesce(F.col("upstream_called"), F.lit(True))
        answered = F.when(called, answered)
    refusal = F.struct(
        F.col("_admitted").isNull().alias("reached"),
        F.coalesce("_admitted", _validate(F.col("kind"), q)).alias("refused"),
    )
    checked = (
        with_query_values(with_route(access_log))
        .withColumn("_admitted", admitted)
        .withColumn("_refusal", refusal)
    )
    return (
        with_plain_column(checked, "_outcome", _outcome(answered, *request_coordinates(q)))
        .withColumns(
            {
                "backend": F.when(F.col("_outcome.reached"), F.col("route_backend")).otherwise(
                    UNKNOWN_BACKEND
                ),
                "status_code": F.col("_outcome.status_code"),
                "error_type": F.when(
                    F.col("_outcome.status_code") >= 400,
                    F.coalesce("_outcome.error_type", F.lit(UNKNOWN_ERROR)),
                ).otherwise(""),
                "message": F.col("_outcome.message"),
                "passed_on": F.col("_outcome.passed_on"),
                "lat": F.col("_outcome.lat"),
                "lng": F.col("_outcome.lng"),
            }
        )
        .drop("_admitted", "_refusal", "_outcome")
    )


def _outcome(answered: Column, lat: Column, lng: Column) -> Column:
    """The refusal or upstream outcome, 200 if neither is set, with the coordinates.

    The lambda binds the outcome, so that the body is decoded once. Coordinates go along: a
    filter on them would otherwise parse their text anew for each of its terms.
    """
    failed = F.coalesce("_refusal.refused", answered)
    outcomes = F.transform(
        F.array(failed),
        lambda failure: F.struct(
            F.col("_refusal.reached").alias("reached"),
            F.coalesce(failure["status_code"], F.lit(200)).alias("status_code"),
            failure["error_type"].alias("error_type"),
            failure["message"].alias("message"),
            (failure.isNotNull() & failure["message"].isNull()).alias("passed_on"),
            lat.alias("lat"),
            lng.alias("lng"),
        ),
    )
    return F.get(outcomes, F.lit(0))


def request_facts(classified: DataFrame) -> DataFrame:
    """One fact row per request: cells for coordinates, null where both are 0.

    A coordinate that is not a number is stored as null.
    """
    located = (F.col("lat") != 0) | (F.col("lng") != 0)
    none = F.lit(None).cast("double")
    cell = lambda name: F.nanvl(grid_cell(F.col(name)), none)
    return classified.select(
        "id",
        "ts",
        "backend",
        "status_code",
        "error_type",
        F.when(located, cell("lat")).alias("lat"),
        F.when(located, cell("lng")).alias("lng"),
        F.col("ts").cast("date").alias("dt"),
    )


def error_rows(classified: DataFrame) -> DataFrame:
    """Detail rows of the failed requests.

    The response is the upstream body where that was handed on, and a short JSON
    message otherwise. The upstream body is also kept apart for failed calls, and for
    geocode bodies that could not be read.
    """
    unreadable_geocode = (F.col("kind") == "geocode") & (F.col("error_type") == PARSE_ERROR)
    kept_body = F.when(F.col("passed_on") | unreadable_geocode, F.col("upstream_body"))
    return classified.filter(F.col("status_code") >= 400).select(
        "id",
        "ts",
        "method",
        "path",
        "query",
        "status_code",
        F.coalesce("request_body", F.lit("")).alias("request_body"),
        F.when(F.col("passed_on"), F.coalesce("upstream_body", F.lit("")))
        .otherwise(F.to_json(F.struct(F.col("message").alias("error"))))
        .alias("response_body"),
        F.coalesce(kept_body, F.lit("")).alias("upstream_response"),
        "backend",
        "error_type",
        F.col("ts").cast("date").alias("dt"),
    )


def cache_requests(classified: DataFrame) -> DataFrame:
    """Requests that reach the response cache: ``id, ts, cache_key, success``.

    Those are the requests of one backend that pass the checks made before and in the
    handler. Only an answer that could be decoded is stored.
    """
    reaching = classified.filter(
        F.col("kind").isin(*CACHED_KINDS)
        & (F.col("backend") != UNKNOWN_BACKEND)
        & (F.col("status_code") != 400)
    )
    key = request_key(F.col("kind"), F.col("q"), F.col("ts"))
    return reaching.select(
        "id", "ts", key.alias("cache_key"), (F.col("status_code") == 200).alias("success")
    )


def request_key(kind: Column, q: Column, ts: Column) -> Column:
    """Cache key of a valid request of one of the ``CACHED_KINDS``."""
    start, end = aligned_window(q["start"], q["end"], ts)
    lat, lng = parse_float_strict(q["lat"]), parse_float_strict(q["lng"])
    weather = weather_key(lat, lng, filter_params(q["params"]), weather_source(q), start, end)
    prefix = F.when(kind == "sea_level", "sealevel").otherwise("tides")
    tide = tide_key(prefix, lat, lng, start, end, q["datum"])
    return F.when(kind == "weather", weather).otherwise(tide)


def countable(classified: DataFrame) -> DataFrame:
    """Cells of the requests that add to the lifetime counters."""
    return classified.filter(
        countable_location(F.col("status_code"), F.col("lat"), F.col("lng"))
    ).select(
        "id", "ts", grid_cell(F.col("lat")).alias("lat"), grid_cell(F.col("lng")).alias("lng")
    )
