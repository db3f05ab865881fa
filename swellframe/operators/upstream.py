"""Outcome of the call to the upstream service."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from swellframe.operators.validation import rejection

# Names of the upstream services, and the statuses that one of them
# reports under a name of its own.
STORMGLASS = "Stormglass"
OPENWATERS = "OpenWaters"
BIGDATACLOUD = "BigDataCloud"
AUTH_STATUSES = (401, 403)
RATE_STATUS = 429
PARSE_ERROR = "Parse Error"


def upstream_error_type(backend: Column, upstream_status: Column) -> Column:
    """Error type of a call without answer or with a status other than 200."""
    stormglass = backend == STORMGLASS
    return (
        F.when(upstream_status.isNull(), F.concat(backend, F.lit(" Connection Error")))
        .when(upstream_status == 200, F.lit(None).cast("string"))
        .when(stormglass & upstream_status.isin(*AUTH_STATUSES), f"{STORMGLASS} Auth Error")
        .when(stormglass & (upstream_status == RATE_STATUS), f"{STORMGLASS} Rate Limit")
        .otherwise(F.concat(backend, F.lit(" HTTP "), upstream_status.cast("string")))
    )


def classify_upstream(backend: Column, upstream_status: Column, decodable: Column) -> Column:
    """``STRUCT<status_code, error_type, message>`` of a failed call, else null.

    The message is null where the answer of the upstream is passed on as it is.
    """
    named = lambda text: F.concat(F.lit(text[0]), backend, F.lit(text[1]))
    error_type = upstream_error_type(backend, upstream_status)
    return (
        F.when(
            upstream_status.isNull(),
            rejection(500, error_type, named(("Failed to fetch from ", ""))),
        )
        .when(
            upstream_status != 200,
            rejection(upstream_status, error_type, F.lit(None).cast("string")),
        )
        .when(
            ~decodable,
            rejection(500, PARSE_ERROR, named(("Failed to parse ", " response"))),
        )
    )
