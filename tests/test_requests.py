"""Admission, validation, classification, facts and error rows."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from swellframe.operators import admission, facts, reports

TS = datetime(2024, 3, 5, 10, 30)
WEATHER, TIDES, SEA = "/v2/weather/point", "/v2/tide/extremes/point", "/v2/tide/sea-level/point"
EXTREMES, TIMELINE, GEOCODE = "/tides/extremes", "/tides/timeline", "/data/reverse-geocode-client"


@pytest.mark.parametrize(
    "allowed, header, query, want",
    [
        ([], None, "", True),
        (["app1", "app2"], "app1", "", True),
        (["app1", "app2"], None, "app_id=app2", True),
        (["app1", "app2"], "wrong", "", False),
        (["app1", "app2"], None, "", False),
        (["app1", "app2"], "wrong", "app_id=app1", False),
        ([" app1 ", ""], None, "", True),
    ],
)
def test_app_id(spark, log_rows, allowed, header, query, want):
    rows = log_rows({"app_id_header": header, "query": query, "ts": TS})
    assert admission.authorize_app(rows, allowed).first()["authorized"] is want
    table = spark.createDataFrame([(name,) for name in allowed], "app_id STRING")
    assert admission.authorize_app_by_table(rows, table).first()["authorized"] is want


@pytest.mark.parametrize(
    "default, header, query, want",
    [("", None, "", False), ("", "header-key", "", True), ("", None, "key=query-key", True),
     ("default-key", None, "", True), ("", "", "key=", False)],
)
def test_api_key(log_rows, default, header, query, want):
    rows = log_rows({"authorization_header": header, "query": query, "ts": TS})
    assert admission.resolve_api_key(rows, default).first()["has_key"] is want


def outcome(log_rows, path, query, status=200, body="{}", **more):
    row = {"ts": TS, "path": path, "query": query, "upstream_status": status,
           "upstream_body": body, "authorization_header": "k", **more}
    return facts.classify(log_rows(row)).first()


@pytest.mark.parametrize("path", [WEATHER, TIDES, SEA, EXTREMES, TIMELINE, GEOCODE])
def test_missing_coordinates(log_rows, path):
    got = outcome(log_rows, path, "")
    assert (got.status_code, got.error_type) == (400, "Invalid Coordinates")


@pytest.mark.parametrize(
    "path, query, error_type",
    [
        (WEATHER, "lat=200&lng=0", "Invalid Coordinates"),
        (WEATHER, "lat=1.5d&lng=0", "Invalid Coordinates"),
        (WEATHER, "lat=nan&lng=0", "Invalid Coordinates"),
        (WEATHER, "lat=0&lng=0&params=invalid", "No Valid Params"),
        (WEATHER, "lat=0&lng=0&params=windSpeed&source=", "Unsupported Source"),
        (WEATHER, "lat=0&lng=0&source=x", "Unsupported Source"),
        (EXTREMES, "latitude=0&longitude=0&datum=INVALID", "Invalid Datum"),
        (TIMELINE, "latitude=0&longitude=0&datum=msl", "Invalid Datum"),
    ],
)
def test_invalid_requests(log_rows, path, query, error_type):
    got = outcome(log_rows, path, query)
    assert (got.status_code, got.error_type) == (400, error_type)


@pytest.mark.parametrize(
    "path, query",
    [
        (WEATHER, "lat=0&lng=0&params=windSpeed"),
        (TIDES, "lat=180&lng=-180&datum=anything"),
        (EXTREMES, "latitude=abc&longitude=999&datum=MSL"),
        (GEOCODE, "latitude=abc&longitude=x"),
    ],
)
def test_valid_requests(log_rows, path, query):
    got = outcome(log_rows, path, query)
    assert (got.status_code, got.error_type, got.message) == (200, "", None)


@pytest.mark.parametrize(
    "path, status, body, want",
    [
        (TIDES, 403, "no", (403, "Stormglass Auth Error")),
        (TIDES, 401, "no", (401, "Stormglass Auth Error")),
        (TIDES, 429, "no", (429, "Stormglass Rate Limit")),
        (TIDES, 503, "no", (503, "Stormglass HTTP 503")),
        (TIDES, 302, "no", (302, "")),
        (TIDES, None, None, (500, "Stormglass Connection Error")),
        (TIDES, 200, '{"data":[', (500, "Parse Error")),
        (EXTREMES, 429, "no", (429, "OpenWaters HTTP 429")),
        (GEOCODE, 401, "no", (401, "BigDataCloud HTTP 401")),
    ],
)
def test_upstream_outcomes(log_rows, path, status, body, want):
    got = outcome(log_rows, path, "lat=1&lng=2&latitude=1&longitude=2", status, body)
    assert (got.status_code, got.error_type) == want


def test_checks_before_the_handler_have_no_backend(log_rows):
    got = outcome(log_rows, TIDES, "lat=1&lng=2", authorization_header=None)
    assert (got.status_code, got.error_type, got.backend) == (403, "Missing API Key", "Unknown")
    # The other routes need no key.
    assert outcome(log_rows, GEOCODE, "latitude=1&longitude=2", authorization_header=None).status_code == 200


def test_facts_and_counters_treat_zero_coordinates_differently(log_rows):
    base = {"ts": TS, "path": GEOCODE, "upstream_status": 200, "upstream_body": "{}"}
    queries = ["latitude=0&longitude=0", "latitude=0&longitude=5", "latitude=0.001&longitude=5",
               "latitude=300&longitude=5", "latitude=1.005&longitude=-0.001"]
    classified = facts.classify(log_rows(*[{**base, "query": query} for query in queries]))
    rows = {row.id: (row.lat, row.lng) for row in facts.request_facts(classified).collect()}
    assert rows == {0: (None, None), 1: (0.0, 5.0), 2: (0.0, 5.0), 3: (300.0, 5.0), 4: (1.0, 0.0)}
    assert sorted(row.id for row in facts.countable(classified).collect()) == [2, 4]


def test_paths_without_route_are_not_logged(log_rows):
    rows = log_rows({"ts": TS, "path": "/dashboard", "query": ""})
    assert facts.classify(rows).count() == 0


def test_error_rows_keep_the_right_bodies(log_rows):
    base = {"ts": TS, "query": "lat=1&lng=2&latitude=1&longitude=2", "authorization_header": "k"}
    rows = log_rows(
        {**base, "path": TIDES, "upstream_status": 503, "upstream_body": "busy"},
        {**base, "path": TIDES, "upstream_status": 200, "upstream_body": "["},
        {**base, "path": GEOCODE, "upstream_status": 200, "upstream_body": "["},
        {**base, "path": GEOCODE, "upstream_status": 200, "upstream_body": "{}"},
        {**base, "path": TIDES, "query": "lat=1", "request_body": "asked"},
    )
    errors = facts.error_rows(facts.classify(rows)).collect()
    bodies = {row.id: (row.request_body, row.response_body, row.upstream_response) for row in errors}
    assert bodies == {
        0: ("", "busy", "busy"),
        1: ("", '{"error":"Failed to parse Stormglass response"}', ""),
        2: ("", '{"error":"Failed to parse BigDataCloud response"}', "["),
        4: ("asked", '{"error":"lat and lng must be valid numbers"}', ""),
    }


def test_reports_on_no_rows(log_rows):
    nothing = facts.request_facts(facts.classify(log_rows({"ts": TS, "path": "/x", "query": ""})))
    assert reports.backend_stats(nothing, TS).count() == 0
    totals = reports.overall_totals(reports.backend_stats(nothing, TS)).first()
    assert tuple(totals) == (0, 0, 0)


def test_top_reasons_break_ties_by_name(spark):
    rows = spark.createDataFrame(
        [(500, reason) for reason in "cabbcadd"] + [(500, ""), (200, "z")],
        "status_code INT, error_type STRING",
    ).withColumn("ts", F.lit(TS.isoformat(" ")).cast("timestamp_ntz"))
    top = reports.failure_reasons(rows, TS, top=3).collect()
    assert [tuple(row) for row in top] == [("a", 2), ("b", 2), ("c", 2)]


def test_days_bound_is_inclusive_and_in_whole_seconds(spark):
    times = ["2024-03-04 10:30:00", "2024-03-04 10:29:59.999999", "2024-03-05 10:30:00"]
    rows = spark.createDataFrame([(t,) for t in times], "t STRING").select(
        F.col("t").cast("timestamp_ntz").alias("ts")
    )
    as_of = TS.replace(microsecond=900000)
    assert reports.last_n_days(rows, as_of, 1).count() == 2
    assert reports.last_n_days(rows, as_of, 0).count() == 3


def test_day_limit_reaches_the_scan(spark, tmp_path):
    rows = spark.range(10).select(
        F.lit("2024-03-04 00:00:00").cast("timestamp_ntz").alias("ts"),
        F.lit("a").alias("backend"), F.lit(200).alias("status_code"),
        F.lit("2024-03-04").cast("date").alias("dt"),
    )
    rows.write.partitionBy("dt").parquet(str(tmp_path / "t"))
    report = reports.backend_stats(spark.read.parquet(str(tmp_path / "t")), TS, 7)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert "GreaterThanOrEqual(ts,2024-02-27T10:30)" in plan


def test_requests_that_reach_the_cache(log_rows):
    base = {"ts": TS, "path": TIDES, "authorization_header": "k", "upstream_status": 200,
            "upstream_body": "{}"}
    rows = log_rows(
        {**base, "query": "lat=1.015&lng=2&start=1709632800&end=1709636400&datum=MSL"},
        {**base, "query": "lat=1&lng=2", "upstream_status": 503},
        {**base, "query": "lat=1&lng=2", "upstream_body": "["},
        {**base, "query": "lat=200&lng=2"},
        {**base, "query": "lat=1&lng=2", "authorization_header": None},
        {**base, "path": GEOCODE, "query": "latitude=1&longitude=2"},
        {**base, "query": "lat=1&lng=2", "method": "POST"},
    )
    reaching = facts.cache_requests(facts.classify(rows)).orderBy("id").collect()
    assert [(row.id, row.success) for row in reaching] == [(0, True), (1, False), (2, False)]
    assert reaching[0].cache_key == "tides:1.01:2.00:1709632800:1709636400:MSL"


@pytest.mark.parametrize("text", ["lat=1.5%0A&lng=2", "lat=1&lng=2%0A"])
def test_a_line_break_is_no_number(spark, log_rows, text):
    rows = log_rows({"path": TIDES, "query": text, "ts": TS, "authorization_header": "k"})
    assert facts.classify(rows).first().status_code == 400


def test_requests_that_never_asked_upstream(spark, log_rows):
    rows = log_rows(*[{"path": TIMELINE, "query": "latitude=1&longitude=2", "ts": TS}] * 3)
    called = F.element_at(F.array(F.lit(True), F.lit(False), F.lit(None).cast("boolean")), (F.col("id") + 1).cast("int"))
    found = facts.classify(rows.withColumn("upstream_called", called)).collect()
    assert {r.id: r.status_code for r in found} == {0: 500, 1: 200, 2: 500}


def test_served_requests_are_successes(spark):
    from swellframe.operators import served
    from swellframe.plans import catalog
    from swellframe.sources.workspace import written

    sf_dir = "/root/testdata/sf0.01"
    rows = written(catalog.classified(spark, sf_dir), "classified")
    overrides = catalog.override_names(spark, sf_dir)
    ids = served.served_ids(rows, overrides)
    result = served.service_facts(rows, overrides)
    plain = served.service_facts(rows, overrides, use_cache=False)
    assert result.count() == plain.count()
    assert result.join(ids, "id").filter("status_code >= 400 OR error_type <> ''").count() == 0
    assert plain.join(ids, "id").filter("status_code >= 400").count() > 0
    labels = catalog.ttl_dedup(spark, sf_dir)
    assert labels.filter("cache = 'HIT'").count() >= 0.2 * labels.count()


@pytest.mark.parametrize(("text", "days"), [("7", 7), ("+7", 7), ("-1", -1), ("1_0", 0), (" 7 ", 0), ("\u0667", 0), (None, 0)])
def test_days_requested(text, days):
    assert reports.days_requested(text) == days


def test_not_a_number_is_stored_as_null(spark, log_rows):
    rows = log_rows({"path": TIMELINE, "query": "latitude=nan&longitude=5", "ts": TS, "upstream_status": 200, "upstream_body": "{}"})
    assert tuple(facts.request_facts(facts.classify(rows)).select("lat", "lng").first()) == (None, 5.0)
