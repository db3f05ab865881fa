"""Work that has to be spread, or done once per row, whatever the input's layout."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from swellframe.operators import facts, response_cache
from swellframe.plans import catalog, mapping
from swellframe.session import SETTINGS
from swellframe.sources import workspace
from swellframe.streaming import served
from swellframe.streaming.landing import append_stream

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def optimized(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_coordinates_are_not_parsed_in_filters(spark):
    log = spark.createDataFrame(
        [(1, "GET", "/v2/weather/point", "lat=1.5&lng=2&app_id=a", None, None, "", 200, "{}")],
        "id LONG, method STRING, path STRING, query STRING, app_id_header STRING, "
        "authorization_header STRING, request_body STRING, upstream_status INT, upstream_body STRING",
    ).selectExpr("*", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts")
    plan = optimized(facts.countable(facts.classify(log)))
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("try_cast" in line.lower() or "rlike" in line.lower() or "_found" in line for line in filters)


def test_events_of_one_row_group_are_dealt(spark, tmp_path):
    spark.range(10).selectExpr("id AS event_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    plan = optimized(mapping.events(spark, str(tmp_path)))
    assert "RebalancePartitions" in plan


def test_hops_are_not_sent_through_the_driver(spark):
    schema = "cache_key STRING, run LONG, at LONG, next_at LONG, run_bucket LONG, bucket_first BOOLEAN"
    hops = spark.createDataFrame([("k", 0, 1, 2, 0, True), ("k", 0, 2, 3, 1, True)], schema)
    entries = hops.select("cache_key", "run", "at", "run_bucket")
    for rows in (response_cache._joined_hops(hops, 0), response_cache._second_half_entries(entries, hops, 0)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_files_of_an_arriving_log_grow_with_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 10)
    log, source, out = spark.range(95), str(tmp_path / "log"), str(tmp_path / "out")
    files = catalog._arriving(log, F.col("id") >= 0, source)
    assert len(list((tmp_path / "log").glob("*.parquet"))) == 10
    query = append_stream(files, out, str(tmp_path / "state"))
    query.awaitTermination()
    assert [p.numInputRows > 0 for p in query.recentProgress].count(True) == 2
    assert spark.read.parquet(out).count() == 95


def test_streamed_events_are_dealt(spark, tmp_path):
    event = "id AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, id AS user_id, 'view' AS event_type"
    rows = spark.range(10).selectExpr(*event.split(", "), "1.0D AS value", "'{\"k\": 1}' AS props")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    plan = catalog.log_stream(spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert "Repartition" in plan


@pytest.fixture
def other_session(spark):
    """The session without the settings that the operators are tuned for."""
    spark.conf.set(METHOD_LIMIT, "65535")
    yield spark
    spark.conf.set(METHOD_LIMIT, SETTINGS[METHOD_LIMIT])


def test_classification_is_compiled_in_any_session(other_session, tmp_path, monkeypatch):
    spark, limits, write = other_session, {}, workspace.written

    def written(rows, name):
        limits[name] = spark.conf.get(METHOD_LIMIT)
        return write(rows, name)

    monkeypatch.setattr(workspace, "written", written)
    event = "id AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, id AS user_id, 'view' AS event_type"
    rows = spark.range(10).selectExpr(*event.split(", "), "1.0D AS value", "'{\"k\": 1}' AS props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    nations = spark.createDataFrame([(1, "Bali", 1)], "n_nationkey INT, n_name STRING, n_regionkey INT")
    nations.write.parquet(str(tmp_path / "nation.parquet"))
    catalog.served_rows(spark, str(tmp_path))
    assert limits["classified"] == SETTINGS[METHOD_LIMIT]
    assert spark.conf.get(METHOD_LIMIT) == "65535"


def test_streams_are_compiled_in_any_session(other_session, tmp_path):
    source = str(tmp_path / "in")
    other_session.range(5).write.parquet(source)
    rows = other_session.readStream.schema("id LONG").parquet(source)
    query = append_stream(rows, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    execution = query._jsq.streamingQuery() if hasattr(query._jsq, "streamingQuery") else query._jsq
    assert execution.sparkSessionForStream().conf().get(METHOD_LIMIT) == SETTINGS[METHOD_LIMIT]
    assert other_session.conf.get(METHOD_LIMIT) == "65535"


def test_the_served_join_sends_only_what_is_logged(spark, log_rows, tmp_path, monkeypatch):
    columns, write = {}, served.written

    def written(rows, name):
        columns[name] = set(rows.columns)
        return write(rows, name)

    monkeypatch.setattr(served, "written", written)
    log = log_rows({"path": "/v2/weather/point", "query": "lat=1&lng=2&key=k", "ts": datetime(2024, 1, 1)})
    overrides = spark.createDataFrame([], "lat_cell DOUBLE, lng_cell DOUBLE, name STRING")
    served.load_served(facts.classify(log), overrides, str(tmp_path / "tables"), "landing/step-0")
    assert not columns["arriving-served"] & {"q", "authorization_header", "app_id_header"}
    assert {"id", "query", "upstream_body", "status_code"} <= columns["arriving-served"]
