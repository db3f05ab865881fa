"""Tables that steps add to: any order, any repetition, and what a run reads."""

from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

import pytest

from swellframe.operators import facts, geocode, reports, served
from swellframe.plans import catalog, mapping
from swellframe.sources import tables
from swellframe.sources.workspace import written
from swellframe.streaming import landing
from swellframe.streaming import requests as streams
from swellframe.streaming import served as served_stream

SF_DIR = "/root/testdata/sf0.001"
DAY = datetime(2024, 3, 9)


def merged(spark, path, source, lat, n):
    more = spark.createDataFrame([(lat, 2.0, n)], tables.LOCATIONS)
    tables.merge_version(
        spark, path, tables.LOCATIONS, source, lambda stored: tables.merge_sums(stored, more, ["lat", "lng"], ["count"])
    )


def counts(spark, path):
    return {row.lat: row["count"] for row in tables.read_version(spark, path, tables.LOCATIONS).collect()}


def test_every_order_and_repetition_of_steps_counts_once(spark, tmp_path):
    steps = {"a": 3, "b": 5, "c": 7}
    orders = ["aba", "abab", "abcabc", "cbaabc", "aab", "bca"]
    for i, order in enumerate(orders):
        path = str(tmp_path / str(i))
        for name in order:
            merged(spark, path, name, 1.0, steps[name])
        assert counts(spark, path) == {1.0: sum(steps[name] for name in set(order))}
        assert len(tables.list_folders(spark, path)) <= 2


def test_two_landings_into_one_table(spark, tmp_path):
    path = str(tmp_path)
    for landing_name, number in [("x", 0), ("y", 0), ("x", 1), ("x", 0), ("y", 2), ("y", 1), ("y", 2), ("x", 1)]:
        merged(spark, path, f"{landing_name}/step-{number}", 1.0, 1 if landing_name == "x" else 100)
    assert counts(spark, path) == {1.0: 302}


def test_ledger_stays_short():
    steps = []
    numbers = list(range(300))
    random.Random(1).shuffle(numbers)
    for number in numbers:
        steps = tables.with_step(steps, "x", number)
    assert steps == [("x", 0, 299)]


def test_a_version_that_was_stopped_is_no_version(spark, tmp_path):
    path = str(tmp_path)
    merged(spark, path, "a", 1.0, 1)

    def stopped(stored):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        tables.merge_version(spark, path, tables.LOCATIONS, "b", stopped)
    spark.range(3).write.parquet(f"{path}/version-000000002/rows")
    assert counts(spark, path) == {1.0: 1}
    merged(spark, path, "b", 1.0, 2)
    assert counts(spark, path) == {1.0: 3}


def test_first_answers_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (rng.randrange(3) / 1.0, 0.0, DAY + timedelta(seconds=rng.randrange(20)), i, f"p{i}", None, "c", "d")
        for i in range(90)
    ]
    schema = "lat_cell DOUBLE, lng_cell DOUBLE, ts TIMESTAMP_NTZ, id BIGINT, locality STRING, city STRING, countryName STRING, countryCode STRING"
    whole = sorted(map(tuple, geocode.first_seen_cell(spark.createDataFrame(rows, schema)).collect()))
    for i, order in enumerate(itertools.islice(itertools.permutations(range(4)), 0, 24, 7)):
        path = str(tmp_path / str(i))
        for part in (*order, order[0]):
            more = geocode.first_seen_cell(spark.createDataFrame(rows[part::4], schema))
            tables.merge_version(
                spark, path, tables.FIRST_ANSWERS, f"s/step-{part}",
                lambda stored, more=more: geocode.merge_first_answers(stored, more),
            )
        assert sorted(map(tuple, tables.read_version(spark, path, tables.FIRST_ANSWERS).collect())) == whole


def jobs_of(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    action()
    spark.sparkContext.setJobGroup("rest", "rest")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_late_runs_start_as_few_jobs_as_early_ones(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "lat DOUBLE, lng DOUBLE"

    def load(landed, step):
        tables.merge_version(
            spark, table, tables.LOCATIONS, step, lambda stored: tables.merge_locations(stored, landed)
        )

    def run():
        spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], schema).coalesce(1).write.mode("append").parquet(source)
        landing.load_stream(
            spark.readStream.schema(schema).parquet(source), str(tmp_path / "landing"), str(tmp_path / "state"), load
        )

    started = [jobs_of(spark, f"landing-{i}", run) for i in range(12)]
    assert len(set(started[1:])) == 1
    assert counts(spark, table) == {1.0: 24}
    assert len(tables.list_folders(spark, str(tmp_path / "landing/steps"))) == 1
    assert not [name for name in tables.list_files(spark, str(tmp_path / "landing/files")) if name.endswith(".parquet")]


def test_stop_between_done_and_deletion(spark, tmp_path, monkeypatch):
    """Files of a finished step that were not deleted in time are not loaded again."""
    source, table, schema = str(tmp_path / "in"), str(tmp_path / "table"), "lat DOUBLE, lng DOUBLE"

    def run():
        landing.load_stream(
            spark.readStream.schema(schema).parquet(source), str(tmp_path / "landing"), str(tmp_path / "state"),
            lambda landed, step: tables.append_by_day(landed.selectExpr("1L id", "DATE'2024-03-09' dt"), table),
        )

    def stopped(*args):
        raise RuntimeError("stopped")

    spark.createDataFrame([(1.0, 2.0)], schema).write.parquet(source)
    with monkeypatch.context() as patched:
        patched.setattr(landing, "_clean", stopped)
        with pytest.raises(RuntimeError):
            run()
    run()
    assert spark.read.parquet(table).count() == 1


def tables_of(spark, folder):
    read = lambda name, schema: sorted(map(str, tables.read_version(spark, f"{folder}/{name}", schema).collect()))
    days = lambda name, schema: sorted(map(str, tables.read_by_day(spark, f"{folder}/{name}", schema).collect()))
    return {
        "requests": days(served_stream.REQUESTS, tables.REQUESTS),
        "errors": days(served_stream.ERRORS, tables.ERROR_LOGS),
        "locations": read(served_stream.LOCATIONS, tables.LOCATIONS),
        "backends": read(served_stream.BACKENDS, tables.BACKEND_DAYS),
        "cells": read(served_stream.CELLS, tables.CELL_DAYS),
        "reasons": read(served_stream.REASONS, tables.REASON_DAYS),
    }


def test_served_steps_repeated_equal_the_batch(spark, tmp_path):
    log = written(mapping.access_log(spark, SF_DIR), "test-log")
    overrides = written(catalog.override_names(spark, SF_DIR), "test-overrides")
    rows = written(streams.classified_stream(log, mapping.ALLOWED_APPS), "test-classified")
    folder = str(tmp_path)
    early = rows.filter("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    late = rows.filter("ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    for part, step in ((early, 0), (early, 0), (late, 1), (late, 1)):
        served_stream.load_served(part, overrides, folder, f"l/step-{step}")
    whole = written(served.service_rows(rows, overrides), "test-service")
    facts_of = facts.request_facts(whole)
    got = tables_of(spark, folder)
    text = lambda df, names: sorted(map(str, df.select(names).collect()))
    names = lambda schema: [part.split()[0] for part in schema.split(", ")]
    assert got["requests"] == text(facts_of, names(tables.REQUESTS))
    assert got["errors"] == text(facts.error_rows(whole), names(tables.ERROR_LOGS))
    assert got["locations"] == text(reports.lifetime_locations(facts.countable(whole)), names(tables.LOCATIONS))
    assert got["backends"] == text(reports.backend_days(facts_of), names(tables.BACKEND_DAYS))
    assert got["cells"] == text(reports.cell_days(facts_of), names(tables.CELL_DAYS))
    assert got["reasons"] == text(reports.reason_days(facts_of), names(tables.REASON_DAYS))


def test_no_override_fails_without_a_cache(spark):
    rows = written(catalog.classified(spark, SF_DIR), "test-classified")
    overrides = catalog.override_names(spark, SF_DIR)
    ids = served.override_ids(rows, overrides)
    uncached = served.service_facts(rows, overrides, use_cache=False)
    named = uncached.join(ids, "id", "left_semi")
    assert named.count() == ids.count() > 0 and named.filter("status_code >= 400").isEmpty()
    rest = uncached.join(ids, "id", "left_anti").select("id", "status_code")
    assert rest.exceptAll(facts.request_facts(rows).select("id", "status_code")).isEmpty()


@pytest.mark.parametrize("days", [0, 1, 7, 30])
def test_roll_ups_equal_the_rows(spark, tmp_path, days):
    path = str(tmp_path)
    tables.append_by_day(catalog.request_rows(spark, SF_DIR), path)
    rows = tables.read_by_day(spark, path, tables.REQUESTS)
    text = lambda df: [str(row) for row in df.collect()]
    by_day = reports.windowed_locations_by_day(reports.cell_days(rows), rows, catalog.MIDDAY, days)
    assert sorted(text(by_day)) == sorted(text(reports.windowed_locations(rows, catalog.MIDDAY, days)))
    by_day = reports.failure_reasons_by_day(reports.reason_days(rows), rows, catalog.MIDDAY, days)
    assert text(by_day) == text(reports.failure_reasons(rows, catalog.MIDDAY, days))
    if days:
        daily = written(reports.cell_days(rows), "test-daily")
        plan = reports.windowed_locations_by_day(daily, rows, catalog.MIDDAY, days)._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(dt" in plan and "(dt" in plan


def test_recent_errors_read_the_newest_days_only(spark, tmp_path):
    path = str(tmp_path)
    rows = [(100 * day + i, DAY + timedelta(days=day, minutes=i), "b", 500, "e", None, None) for day in range(30) for i in range(20)]
    df = spark.createDataFrame(rows, tables.REQUESTS.removesuffix(", dt DATE")).selectExpr("*", "CAST(ts AS DATE) dt")
    tables.append_by_day(df, path)
    newest = tables.recent_days(spark, path, tables.REQUESTS, 50)
    assert newest.select("dt").distinct().count() == 3 and newest.count() == 60
    as_of = DAY + timedelta(days=40)
    assert reports.recent_errors(newest, as_of).collect() == reports.recent_errors(df, as_of).collect()
    assert tables.recent_days(spark, path, tables.REQUESTS, 10**6).count() == 600
    bounded = tables.recent_days(spark, path, tables.REQUESTS, 10**6, (DAY + timedelta(days=28)).strftime("%Y-%m-%d"))
    assert bounded.count() == 40
