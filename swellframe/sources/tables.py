"""Day-partitioned log tables and the running location counters."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from swellframe.functions.times import RETENTION_DAYS, cutoff, cutoff_date
from swellframe.sources.workspace import delete_folder

REQUESTS = (
    "id BIGINT, ts TIMESTAMP_NTZ, backend STRING, status_code INT, error_type STRING, "
    "lat DOUBLE, lng DOUBLE, dt DATE"
)
ERROR_LOGS = (
    "id BIGINT, ts TIMESTAMP_NTZ, method STRING, path STRING, query STRING, "
    "status_code INT, request_body STRING, response_body STRING, "
    "upstream_response STRING, backend STRING, error_type STRING, dt DATE"
)
LOCATIONS = "lat DOUBLE, lng DOUBLE, count BIGINT"
BACKEND_DAYS = "dt DATE, backend STRING, success BIGINT, failed BIGINT"
CELL_DAYS = "dt DATE, lat DOUBLE, lng DOUBLE, count BIGINT"
REASON_DAYS = "dt DATE, reason STRING, count BIGINT"
FIRST_ANSWERS = (
    "lat_cell DOUBLE, lng_cell DOUBLE, first_ts TIMESTAMP_NTZ, first_id BIGINT, "
    "locality STRING, city STRING, countryName STRING, countryCode STRING"
)
CUT_OFFS = "kept_from TIMESTAMP_NTZ"
# Steps that a version holds, as ranges of numbers per landing.
LEDGER = "landing STRING, first BIGINT, last BIGINT"


def append_by_day(rows: DataFrame, path: str) -> None:
    """Append rows to a table partitioned by ``dt``.

    Rows are spread by day and by a hash of the id, so that a day goes to several
    writers and one of them does not open every day's file. Adaptive execution splits
    or joins the tasks to a fair size.
    """
    spread = rows.withColumn("_spread", F.pmod(F.xxhash64("id"), F.lit(64)))
    spread.hint("rebalance", "dt", "_spread").drop("_spread").write.mode("append").partitionBy(
        "dt"
    ).parquet(path)


def read_by_day(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Table written by :func:`append_by_day`."""
    return spark.read.schema(schema).parquet(path)


def missing_rows(rows: DataFrame, path: str, schema: str) -> DataFrame:
    """Rows whose id a day table does not have on their day; only their days are read."""
    spark = rows.sparkSession
    if not exists(spark, path):
        return rows
    days = [row["dt"] for row in rows.select("dt").distinct().collect()]
    table = read_by_day(spark, path, schema).filter(F.col("dt").isin(days))
    return rows.join(table.select("id", "dt"), ["id", "dt"], "left_anti")


def append_missing(rows: DataFrame, path: str, schema: str) -> None:
    """Append the rows that the table does not have yet, so that a rerun adds nothing."""
    names = [column.split()[0] for column in schema.split(", ")]
    append_by_day(missing_rows(rows, path, schema).select(names), path)


def merge_sums(counts: DataFrame, more: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Two tables of counts as one. Both are added up before the shuffle."""
    return counts.unionByName(more).groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sums])


Steps = list[tuple[str, int, int]]


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Finished versions of a table as (number, folder), the newest last."""
    found = []
    for folder, name in list_folders(spark, path):
        if name.startswith("version-") and exists(spark, f"{folder}/applied/_SUCCESS"):
            found.append((int(name.removeprefix("version-")), folder))
    return sorted(found)


def _applied(spark: SparkSession, version: tuple[int, str] | None) -> Steps:
    """The steps that a version holds. Numbers of a landing follow each other, so they are few
    ranges however many steps there were."""
    if version is None:
        return []
    return [tuple(row) for row in spark.read.schema(LEDGER).parquet(f"{version[1]}/applied").collect()]


def _step(source: str) -> tuple[str, int]:
    """Landing and number of a step named ``<landing>/step-<number>``; other names are their own."""
    landing, _, number = source.rpartition("/step-")
    return (landing, int(number)) if landing and number.isdigit() else (source, 0)


def _holds(steps: Steps, landing: str, number: int) -> bool:
    return any(name == landing and first <= number <= last for name, first, last in steps)


def with_step(steps: Steps, landing: str, number: int) -> Steps:
    """The ranges with one more number, neighbouring ones joined."""
    out: Steps = []
    for name, first, last in sorted([*steps, (landing, number, number)]):
        if out and out[-1][0] == name and first <= out[-1][2] + 1:
            out[-1] = (name, out[-1][1], max(last, out[-1][2]))
        else:
            out.append((name, first, last))
    return out


def read_version(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version of a table written by :func:`merge_version`; empty without one."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{versions[-1][1]}/rows")


def merge_version(
    spark: SparkSession, path: str, schema: str, source: str, merge: Callable[[DataFrame], DataFrame]
) -> None:
    """Write ``merge`` of the table as its next version.

    ``source`` names the step that is merged. Every version keeps the set of the steps that it
    holds, so whatever the order and however often, each counts once: the step of the newest
    version is merged anew into the version before it, an older one is left out. The newest
    version and its base stay, others are deleted.
    """
    versions = _versions(spark, path)
    newest = versions[-1] if versions else None
    base, steps = newest, _applied(spark, newest)
    landing, number = _step(source)
    if _holds(steps, landing, number):
        base = versions[-2] if len(versions) > 1 else None
        steps = _applied(spark, base)
        if _holds(steps, landing, number) or (base is None and newest[0] > 1):
            return
    rows = spark.read.schema(schema).parquet(f"{base[1]}/rows") if base else spark.createDataFrame([], schema)
    folder = f"{path}/version-{newest[0] + 1 if newest else 1:09d}"
    delete_folder(spark, folder)  # what an attempt that was stopped has left
    merge(rows).write.parquet(f"{folder}/rows")
    ledger = spark.createDataFrame(with_step(steps, landing, number), LEDGER)
    ledger.coalesce(1).write.parquet(f"{folder}/applied")
    for version in versions:
        if version != base:
            delete_folder(spark, version[1])


def merge_locations(counters: DataFrame, batch: DataFrame) -> DataFrame:
    """Counters with the cells of a batch of countable requests added.

    The batch is counted before the union, and sums are merged before the shuffle, so a
    hot cell costs no more than any other.
    """
    counted = batch.groupBy("lat", "lng").agg(F.count("*").alias("count"))
    return (
        counters.unionByName(counted)
        .groupBy("lat", "lng")
        .agg(F.sum("count").alias("count"))
    )


def recent_days(spark: SparkSession, path: str, schema: str, rows: int, first_day: str | None = None) -> DataFrame:
    """The newest days of a day table that have ``rows`` rows together, or all from ``first_day``
    (as text) on. Days are counted from the newest back; older ones are not read."""
    days, found = [], 0
    for folder, day in reversed(_day_folders(spark, path)):
        if found >= rows or (first_day and day < first_day):
            break
        found += spark.read.parquet(folder).limit(rows - found).count()
        days.append(day)
    table = read_by_day(spark, path, schema)
    return table.filter(F.col("dt").isin([F.lit(day).cast("date") for day in days]) if days else F.lit(False))


def backfill_timestamp(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Rows with the load time where ``ts`` is null."""
    return rows.withColumn("ts", F.coalesce("ts", cutoff(as_of, 0))).withColumn(
        "dt", F.col("ts").cast("date")
    )


def evolve_schema(current: DataFrame, *older: DataFrame) -> DataFrame:
    """Union of tables of several ages; columns an older one lacks are null."""
    for table in older:
        current = current.unionByName(table, allowMissingColumns=True)
    return current


def keep_recent(rows: DataFrame, as_of: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows that retention keeps."""
    return rows.filter(F.col("ts") >= cutoff(as_of, days))


def drop_expired(
    spark: SparkSession, path: str, schema: str, as_of: datetime, days: int = RETENTION_DAYS
) -> None:
    """Delete the rows of a day-partitioned table that are older than ``days``.

    Days before the cut-off are dropped as folders, without reading them. Only the day
    of the cut-off is read and written again.
    """
    boundary = read_by_day(spark, path, schema).filter(F.col("dt") == cutoff_date(as_of, days))
    kept = keep_recent(boundary, as_of, days)
    if boundary.filter(F.col("ts") < cutoff(as_of, days)).isEmpty():
        rewritten = True
    else:
        rewritten = not kept.isEmpty()
        if rewritten:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "dt"
            ).parquet(path)
    bound = (as_of.replace(microsecond=0) - timedelta(days=days)).strftime("%Y-%m-%d")
    for folder, day in _day_folders(spark, path):
        if day < bound or (day == bound and not rewritten):
            delete_folder(spark, folder)


def _cut_offs(spark: SparkSession, path: str) -> list[tuple[datetime, str]]:
    """Finished cut-offs of a day table as (time, folder), the newest last."""
    found = []
    for folder, name in list_folders(spark, f"{path}/_kept"):
        if name.startswith("from-") and exists(spark, f"{folder}/_SUCCESS"):
            found.append((datetime.strptime(name.removeprefix("from-"), "%Y%m%dT%H%M%S"), folder))
    return sorted(found)


def read_kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a day table from the cut-off of :func:`move_cut_off` on; all without one.

    The cut-off is a constant, so days before it are not listed, and it reaches the scan of
    its own day.
    """
    rows = read_by_day(spark, path, schema)
    cut_offs = _cut_offs(spark, path)
    if not cut_offs:
        return rows
    kept_from = cut_offs[-1][0]
    return rows.filter(
        (F.col("dt") >= F.lit(kept_from.date())) & (F.col("ts") >= F.lit(kept_from).cast("timestamp_ntz"))
    )


def move_cut_off(
    spark: SparkSession, path: str, schema: str, as_of: datetime, days: int = RETENTION_DAYS
) -> None:
    """Let a day table begin ``days`` before ``as_of`` for every reader from now on.

    The cut-off is a small table beside the days, named after its time, and counts once its
    write has finished: a reader sees the old rows or the new ones, never a day that is
    half written. No day is written again. Folders are deleted one step later, when all of
    their day is before the cut-off of the step before, so that a read planned before this step
    still finds its files. A cut-off never goes back, and rows that arrive behind it stay
    hidden. Tables are either kept this way or by :func:`drop_expired`, not both.
    """
    kept_from = as_of.replace(microsecond=0) - timedelta(days=days)
    before = _cut_offs(spark, path)
    if before and kept_from <= before[-1][0]:
        return
    folder = f"{path}/_kept/from-{kept_from:%Y%m%dT%H%M%S}"
    spark.createDataFrame([(kept_from,)], CUT_OFFS).coalesce(1).write.mode("overwrite").parquet(folder)
    if before:
        bound = f"{before[-1][0]:%Y-%m-%d}"
        for folder, day in _day_folders(spark, path):
            if day < bound:
                delete_folder(spark, folder)
    for _, folder in before:
        delete_folder(spark, folder)


def exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = _files(spark, path)
    return files.exists(hadoop)


def list_folders(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(folder, name) of the folders in a folder, none if it is missing."""
    files, hadoop = _files(spark, path)
    if not files.exists(hadoop):
        return []
    folders = [status.getPath() for status in files.listStatus(hadoop) if status.isDirectory()]
    return sorted((str(folder), folder.getName()) for folder in folders)


def list_files(spark: SparkSession, path: str) -> set[str]:
    """Names of the files in a folder, none if it is missing."""
    files, hadoop = _files(spark, path)
    if not files.exists(hadoop):
        return set()
    return {status.getPath().getName() for status in files.listStatus(hadoop) if status.isFile()}


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _day_folders(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(folder, day) of every partition: one entry a day, file names are not listed."""
    named = list_folders(spark, path)
    return [(folder, name[3:]) for folder, name in named if name.startswith(("dt=1", "dt=2"))]
