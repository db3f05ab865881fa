"""Override table: place names for grid cells, from CSV text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from swellframe.functions.grid import grid_cell
from swellframe.functions.numbers import parse_float_lenient
from swellframe.sources.workspace import written


def override_table(rows: DataFrame) -> DataFrame:
    """``(line, lat, lon, name)`` text rows as one name per cell, the last row's.

    Rows with fewer than three fields are left out; coordinates that are no numbers
    count as 0.
    """
    text = lambda name: F.btrim(F.col(name), F.lit(" \t\r\n"))
    return (
        rows.filter(F.col("name").isNotNull())
        .select(
            grid_cell(parse_float_lenient(F.coalesce(text("lat"), F.lit("")))).alias("lat_cell"),
            grid_cell(parse_float_lenient(F.coalesce(text("lon"), F.lit("")))).alias("lng_cell"),
            text("name").alias("name"),
            "line",
        )
        .groupBy("lat_cell", "lng_cell")
        .agg(F.max_by("name", "line").alias("name"))
    )


def read_custom_locations(spark: SparkSession, path: str) -> DataFrame:
    """Override table of a CSV file without header: ``lat, lon, name``.

    A missing file gives an empty table. The order of lines is that of file name, block
    and position, which decides between rows of the same cell. A row with another number
    of fields than the others is read like them; see :func:`read_whole_files`.
    """
    if not _exists(spark, path):
        return override_table(spark.createDataFrame([], f"{FIELDS}, line BIGINT"))
    # A third field that is empty is read as null too, but its row is not ragged.
    name = F.when(F.col("_ragged").isNull(), F.coalesce("name", F.lit(""))).otherwise(F.col("name"))
    rows = _csv_rows(spark, path)
    return override_table(rows.select("lat", "lon", name.alias("name"), _line().alias("line")))


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Override table of CSV files of which each counts as a whole or not at all.

    All rows of a file must have as many fields as its first one; a ragged file loads
    nothing. A file whose rows all have fewer than three fields has no names, and fields
    behind the third are left out. Files are parsed once; what decides about a file is
    added up before the shuffle, one row per file.
    """
    if not _exists(spark, path):
        return override_table(spark.createDataFrame([], f"{FIELDS}, line BIGINT"))
    # What stands in quotes is no separator. The text of a row is kept only where the
    # number of its fields is not three.
    bare = F.regexp_replace("_ragged", r'"(?:[^"]|"")*"', "")
    fields = F.when(F.col("_ragged").isNull(), 3).otherwise(1 + F.length(F.regexp_replace(bare, "[^,]", "")))
    name = F.when(fields >= 3, F.coalesce("name", F.lit("")))
    parsed = _csv_rows(spark, path).select(
        "lat", "lon", name.alias("name"), fields.alias("fields"), _line().alias("line")
    )
    rows = written(parsed, "custom-location-rows").withColumn("file", F.col("line.file_path"))
    ragged = rows.groupBy("file").agg(F.min("fields").alias("least"), F.max("fields").alias("most"))
    refused = ragged.filter("least <> most").select("file")
    return override_table(rows.join(refused, "file", "left_anti"))


FIELDS = "lat STRING, lon STRING, name STRING"


def _csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files; ``_ragged`` is the text of those that have not three fields."""
    return (
        spark.read.schema(f"{FIELDS}, _ragged STRING")
        # Quotes are doubled inside quoted names, which may go over several lines. White
        # space is trimmed after that, so it can stand between quotes.
        .option("escape", '"')
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_ragged")
        .csv(path)
    )


def _line() -> Column:
    """Place of a row among all rows of the files."""
    return F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().alias("row"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    matches = files.globStatus(hadoop)
    return matches is not None and len(matches) > 0
