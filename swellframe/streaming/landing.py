"""Streams that end in tables which batch jobs read, add to and clean up.

A file sink keeps its own list of files, so that retention and batch appends do not go
together with it. A run therefore streams into a landing folder, and a batch step then loads
the files that have landed since the last step. A step is planned (its files are written
down), loaded, and marked as done; then its files and its plan are deleted, and the mark takes
the place of those of all earlier steps. So a run reads one plan at most, however many there
were before. After a stop at any point the next run repeats the step that is not done, with
the same files and the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from swellframe.sources.tables import exists, list_files, list_folders
from swellframe.sources.workspace import compiled, delete_folder


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that appends a stream to Parquet until all given input is read."""
    with compiled(rows.sparkSession):
        return (
            rows.writeStream.format("parquet")
            .outputMode("append")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def load_stream(
    rows: DataFrame, landing: str, checkpoint: str, load: Callable[[DataFrame, str], None]
) -> None:
    """Stream all given input into the folder ``landing`` and load what is new in it.

    ``load`` takes the landed rows and the name of their step, ``<landing>/step-<number>``.
    Called again with the same step it must end in the same table. Everything is kept in the
    folders ``files`` and ``steps`` of ``landing``.
    """
    spark, files, steps = rows.sparkSession, f"{landing}/files", f"{landing}/steps"
    append_stream(rows, files, checkpoint).awaitTermination()
    done = max([-1, *_numbers(spark, steps, "done")])
    for number in _numbers(spark, steps, "step"):
        if number <= done:  # stopped before its files were deleted
            _clean(spark, steps, number)
        else:
            _run(spark, rows, landing, number, load)
            done = number
    present = list_files(spark, files)
    if new := sorted(file for file in spark.read.schema(rows.schema).parquet(files).inputFiles() if _name(file) in present):
        plan = spark.createDataFrame([(file,) for file in new], "file STRING")
        plan.coalesce(1).write.mode("overwrite").parquet(f"{steps}/step-{done + 1:09d}")
        _run(spark, rows, landing, done + 1, load)


def _run(spark: SparkSession, rows: DataFrame, landing: str, number: int, load: Callable[[DataFrame, str], None]) -> None:
    steps = f"{landing}/steps"
    load(spark.read.schema(rows.schema).parquet(*_planned(spark, steps, number)), f"{landing}/step-{number}")
    spark.range(0).write.mode("overwrite").parquet(f"{steps}/done-{number:09d}")
    _clean(spark, steps, number)


def _clean(spark: SparkSession, steps: str, number: int) -> None:
    """Deletes what a finished step has read, its plan, and the marks before its own."""
    for file in _planned(spark, steps, number):
        delete_folder(spark, file)
    delete_folder(spark, f"{steps}/step-{number:09d}")
    for earlier in _numbers(spark, steps, "done"):
        if earlier < number:
            delete_folder(spark, f"{steps}/done-{earlier:09d}")


def _planned(spark: SparkSession, steps: str, number: int) -> list[str]:
    plan = spark.read.schema("file STRING").parquet(f"{steps}/step-{number:09d}")
    return sorted(row["file"] for row in plan.collect())


def _numbers(spark: SparkSession, steps: str, kind: str) -> list[int]:
    """Numbers of the steps that are completely planned, or done."""
    return sorted(
        int(name.removeprefix(f"{kind}-"))
        for folder, name in list_folders(spark, steps)
        if name.startswith(f"{kind}-") and exists(spark, f"{folder}/_SUCCESS")
    )


def _name(file: str) -> str:
    return file.rsplit("/", 1)[-1]
