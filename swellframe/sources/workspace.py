"""Folders for checkpoints and working tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

from swellframe.session import SETTINGS


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """Folder that every executor can reach.

    ``folder`` if given, else ``spark.checkpoint.dir``. Where neither is set, a folder
    under ``spark.sql.warehouse.dir``, which a cluster keeps on shared storage.
    """
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return folder.rstrip("/")


# Folders that this process has given out and not deleted.
_GIVEN: set[str] = set()


def fresh_folder(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new, unused path under the shared folder."""
    path = f"{shared_folder(spark, folder)}/swellframe/{name}-{uuid.uuid4().hex}"
    _GIVEN.add(path)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as a table under the shared folder and read back.

    This cuts the lineage, survives lost executors, and tells the planner the true size. The
    shuffle files behind the table are deleted as soon as it stands.
    """
    spark = rows.sparkSession
    folder = fresh_folder(spark, name)
    with _set(spark, _FREED, "true"):
        rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def compiled(spark: SparkSession) -> AbstractContextManager[None]:
    """What runs meanwhile, and streams that start, is generated as methods that the JVM compiles,
    whatever the session says (see ``session.SETTINGS``)."""
    return _set(spark, _METHOD_LIMIT, SETTINGS[_METHOD_LIMIT])


def written_compiled(rows: DataFrame, name: str) -> DataFrame:
    """:func:`written` for rows made by large expressions, such as classified requests."""
    with compiled(rows.sparkSession):
        return written(rows, name)


@contextmanager
def only_kept(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function like :func:`written`; at the end every other folder that was given
    out meanwhile is deleted, so what is lazy and reads one must be written by then."""
    before, kept = set(_GIVEN), set()

    def keep(rows: DataFrame, name: str) -> DataFrame:
        known = set(_GIVEN)
        table = written(rows, name)
        kept.update(_GIVEN - known)
        return table

    yield keep
    delete_given(spark, _GIVEN - before - kept)


def delete_working_tables(spark: SparkSession) -> None:
    """Deletes every folder that :func:`fresh_folder` gave to this process.

    Results are lazy and read these tables, so call it once they have been written or read.
    """
    delete_given(spark, set(_GIVEN))


def given_folders() -> set[str]:
    """The folders that this process has given out and not deleted."""
    return set(_GIVEN)


def delete_given(spark: SparkSession, folders: set[str]) -> None:
    """Deletes some of the folders that :func:`fresh_folder` gave to this process."""
    for path in sorted(folders & _GIVEN):
        delete_folder(spark, path)
    _GIVEN.difference_update(folders)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a working table that this library has written, on any file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
