from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from swellframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("swellframe-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    )
    session = build_session(builder)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def log_rows(spark):
    """Makes access log rows from dicts; columns left out are null."""
    from swellframe.sources.access_log import ACCESS_LOG

    names = [part.split()[0] for part in ACCESS_LOG.split(", ")]

    def make(*rows: dict):
        filled = [
            tuple({"id": i, "method": "GET", **row}.get(name) for name in names)
            for i, row in enumerate(rows)
        ]
        return spark.createDataFrame(filled, ACCESS_LOG)

    return make
