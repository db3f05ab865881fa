"""Values that are computed once per row, whatever uses them later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_plain_column(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with ``value`` as a column that the optimizer does not look into.

    A projected expression is inlined into every filter that is pushed below it, and
    parsing a body or a query again for each use is costly. The value is projected first,
    where generated code computes it, and then passes through a one-element explode,
    which makes it a plain attribute.
    """
    projected = rows.withColumn("_value", value)
    return projected.select("*", F.explode_outer(F.array("_value")).alias(name)).drop("_value")
