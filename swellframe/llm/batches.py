"""Arrow batches of whole texts, handled a few at a time to bound memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

# Rows handled at once in Python. Texts may be long, so a batch of Spark's default size
# is cut up before its texts become Python objects.
ROWS = 256


# Bytes of the texts handled at once, unless one row alone has more.
BYTES = 16 << 20


def slices(batch: pa.RecordBatch, rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and so many bytes of text."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    upto = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        before = upto[start] - size[start]
        end = min(start + rows, int(np.searchsorted(upto, before + most, side="right")))
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def map_batches(
    df: DataFrame,
    keep: Sequence[str],
    read: Sequence[str],
    add: Sequence[StructField],
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
    rows: int = ROWS,
    most: int = BYTES,
) -> DataFrame:
    """Columns ``keep`` of ``df`` and the new columns ``add``, row by row.

    ``make`` runs once per task and gives the function that takes the ``read`` columns of
    some rows as Python lists and returns one array per added column. Only the named
    columns are read, so others may have any name. Nulls reach the function as ``None``.
    """
    keep, read = list(keep), list(read)
    schema = StructType([df.schema[name] for name in keep] + list(add))
    chosen = df.select(*[df[name] for name in dict.fromkeys([*keep, *read])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, rows, most):
                new = work(*[part.column(name).to_pylist() for name in read])
                kept = [part.column(name) for name in keep]
                yield pa.RecordBatch.from_arrays([*kept, *new], schema.names)

    return chosen.mapInArrow(run, schema)


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it differ from ``columns``,
    whose case does not count."""
    taken, out = {column.lower() for column in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
