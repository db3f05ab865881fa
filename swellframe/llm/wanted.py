"""Bit tables of bounded size that tell a scan which 64-bit names are wanted.

They only save work: names that share a bit pass as well, and a join after the scan decides.
With more names than bits they let everything pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from swellframe.llm.batches import unused

BITS = 1 << 24
# Bits for each name of a table that tasks share, and the most there are in all (8 MB).
BITS_PER_NAME, MOST_BITS = 16, 1 << 26
# Names a task remembers to send each only once; forgetting some only sends them again.
REMEMBERED = 500_000


def wanted_table(names: DataFrame, column: str) -> np.ndarray:
    """The table for the names in a long column: at most ``BITS`` / 64 rows are read."""
    bit = F.pmod(F.col(column), F.lit(BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    rows = names.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    table = np.zeros(BITS // 64, np.uint64)
    if rows:
        table[[row["word"] for row in rows]] = np.array([row["bits"] for row in rows], np.int64).view(np.uint64)
    return table


def is_wanted(table: np.ndarray, name: int) -> bool:
    bit = name % BITS
    return bool(int(table[bit >> 6]) >> (bit & 63) & 1)


def parted(rows: DataFrame, name: Column, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose 64-bit ``name`` may be in ``names`` (a stored table of one column), and
    those whose name is not.

    The bits are one array that every task holds, so no row is shuffled. One name in sixteen
    passes by chance, more once the table has its full size.
    """
    bits = min(MOST_BITS, 1 << max(10, (BITS_PER_NAME * names.count()).bit_length()))
    place = lambda at: F.pmod(at, F.lit(bits))
    bit = place(F.col(names.columns[0]))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = names.select(F.shiftright(bit, 6).alias("word"), one.alias("bits"))
    empty = names.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = words.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "bits")))
    (column,) = unused(rows.columns, "_bits")
    table = F.broadcast(words.agg(in_order["bits"].alias(column)))
    own = place(name)
    word = F.get(table[column], F.shiftright(own, 6).cast("int"))
    there = F.getbit(word, (own % 64).cast("int")) == 1
    return rows.join(table, there, "left_semi"), rows.join(table, there, "left_anti")


class Seen:
    """Remembers the last names of a task."""

    def __init__(self):
        self.names: set[int] = set()

    def first(self, name: int) -> bool:
        if name in self.names:
            return False
        if len(self.names) >= REMEMBERED:
            self.names.clear()
        self.names.add(name)
        return True
