"""Written steps of the road operators, read back so that Spark does not take large ones for small.

Spark takes a table's size from its files. Sorted and repeated values shrink there to a byte a row and less, but a
broadcast holds each row in some 100 bytes on the driver, so what is broadcast is decided by the rows written.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from roadpoints import session

# tables of more rows are joined by sort and merge
BROADCAST_ROWS = 100_000


def unfolded(df: DataFrame) -> DataFrame:
    """``df``, never to be broadcast in its next join, whatever size Spark takes it for: made by an explode, or compressed."""
    return df.hint("merge")


def sieved(df: DataFrame, by: DataFrame, on: Sequence[str] | Column, how: str) -> DataFrame:
    """Rows of ``df`` with (left_semi) or without (left_anti) a match in ``by``, never to be broadcast.

    Such a join forgets what ``df`` was marked with, but keeps the size that Spark took it for.
    """
    return unfolded(df.join(by, on, how))


def united(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of ``parts``; a union forgets what its tables were marked with."""
    return unfolded(reduce(DataFrame.unionByName, parts))


def cut_counting(df: DataFrame, count: Column | None = None) -> tuple[DataFrame, int]:
    """``cut`` that also returns the number of rows (or another aggregate) observed while writing."""
    seen, rows = Observation(), F.count(F.lit(1))
    out = session.cut(df.observe(seen, rows.alias("rows"), (rows if count is None else count).alias("n")))
    return unfolded(out) if seen.get["rows"] > BROADCAST_ROWS else out, int(seen.get["n"] or 0)


def cut(df: DataFrame) -> DataFrame:
    """``session.cut``, and never broadcast if it has many rows."""
    return cut_counting(df)[0]
