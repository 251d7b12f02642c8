"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
MAX_GROUPS = 10_000


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """At most ``max_rows`` rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """A hint when the size is known to be small; else the planner picks the join."""
    return F.broadcast(df) if small else df


def worked_out(df: DataFrame, max_rows: int = MAX_GROUPS) -> DataFrame:
    """A table of one row per group, computed once and broadcast from then on.

    With more groups than ``max_rows`` it stays the query it is and is joined by shuffle.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def once_per_customer(table: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows under the partitioning by customer that the next join needs anyway."""
    return table.select("cust_key", *columns).repartition("cust_key").distinct()
