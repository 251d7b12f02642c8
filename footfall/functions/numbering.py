"""Consecutive numbers in an order, without bringing a group or the table into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.sources.staging import materialize

#: Bits of `monotonically_increasing_id` that number the rows of a task.
ROW_BITS = 33


def numbered(df: DataFrame, order: Sequence[str], within: Sequence[str] = (), name: str = "position", size: str | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... by ``order`` (ascending, nulls first) among rows equal in ``within``.

    Rows are dealt out by ranges of (within, order) and stored; each range counts its rows per
    group, and the counts of the ranges before are added.  A group or a value may have any number
    of rows: rows that are equal in all columns of the order are spread over ranges and numbered
    in an arbitrary order.  ``size`` names a column for the number of rows of the group.
    """
    columns = df.columns
    at, tie, part, shift = (_unused(columns, c) for c in ("_at", "_tie", "_part", "_shift"))
    keys = [F.col(c).asc() for c in [*within, *order, tie]]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialize(ranged.drop(tie).withColumn(at, F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn(part, F.shiftright(at, ROW_BITS))

    counts = rows.groupBy(part, *within).agg(F.min(at).alias(at), F.count(F.lit(1)).alias(shift))
    group = Window.partitionBy(*within)  # at most one row per range of the group
    before = F.coalesce(F.sum(shift).over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = [(before - F.col(at)).alias(shift)]
    if size:
        sums.append(F.sum(shift).over(group).alias(size))
    starts = counts.select(part, *within, *sums)

    r, s = rows.alias("r"), starts.alias("s")
    on = F.col(f"r.{part}") == F.col(f"s.{part}")
    for c in within:
        on &= F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    added = [(F.col(f"r.{at}") + F.col(f"s.{shift}")).alias(name)]
    if size:
        added.append(F.col(f"s.{size}"))
    return r.join(s, on).select(*[F.col(f"r.{c}") for c in columns], *added)


def _unused(columns: Sequence[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name
