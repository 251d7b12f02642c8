"""Event spans: runs of flagged days, found once for all events.

A span table holds a handful of rows per event and year.  The day tables built from it
(`span_bits`, `open_bits`) hold one row per calendar day and one bit mask per event, so
asking "which spans did this customer shop" becomes an equality join on the day followed
by ``bit_or``: no range join, no row per customer and span, no distinct counts.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall import settings as S
from footfall.functions.dates import as_date, date_sql, lookback_sql

MAX_BITS = 62


def event_spans(events: DataFrame, names: list[str] = S.EVENT_NAMES, day: str = "event_dt") -> DataFrame:
    """(event, yr, start_dt, end_dt) for every run of flagged days.

    The running count of unflagged days is constant inside a run.  A run takes the year
    of its last day.  Each window partition is one event's calendar: days, not sales.
    """
    long = events.select(day, *names).unpivot([day], names, "event", "flag")
    by_day = Window.partitionBy("event").orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        long.withColumn("run", F.sum(1 - F.col("flag")).over(by_day))
        .where("flag = 1")
        .groupBy("event", "run")
        .agg(F.min(day).alias("start_dt"), F.max(day).alias("end_dt"))
        .select("event", F.year("end_dt").alias("yr"), "start_dt", "end_dt")
    )


def event_span(events: DataFrame, event: str, year: int, day: str = "event_dt") -> DataFrame:
    """Spans of one event that end in the given year."""
    return event_spans(events, [event], day).where(F.col("yr") == year).select("start_dt", "end_dt")


def target_window(
    events: DataFrame, event: str, year: int, offset_days: int = S.FEATURE_DATE_OFFSET
) -> tuple[date, date, date]:
    """(start, end, feature end) of the earliest such span: one row to the driver."""
    row = event_span(events, event, year).orderBy("start_dt").first()
    if row is None:
        raise ValueError(f"{event} has no span that ends in {year}")
    return row.start_dt, row.end_dt, row.start_dt - timedelta(days=offset_days)


def spans_in_lookback(spans: DataFrame, feature_end: date, years: int = 4) -> DataFrame:
    return spans.where(lookback_sql("end_dt", feature_end, years))


def spans_in_years(spans: DataFrame, first: int, last: int) -> DataFrame:
    return spans.where(F.col("yr").between(first, last) & F.year("start_dt").between(first, last))


def number_spans(spans: DataFrame) -> DataFrame:
    """Adds ``bit``, the position of a span among its event's spans in date order, and ``name``.

    A mask holds MAX_BITS + 1 spans.  The first of an event goes by the event's name, further
    ones by the name and their number, and ``bit`` starts anew in each.
    """
    order = Window.partitionBy("event").orderBy("start_dt", "end_dt")
    placed = spans.withColumn("_place", F.row_number().over(order) - 1).withColumn("_mask", F.floor(F.col("_place") / (MAX_BITS + 1)))
    name = F.when(F.col("_mask") == 0, F.col("event")).otherwise(F.concat_ws("_", "event", "_mask"))
    return placed.select(*spans.columns, (F.col("_place") % (MAX_BITS + 1)).alias("bit"), name.alias("name"))


def number_years(spans: DataFrame, first_year: int) -> DataFrame:
    """Adds ``bit``: the year counted from ``first_year``, shared by spans of one year."""
    return spans.withColumn("bit", F.col("yr") - first_year).withColumn("name", F.col("event"))


def _masks(days: DataFrame, names: list[str], suffix: str) -> DataFrame:
    """A bit per span and event; `number_spans` and `number_years` keep bits below 63."""
    checked = f"if(bit between 0 and {MAX_BITS}, shiftleft(1L, bit), raise_error('too many spans of one event'))"
    masks = [F.expr(f"coalesce(bit_or(if(name = '{e}', mask, null)), 0L) as {e}{suffix}") for e in names]
    return days.withColumn("mask", F.expr(checked)).groupBy("span_day").agg(*masks)


def span_bits(numbered: DataFrame, names: list[str] = S.EVENT_NAMES, suffix: str = "_bits") -> DataFrame:
    """Per day and event, the bits of the spans that contain the day."""
    days = numbered.select("name", "bit", F.explode(F.sequence("start_dt", "end_dt")).alias("span_day"))
    return _masks(days, names, suffix)


def open_bits(
    numbered: DataFrame, first_day: date, names: list[str] = S.EVENT_NAMES, suffix: str = "_open"
) -> DataFrame:
    """Per day and event, the bits of the spans that end on the day or later.

    Days start at ``first_day``; look earlier days up under it (`clamp_day`), since every
    span ends on or after it.  Days after the last span have no row.
    """
    later = numbered.where(F.col("end_dt") >= as_date(first_day))
    days = later.select("name", "bit", F.explode(F.sequence(as_date(first_day), F.col("end_dt"))).alias("span_day"))
    return _masks(days, names, suffix)


def clamp_day_sql(day: str, first_day: date) -> str:
    """``day``, but not before ``first_day``; null stays null."""
    return f"if({day} < {date_sql(first_day)}, {date_sql(first_day)}, {day})"
