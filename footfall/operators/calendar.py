"""Retail calendar: fiscal days, yearly holidays, daily event flags and their rollups.

Calendars are small by construction (one row per day), so every join here is between a
few thousand rows; ``broadcast`` is used only on tables of one row per year or per day.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import settings as S
from footfall.functions.dates import as_date, fiscal_columns, holiday_columns


def calendar_days(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per day, both ends included."""
    n_days = (end - start).days + 1
    return spark.range(0, n_days, 1, 1).select(F.date_add(as_date(start), F.col("id").cast("int")).alias("day_dt"))


def observed_days(trans: DataFrame, day: str = "sale_dt") -> DataFrame:
    """Every day of the calendar years that the transactions fall in."""
    span = trans.agg(
        F.trunc(F.min(day), "year").alias("first"),
        F.date_sub(F.add_months(F.trunc(F.max(day), "year"), 12), 1).alias("last"),
    )
    return span.select(F.explode(F.sequence("first", "last")).alias("day_dt"))


def calendar_454(days: DataFrame) -> DataFrame:
    fiscal = fiscal_columns("day_dt")
    return days.select("day_dt", *[c.cast("int").alias(name) for name, c in fiscal.items()])


def extra_week(calendar: DataFrame) -> DataFrame:
    """Calendar years that follow a 53-week fiscal year get a shift of one week."""
    return (
        calendar.where("mth_454 = 12")
        .groupBy((F.col("yr_454") + 1).alias("yr_cal"))
        .agg(F.when(F.max("wk_454") == 5, 1).otherwise(0).alias("shift_wk"))
    )


def easter_sundays(spark: SparkSession, legacy_easter: bool = False) -> DataFrame:
    sundays = [S.LEGACY_EASTER_2024 if legacy_easter and d.year == 2024 else d for d in S.EASTER_SUNDAYS]
    return spark.createDataFrame([(d.year, d) for d in sundays], "yr_cal int, easter date")


def yearly_holidays(days: DataFrame, legacy_easter: bool = False) -> DataFrame:
    """One row per calendar year; Easter is null in years outside the list."""
    years = days.select(F.year("day_dt").alias("yr_cal")).distinct()
    dated = years.select("yr_cal", *[c.alias(name) for name, c in holiday_columns(F.col("yr_cal")).items()])
    easters = F.broadcast(easter_sundays(days.sparkSession, legacy_easter))
    return dated.join(easters, "yr_cal", "left").select("yr_cal", *S.HOLIDAY_COLUMNS)


def _anchor(name: str) -> Column:
    """A holiday column, or a date that follows from the year."""
    if name == "epiphany_sunday":
        return F.next_day("new_years_day", "Sun")
    if name.startswith("month_end_"):
        return F.last_day(F.make_date("yr_cal", F.lit(int(name[-2:])), F.lit(1)))
    if name.startswith("month_"):
        return F.make_date("yr_cal", F.lit(int(name[-2:])), F.lit(1))
    return F.col(name)


def _event_condition(event: str) -> Column:
    """Whether a day belongs to the event: any of its windows, less its excluded days."""
    day, year = F.col("day_dt"), F.col("yr_cal")
    windows = []
    for w in S.FISCAL_WINDOWS:
        if w.event == event:
            week = F.col("wk_454") + F.col("shift_wk") if w.shifted else F.col("wk_454")
            position = F.col("mth_454") * 100 + week * 10 + F.col("day_454")
            windows.append(year.between(w.first, w.last) & position.between(w.lo, w.hi))
    for h in S.HOLIDAY_WINDOWS:
        if h.event == event:
            inside = day.between(F.date_add(_anchor(h.start), h.lo), F.date_add(_anchor(h.end), h.hi))
            windows.append(year.between(h.first, h.last) & inside)
    for name, first, last in S.DATED_WINDOWS:
        if name == event:
            windows.append(day.between(as_date(first), as_date(last)))
    condition = reduce(lambda a, b: a | b, windows)
    for name, excluded in S.EXCLUDED_DAYS:
        if name == event:
            condition = condition & (day != as_date(excluded))
    return condition


def event_calendar(calendar: DataFrame, holidays: DataFrame, shifts: DataFrame) -> DataFrame:
    """Daily 0/1 event flags from the fiscal calendar, the holidays and the week shift."""
    dated = (
        calendar.withColumn("yr_cal", F.year("day_dt"))
        .join(F.broadcast(holidays), "yr_cal")
        .join(F.broadcast(shifts), "yr_cal")
    )
    flags = [F.when(_event_condition(e), 1).otherwise(0).alias(e) for e in S.CALENDAR_FLAGS]
    return dated.select("day_dt", *flags)


def event_rollups(flags: DataFrame) -> DataFrame:
    """Adds the rollup flags (any of several events) and their intersections."""
    anyof = flags.select("*", *[F.greatest(*members).alias(name) for name, members in S.ROLLUPS.items()])
    return anyof.select("*", *[F.least(*members).alias(name) for name, members in S.ROLLUP_PAIRS.items()])


def build_event_calendar(
    days: DataFrame, legacy_easter: bool = False, lookup: DataFrame | None = None, stamp: bool = False
) -> DataFrame:
    """The whole lookup table: flags, rollups and, with ``stamp``, the load time.

    ``lookup`` is the day table that holds the fiscal weeks of the year before the first
    day, which the week shift needs; without one the same days one year earlier are used.
    """
    if lookup is None:
        # a year earlier is enough: the shift of a year reads month 12 of the year before
        earlier = days.select(F.add_months("day_dt", -12).alias("day_dt"))
        lookup = calendar_454(days.union(earlier).distinct())
    shifts = extra_week(lookup)
    table = event_rollups(event_calendar(calendar_454(days), yearly_holidays(days, legacy_easter), shifts))
    return table.withColumn("data_last_updated", F.current_timestamp()) if stamp else table


def default_event_calendar(spark: SparkSession, end: date, start: date = S.CALENDAR_START) -> DataFrame:
    """Event calendar by date range, under the column name the feature steps read."""
    days = calendar_days(spark, start, end)
    lookup = calendar_454(calendar_days(spark, date(start.year - 1, 1, 1), date(end.year + 1, 12, 31)))
    return build_event_calendar(days, lookup=lookup).withColumnRenamed("day_dt", "event_dt")
