"""Per-customer features from customer-day rollups.

`customer_profile` reads the lines once, joins the rollup to the acquisition dates once
and groups by customer once, for as many feature groups as are asked for.  The separate
feature tables ask for one group each; the feature matrix asks for all of them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import settings as S
from footfall.functions.dates import date_sql, lookback_sql
from footfall.functions.joins import broadcast_if, is_small, worked_out
from footfall.operators import spans as SP
from footfall.operators.population import non_employees, post_acquisition, qualifies_sql
from footfall.operators.rollup import (
    COUNT_MEASURES,
    DISTINCT_MEASURES,
    FULL_LINE,
    SPEND_MEASURES,
    customer_days,
    last_seen_days,
)
from footfall.sources.retail import RetailTables


def with_event_flags(days: DataFrame, events: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Adds the modelled flags of a sale day.

    ``small`` says that the calendar, one row per day, was counted and may be broadcast;
    the span tables below have no more days than it has, so it holds for them as well.
    """
    calendar = broadcast_if(small, events.select("event_dt", *S.EVENT_NAMES))
    return days.join(calendar, F.col("sale_dt") == F.col("event_dt"), how)


def lookback_spans(events: DataFrame, feature_end: date) -> DataFrame:
    """Spans of the 4-year look-back, with the year as bit: some 60 rows, worked out once."""
    spans = SP.spans_in_lookback(SP.event_spans(events), feature_end)
    return worked_out(SP.number_years(spans, feature_end.year - 4))


def with_span_bits(days: DataFrame, numbered: DataFrame, small: bool, names: list[str] = S.EVENT_NAMES) -> DataFrame:
    """Adds, per event, the bits of the spans a sale day falls in (null on other days)."""
    bits = broadcast_if(small, SP.span_bits(numbered, names))
    return days.join(bits, F.col("sale_dt") == F.col("span_day"), "left").drop("span_day")


def with_open_bits(
    customers: DataFrame, numbered: DataFrame, first_day: date, small: bool, names: list[str] = S.EVENT_NAMES
) -> DataFrame:
    """Adds, per event, the bits of the spans that end on or after the acquisition date."""
    bits = broadcast_if(small, SP.open_bits(numbered, first_day, names))
    on = F.expr(SP.clamp_day_sql("acq_dt", first_day)) == F.col("span_day")
    return customers.join(bits, on, "left").drop("span_day")


# --- SQL text of the aggregates over customer-days ---------------------------------


def spend_share_aggregates(days: str = "true") -> dict[str, str]:
    """Spend on each event's days, and in total, over days the calendar knows and ``days`` admits."""
    known = f"event_dt is not null and {days}"
    spend = {f"{e.short_event}_event_spend": f"sum(if({e.event} = 1 and {days}, fl_spend, 0L))" for e in S.MODELLED_EVENTS}
    spend["calendar_spend"] = f"sum(if({known}, fl_spend, null))"
    spend["calendar_items"] = f"sum(if({known}, fl_items, null))"
    return spend


def spend_share_columns() -> dict[str, str]:
    """Shares with ten decimals; null where the spend nets to zero."""
    return {
        f"{short}_pct_spend": f"round(try_divide(cast({short}_event_spend as double), cast(calendar_spend as double)), 10)"
        for short in S.SHORT_NAMES
    }


def shopped_bits_aggregates(shopped: str) -> dict[str, str]:
    return {f"{e}_shopped": f"bit_or(if({shopped}, {e}_bits, null))" for e in S.EVENT_NAMES}


def shopped_share_columns() -> dict[str, str]:
    """Years of an event that were shopped over years the customer could have shopped."""
    return {
        f"{e.short_event}_pct_shopped": f"if(coalesce({e.event}_open, 0L) = 0, 0D, round(cast("
        f"bit_count(coalesce({e.event}_shopped, 0L)) as double) / bit_count({e.event}_open), 10))"
        for e in S.MODELLED_EVENTS
    }


def shopped_last_year_aggregates(recent: str) -> dict[str, str]:
    return {f"{e.short_event}_shopped_ind": f"max(if({recent}, {e.event}, null))" for e in S.MODELLED_EVENTS}


def stats_aggregates(feature_end: date) -> dict[str, str]:
    """Counts, spend (cents), breadth and recency over days of the look-back."""
    last_year = lookback_sql("sale_dt", feature_end, 1)
    return {
        **{m: f"sum({m})" for m in COUNT_MEASURES + SPEND_MEASURES + DISTINCT_MEASURES},
        "fl_last_sale_dt": "max(if(fl_items > 0, sale_dt, null))",
        "fl_shopped_ly_ind": f"max(if({last_year} and fl_items > 0, 1, 0))",
        "fl_spend_ly": f"sum(if({last_year}, fl_spend, 0L))",
        "fl_trips_ly": f"sum(if({last_year}, fl_trips, 0L))",
    }


def named(expressions: dict[str, str]) -> list[Column]:
    return [F.expr(f"{text} as {name}") for name, text in expressions.items()]


# --- the one pass ---------------------------------------------------------------------

SPEND, SPEND_LY, SHOPPED, LAST_YEAR, STATS = "spend", "spend_ly", "shopped", "last_year", "stats"
ALL_GROUPS = (SPEND, SHOPPED, LAST_YEAR, STATS)


def customer_profile(
    tables: RetailTables,
    events: DataFrame,
    feature_end: date,
    groups: tuple[str, ...] = ALL_GROUPS,
    target: tuple[date, date] | None = None,
) -> DataFrame:
    """One row per customer of the base population, with the aggregates of ``groups``.

    Work on transaction lines: one scan summed to customer-days and, for the distinct
    counts of ``stats``, one narrow scan of the look-back.  Everything after that is
    joined and grouped by customer under a single partitioning.
    """
    small = bool({SPEND, SPEND_LY, SHOPPED, LAST_YEAR} & set(groups)) and is_small(events)
    in_window = lookback_sql("sale_dt", feature_end, 4)
    needed = in_window
    if target is not None:
        in_target = f"sale_dt between {date_sql(target[0])} and {date_sql(target[1])}"
        needed = f"{in_window} or {in_target}"
    facts = customer_days(tables.trans, by_day=needed)
    if STATS in groups:
        lookback = tables.trans.where(in_window)
        facts = facts.unionByName(last_seen_days(lookback), allowMissingColumns=True)

    measures = COUNT_MEASURES + SPEND_MEASURES + (DISTINCT_MEASURES if STATS in groups else [])
    rows = post_acquisition(facts, tables.funnel).selectExpr(
        "cust_key",
        "acq_dt",
        "sale_dt",
        "discount_ind",
        "qualifying_ind",
        "fl_ind",
        f"{in_window} and fl_trip_ind = 1 as trip_in_window",
        f"{in_window} as in_window",
        *[f"if({in_window}, {m}, null) as {m}" for m in measures],
    )

    aggregates = {
        "qualified": qualifies_sql(feature_end),
        "acq_dt": "max(acq_dt)",
        "days_in_window": "count_if(in_window)",
    }
    if {SPEND, SPEND_LY, LAST_YEAR} & set(groups):
        rows = with_event_flags(rows, events, small, "left")
    if SPEND in groups:
        aggregates |= spend_share_aggregates()
    if SPEND_LY in groups:  # under the names of `SPEND`, of which it takes the place
        aggregates |= spend_share_aggregates(lookback_sql("sale_dt", feature_end, 1))
    if LAST_YEAR in groups:
        recent = f"event_dt is not null and fl_items > 0 and {lookback_sql('sale_dt', feature_end, 1)}"
        aggregates |= shopped_last_year_aggregates(recent)
    if SHOPPED in groups:
        numbered = lookback_spans(events, feature_end)
        rows = with_span_bits(rows, numbered, small)
        aggregates |= shopped_bits_aggregates("trip_in_window")
    if STATS in groups:
        aggregates |= stats_aggregates(feature_end)
    if target is not None:
        aggregates["target_shopped_ind"] = f"max(if(fl_ind = 1 and {in_target}, 1, 0))"

    profile = rows.groupBy("cust_key").agg(*named(aggregates)).where("qualified").drop("qualified")
    profile = profile.join(non_employees(tables.customers), "cust_key", "left_semi")
    if SHOPPED in groups:
        # no span of the look-back ends before this day
        profile = with_open_bits(profile, numbered, date(feature_end.year - 5, 1, 1), small)
    return profile


# --- one table per feature group ---------------------------------------------------


def pct_spend_in_event(tables: RetailTables, events: DataFrame, feature_end: date) -> DataFrame:
    """Share of full-line spend in the 4-year look-back that fell on each event's days."""
    profile = customer_profile(tables, events, feature_end, (SPEND,))
    return profile.where("calendar_items > 0").select("cust_key", *named(spend_share_columns()))


def pct_spend_in_event_ly(tables: RetailTables, events: DataFrame, feature_end: date) -> DataFrame:
    """The same share over the last year only."""
    profile = customer_profile(tables, events, feature_end, (SPEND_LY,))
    return profile.where("calendar_items > 0").select("cust_key", *named(spend_share_columns()))


def pct_trips_in_event(tables: RetailTables, events: DataFrame, feature_end: date) -> DataFrame:
    """Share of distinct full-line trips on each event's days.

    Trips with the same days behave alike, so they are counted per (customer, days)
    before the customer's acquisition date and the calendar are looked up.
    """
    lookback = lookback_sql("sale_dt", feature_end, 4)
    lines = tables.trans.where(f"{FULL_LINE} and corp_trip_key is not null and {lookback}")
    trips = lines.groupBy("cust_key", "corp_trip_key").agg(F.sort_array(F.collect_set("sale_dt")).alias("trip_days"))
    alike = trips.groupBy("cust_key", "trip_days").agg(F.count("*").alias("n_trips"))
    by_day = alike.select("cust_key", "trip_days", "n_trips", F.explode("trip_days").alias("sale_dt"))
    flagged = with_event_flags(post_acquisition(by_day, tables.funnel), events, is_small(events))
    seen = flagged.groupBy("cust_key", "trip_days", "n_trips").agg(*[F.max(e).alias(e) for e in S.EVENT_NAMES])
    counts = {e.short_event: f"sum(if({e.event} = 1, n_trips, 0L))" for e in S.MODELLED_EVENTS}
    totals = seen.groupBy("cust_key").agg(F.sum("n_trips").alias("all_trips"), *named(counts))
    population = customer_profile(tables, events, feature_end, ())
    shares = {f"{short}_pct_trips": f"round(cast({short} as double) / all_trips, 10)" for short in S.SHORT_NAMES}
    return totals.join(population, "cust_key", "left_semi").select("cust_key", *named(shares))


def pct_events_shopped(tables: RetailTables, events: DataFrame, feature_end: date) -> DataFrame:
    """Share of each event's years shopped since acquisition; 0 without any such year."""
    profile = customer_profile(tables, events, feature_end, (SHOPPED,))
    any_open = " or ".join(f"{e}_open > 0" for e in S.EVENT_NAMES)
    return profile.where(any_open).select("cust_key", *named(shopped_share_columns()))


def event_shopped_ly(tables: RetailTables, events: DataFrame, feature_end: date) -> DataFrame:
    """Whether each event was shopped in the last year."""
    profile = customer_profile(tables, events, feature_end, (LAST_YEAR,))
    flags = [f"{short}_shopped_ind" for short in S.SHORT_NAMES]
    return profile.where(F.col(flags[0]).isNotNull()).select("cust_key", *flags)


def cust_stats(tables: RetailTables, events: DataFrame, feature_end: date) -> DataFrame:
    """The 28 customer measures, spend in dollars."""
    profile = customer_profile(tables, events, feature_end, (STATS,)).where("days_in_window > 0")
    return profile.select("cust_key", *named(stats_columns()))


def stats_columns() -> dict[str, str]:
    names = COUNT_MEASURES + SPEND_MEASURES + DISTINCT_MEASURES
    names += ["fl_last_sale_dt", "fl_shopped_ly_ind", "fl_spend_ly", "fl_trips_ly"]
    money = SPEND_MEASURES + ["fl_spend_ly"]
    return {n: f"cast(cast({n} as decimal(20,0)) / 100 as decimal(20,2))" if n in money else n for n in names}
