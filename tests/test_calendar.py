from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from footfall import settings as S
from footfall.operators import calendar as C
from footfall.operators import spans as SP


@pytest.fixture(scope="module")
def events(spark):
    return C.default_event_calendar(spark, date(2019, 12, 31)).persist()


def runs(events, event):
    rows = SP.event_spans(events, [event]).orderBy("start_dt").collect()
    return {r.yr: (str(r.start_dt), str(r.end_dt)) for r in rows}


def test_fiscal_positions(spark):
    days = spark.createDataFrame([(date(2015, 7, 8),), (date(2015, 10, 26),), (date(2018, 2, 3),), (date(2018, 2, 4),)], "day_dt date")
    got = {str(r.day_dt): tuple(r)[1:] for r in C.calendar_454(days).collect()}
    assert got["2015-07-08"] == (2015, 6, 1, 4)
    assert got["2015-10-26"] == (2015, 9, 4, 2)
    assert got["2018-02-03"] == (2017, 12, 5, 7)  # last day of a 53rd week
    assert got["2018-02-04"] == (2018, 1, 1, 1)


def test_years_of_53_weeks(spark):
    table = C.calendar_454(C.calendar_days(spark, date(1995, 1, 1), date(2024, 12, 31)))
    assert sorted(r.yr_cal - 1 for r in C.extra_week(table).where("shift_wk = 1").collect()) == [1995, 2000, 2006, 2012, 2017, 2023]


def test_holidays(spark):
    days = C.calendar_days(spark, date(2017, 1, 1), date(2028, 12, 31))
    rows = {r.yr_cal: r for r in C.yearly_holidays(days).collect()}
    r = rows[2017]
    assert (r.mothers_day, r.memorial_day, r.fathers_day) == (date(2017, 5, 14), date(2017, 5, 29), date(2017, 6, 18))
    assert (r.labor_day, r.thanksgiving, r.easter) == (date(2017, 9, 4), date(2017, 11, 23), date(2017, 4, 16))
    assert rows[2024].easter == date(2024, 3, 31)
    assert rows[2028].easter is None
    old = C.yearly_holidays(days, legacy_easter=True).where("yr_cal = 2024").first()
    assert old.easter == date(2024, 3, 21)


def test_public_event_spans(events):
    got = runs(events, "anniversary_public_event")
    assert got[2016] == ("2016-07-22", "2016-08-07")
    assert got[2017] == ("2017-07-21", "2017-08-06")
    assert got[2018] == ("2018-07-20", "2018-08-05")
    assert got[2019] == ("2019-07-26", "2019-08-11")


def test_other_spans(events):
    assert runs(events, "anniversary_early_access")[2018] == ("2018-07-12", "2018-07-19")
    # a run takes the year of its last day
    assert runs(events, "december_half_yearly")[2017] == ("2016-12-26", "2017-01-02")
    assert runs(events, "mktg_holiday_full")[2017] == ("2017-11-24", "2017-12-24")
    assert runs(events, "mktg_valentines_day")[2018] == ("2018-01-01", "2018-02-14")


def test_rare_flags(events):
    days = {e: sorted(str(r.event_dt) for r in events.where(f"{e} = 1").collect()) for e in S.CALENDAR_FLAGS}
    assert "2015-07-08" in days["anniversary_l4_preshop"] and "2015-10-26" not in days["mktg_holiday_light"]
    assert days["labor_day_clearance"][0] == "2013-08-28" and "2013-09-15" in days["labor_day_clearance"]
    assert not [d for d in days["june_summer_clearance"] if d > "2016"]
    assert all(d[5:] == "02-14" for d in days["valentines_day"])
    assert [d for d in days["black_friday_cyber_monday"] if d[:4] == "2017"] == [
        "2017-11-24", "2017-11-25", "2017-11-26", "2017-11-27"
    ]


def test_rollups(events):
    row = events.where("event_dt = '2017-07-15'").first()  # early access only
    assert (row.holiday, row.loyalty, row.sale, row.loyalty_sale, row.holiday_sale) == (0, 1, 1, 1, 0)


def test_stamped_table_has_every_column(spark):
    table = C.build_event_calendar(C.calendar_days(spark, date(2017, 1, 1), date(2017, 1, 3)), stamp=True)
    assert table.columns == ["day_dt", *S.CALENDAR_FLAGS, *S.ROLLUPS, *S.ROLLUP_PAIRS, "data_last_updated"]


def spans_of(spark, flags, start=date(2016, 12, 20)):
    rows = [(start + timedelta(days=i), f) for i, f in enumerate(flags) if f != "gap"]
    df = spark.createDataFrame(rows, "event_dt date, e int")
    return [((r.start_dt - start).days, (r.end_dt - start).days, r.yr) for r in SP.event_spans(df, ["e"]).orderBy("start_dt").collect()]


def test_islands(spark):
    assert spans_of(spark, [0, 1, 1, 0, 1]) == [(1, 2, 2016), (4, 4, 2016)]
    assert spans_of(spark, [0] * 6 + [1] * 14) == [(6, 19, 2017)]  # across New Year
    assert spans_of(spark, [1, "gap", 1]) == [(0, 2, 2016)]  # a missing day does not split
    assert spans_of(spark, [1, None, 1]) == [(0, 2, 2016)]  # nor does an unknown flag


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(flags=st.lists(st.integers(0, 1), min_size=1, max_size=40))
def test_islands_cover_exactly_the_flagged_days(spark, flags):
    spans = spans_of(spark, flags)
    covered = {d for lo, hi, _ in spans for d in range(lo, hi + 1)}
    assert covered == {i for i, f in enumerate(flags) if f}
    assert all(b[0] - a[1] > 1 for a, b in zip(spans, spans[1:]))


def test_window_and_filters(events):
    assert SP.target_window(events, "anniversary_public_event", 2017) == (date(2017, 7, 21), date(2017, 8, 6), date(2017, 6, 21))
    with pytest.raises(ValueError):
        SP.target_window(events, "anniversary_public_event", 2030)
    spans = SP.event_spans(events)
    ends = [r.end_dt for r in SP.spans_in_lookback(spans, date(2017, 6, 21)).collect()]
    assert min(ends) >= date(2013, 6, 21) and max(ends) <= date(2017, 6, 20)
    kept = SP.spans_in_years(spans, 2013, 2017).where("event = 'december_half_yearly'").collect()
    assert sorted(r.yr for r in kept) == [2013, 2014, 2015, 2016, 2017]


def test_more_spans_than_bits(spark, events):
    many = SP.number_years(SP.event_spans(events), 1900)
    with pytest.raises(Exception, match="too many spans"):
        SP.span_bits(many).collect()
