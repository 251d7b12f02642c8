from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from retail_fixture import line, tables

from footfall import settings as S
from footfall.operators import calendar as C
from footfall.operators import distribution as D
from footfall.operators import features as FE
from footfall.operators import matrix as M
from footfall.operators import population as P

START, END, FEATURE_END = date(2017, 7, 21), date(2017, 8, 6), date(2017, 6, 21)


@pytest.fixture(scope="module")
def events(spark):
    return C.default_event_calendar(spark, date(2019, 12, 31)).persist()


def matrix(spark, events, t):
    return {r.cust_key: r for r in M.feature_matrix(t, events, START, END, FEATURE_END).collect()}


def test_population_rules(spark):
    lines = [
        line(1, "2016-07-01"),
        line(2, "2016-07-01"),  # employee
        line(3, "2016-07-01", spend_discount_employee_ind=1),
        line(4, "2016-07-01", channel="RACK"),
        line(5, "2014-07-01"),  # too long ago
        line(6, "2016-07-01", merch_type="Restaurant"),
        line(7, "2017-06-20"),  # day before the feature end
        line(8, "2017-06-21"),  # the feature end itself
        line(9, "2016-07-01"),  # before acquisition
        line(10, "2016-07-01"),  # on the acquisition date
        line(11, "2015-06-21"),  # first day of the 2 years
    ]
    acquired = {c: "2013-01-01" for c in range(1, 12)} | {9: "2016-07-02", 10: "2016-07-01"}
    t = tables(spark, lines, acquired, employees={2})
    got = sorted(r.cust_key for r in P.base_population(t.customers, t.trans, t.funnel, FEATURE_END).collect())
    assert got == [1, 7, 10, 11]


def test_discount_before_acquisition_is_forgiven(spark):
    lines = [line(1, "2012-01-01", spend_discount_employee_ind=1), line(1, "2016-07-01")]
    t = tables(spark, lines, {1: "2013-01-01"})
    assert P.base_population(t.customers, t.trans, t.funnel, FEATURE_END).count() == 1


def test_old_discount_lines_still_count(spark, events):
    """Lines long before the look-back are folded, by discount value, not dropped."""
    lines = [line(c, "2016-07-01", spend_discount_employee_ind=None if c == 4 else 0) for c in (1, 2, 3, 4)]
    lines += [
        line(1, "2010-05-01", spend_discount_employee_ind=1),  # after acquisition: out
        line(2, "2010-05-01", spend_discount_employee_ind=1),  # before acquisition: stays
        line(2, "2012-05-01"),
        line(4, "2010-05-01"),  # the only line that says 0
    ]
    t = tables(spark, lines, {1: "2010-05-01", 2: "2010-05-02", 3: "2013-01-01", 4: "2010-01-01"})
    got = sorted(r.cust_key for r in P.base_population(t.customers, t.trans, t.funnel, FEATURE_END).collect())
    assert got == [2, 3, 4]
    assert sorted(matrix(spark, events, t)) == [2, 3, 4]


def test_base_trans_and_label(spark):
    lines = [
        line(1, "2016-07-01"),
        line(1, "2013-06-21"),
        line(1, "2013-06-20"),  # outside the look-back
        line(1, "2017-08-06"),  # last target day
        line(2, "2016-07-01"),
        line(2, "2017-07-25", channel="RACK"),
        line(3, "2017-07-25"),  # shops the target but is not in the population
    ]
    t = tables(spark, lines, {1: "2013-01-01", 2: "2013-01-01", 3: "2013-01-01"})
    population = P.base_population(t.customers, t.trans, t.funnel, FEATURE_END)
    base = P.base_trans(t.trans, t.funnel, population, FEATURE_END)
    assert sorted((r.cust_key, str(r.sale_dt)) for r in base.collect()) == [
        (1, "2013-06-21"), (1, "2016-07-01"), (2, "2016-07-01")
    ]
    label = P.target_label(t.trans, t.funnel, START, END)
    assert sorted(r.cust_key for r in label.collect()) == [1, 3]
    both = P.labelled_population(population, label).collect()
    assert {r.cust_key: r.target_shopped_ind for r in both} == {1: 1, 2: 0}


def test_matrix_of_small_cases(spark, events):
    lines = [
        # 1: half of the spend in the public event 2016, two lines of one trip, one other trip
        line(1, "2016-07-25", 30, trip="a", prod_div="D1"),
        line(1, "2016-07-25", 20, trip="a", prod_div="D2", prod_merchlevel2="Shoes", prod_gender="M", full_line_sale_ind=1),
        line(1, "2016-11-05", 50, channel="N.COM", trip="b", merch_type="Restaurant", tender_giftcard=1),
        line(1, "2017-06-01", 100, channel="RACK", trip="c"),
        line(1, "2017-07-30", 5, trip="d"),
        # 2: spend nets to zero
        line(2, "2016-07-25", 10),
        line(2, "2016-07-26", -10),
        # 3: acquired late, no loyalty row, no event year to shop before that
        line(3, "2017-06-20", 10),
    ]
    t = tables(
        spark, lines, {1: "2013-01-31", 2: "2013-01-31", 3: "2017-06-20"}, personas={1: 4, 2: 5, 3: 1}, loyalty={1: (1, 0)}
    )
    rows = matrix(spark, events, t)
    one = rows[1]
    assert (one.persona, one.target_shopped_ind, one.loyalty_tender_ind) == (4, 1, 1)
    assert (one.fl_total_spend, one.fl_total_trips, one.fl_avg_spend_per_trip) == (100.0, 2, 50.0)
    assert (one.fl_total_divs, one.total_channels, one.fl_shopped_ly_ind) == (2, 3, 1)
    assert (one.merch_pct_spend, one.shoe_pct_spend, one.food_pct_spend) == (50.0, 20.0, 50.0)
    assert (one.mens_prod_pct_spend, one.giftcard_pct_spend, one.web_pct_spend, one.rack_pct_spend) == (20.0, 50.0, 50.0, 50.0)
    assert one.sale_pct_items == pytest.approx(100 / 3)
    assert one.anniversary_public_pct_spend == 50.0
    assert one.anniversary_public_pct_shopped == 25.0  # 2016 of 2013..2016
    assert one.anniversary_public_shop_ly_ind == 1
    assert one.months_since_last_sale == pytest.approx(8 + 16 / 31)  # 2016-11-05 to 2017-07-21
    assert one.tenure_total_months == pytest.approx(53 - 10 / 31)  # 2013-01-31 to 2017-06-21
    assert (rows[2].fl_total_spend, rows[2].anniversary_public_pct_spend, rows[2].merch_pct_spend) == (0.0, 0.0, 0.0)
    assert rows[2].anniversary_public_pct_shopped == 25.0 and rows[2].target_shopped_ind == 0
    assert (rows[3].loyalty_tender_ind, rows[3].anniversary_public_pct_shopped) == (0, 0.0)
    assert list(one.asDict()) == S.ID_COLUMNS + S.FEATURE_COLUMNS and len(S.FEATURE_COLUMNS) == 71


def test_matrix_needs_a_persona_and_drops_repeats(spark, events):
    t = tables(spark, [line(1, "2016-07-01"), line(2, "2016-07-01")], {1: "2013-01-01", 2: "2013-01-01"}, personas={1: 1})
    twice = t.personas.union(t.personas)
    t = type(t)(t.trans, t.customers, t.funnel, t.loyalty, twice)
    assert list(matrix(spark, events, t)) == [1]
    assert M.feature_matrix(t, events, START, END, FEATURE_END).count() == 1


def test_month_ends_count_whole_months(spark):
    from footfall.functions.dates import months_between

    df = spark.createDataFrame([(date(2016, 12, 31),)], "d date").select(months_between(date(2017, 2, 28), "d").alias("m"))
    assert df.first().m == 2.0


def test_trips_over_two_days_count_once(spark, events):
    lines = [
        line(1, "2016-08-07", trip="x"),  # last day of the public event
        line(1, "2016-08-08", trip="x"),
        line(1, "2016-10-01", trip="y"),
        line(1, "2016-10-02", trip="z"),
    ]
    t = tables(spark, lines, {1: "2013-01-01"})
    row = FE.pct_trips_in_event(t, events, FEATURE_END).first()
    assert row.anniversary_public_pct_trips == pytest.approx(1 / 3)
    assert FE.cust_stats(t, events, FEATURE_END).first().fl_trips == 3
    # acquired on the second day: the first day of the trip no longer counts
    late = tables(spark, lines, {1: "2016-08-08"})
    assert FE.pct_trips_in_event(late, events, FEATURE_END).first().anniversary_public_pct_trips == 0.0


def test_a_customer_with_most_lines(spark, events):
    lines = [line(1, f"2016-{m:02d}-{d:02d}", 1, trip=f"t{m}-{d}-{i}") for m in range(7, 13) for d in (3, 17) for i in range(20)]
    lines += [line(c, "2016-07-01") for c in range(2, 30)]
    t = tables(spark, lines, {c: "2013-01-01" for c in range(1, 30)})
    stats = {r.cust_key: r for r in FE.cust_stats(t, events, FEATURE_END).collect()}
    assert (stats[1].fl_trips, stats[1].fl_items, float(stats[1].fl_spend)) == (240, 240, 240.0)
    assert len(stats) == 29


def test_persona_event_dist(spark, events):
    lines = [
        line(1, "2016-07-25"),
        line(2, "2016-07-25"),
        line(2, "2014-07-25"),  # before acquisition, by the end of the span not a customer
        line(3, "2015-05-01"),
    ]
    t = tables(spark, lines, {1: "2013-01-01", 2: "2016-07-01", 3: "2013-01-01"}, personas={1: 1, 2: 1, 3: 2})
    dist = D.add_not_shopped(D.persona_event_dist(t, events, 2013, 2017)).where("event = 'anniversary_public_event'")
    got = {(r.persona, r.year): (r.n_shopped, r.n_existing, r.n_notshopped) for r in dist.collect()}
    assert got[(1, 2016)] == (2, 2, 0) and got[(1, 2014)] == (0, 1, 1) and got[(2, 2016)] == (0, 1, 1)


def test_more_spans_than_one_mask_holds(spark, events):
    """100 spans of one day: the first of every odd week since 2013."""
    name = S.EVENT_NAMES[0]
    every = F.when((F.datediff("event_dt", F.lit("2013-01-05")) % 14 == 0) & (F.col("event_dt") < "2016-11-01"), 1).otherwise(0)
    many = events.withColumn(name, every)
    first = date(2013, 1, 5)
    days = [first + timedelta(days=14 * i) for i in range(100)]
    assert days[-1] < date(2016, 11, 1) <= days[-1] + timedelta(days=14)
    lines = [line(1, str(days[i])) for i in (0, 62, 63, 64, 99)] + [line(2, str(days[70]))]
    t = tables(spark, lines, {1: "2013-01-01", 2: str(days[65])}, personas={1: 1, 2: 1})
    dist = D.persona_event_dist(t, many, 2013, 2017).where(F.col("event") == name).collect()
    got = {r.start_dt: (r.n_shopped, r.n_existing) for r in dist}
    assert got == {d: ((i in (0, 62, 63, 64, 99)) + (i == 70), 1 + (i >= 65)) for i, d in enumerate(days)}


def test_small_p_values(spark):
    two = spark.createDataFrame([(1, 300, 20), (2, 30, 200)], "persona int, n_shopped long, n_notshopped long")
    assert 0 < D.chi_square_p_value(D.chi_square(two, ["persona"], ["n_shopped", "n_notshopped"])) < 1e-40


def test_chi_square(spark):
    equal = [(p, e, 5, 5) for p in (1, 2) for e in ("a", "b")]
    df = spark.createDataFrame(equal, "persona int, event string, n_shopped long, n_notshopped long")
    r = D.chi_square(df, ["persona", "event"], ["n_shopped", "n_notshopped"])
    assert (r.first().statistic, r.first().dof) == (0.0, 4)
    assert D.chi_square_p_value(r) == pytest.approx(1.0)
    two = spark.createDataFrame([(1, 10, 20), (2, 30, 5)], "persona int, n_shopped long, n_notshopped long")
    r = D.chi_square(two, ["persona"], ["n_shopped", "n_notshopped"])
    # 2 x 2 with Yates' correction: n (|ad - bc| - n/2)^2 / product of the margins
    assert r.first().statistic == pytest.approx(65 * (abs(10 * 5 - 20 * 30) - 32.5) ** 2 / (30 * 35 * 40 * 25))
    assert D.chi_square_p_value(r) < 0.001
