"""DuckDB SQL for the registered queries, written from the definitions.

The SQL takes the direct road (distinct counts, range joins, windows over whole groups)
that the Spark operators avoid, so the two agree only if both are right.
"""

from __future__ import annotations

from footfall import settings as S
from footfall.functions.columns import sql_list
from footfall.plans import catalog as C
from footfall.sources import retail as R

START, END, FEATURE_END = "date '2017-07-21'", "date '2017-08-06'", "date '2017-06-21'"
FLS = f"({sql_list(S.FULL_LINE_CHANNELS)})"
EVENTS = S.MODELLED_EVENTS
FEATURES = S.FEATURE_COLUMNS

TABLES = f"""
trans as ({R.TRANS_SQL.format(orders="orders", lineitem="lineitem", part="part")}),
customers as ({R.CUSTOMERS_SQL.format(customer="customer")}),
funnel as ({R.FUNNEL_SQL.format(trans="trans")}),
loyalty as ({R.LOYALTY_SQL.format(customer="customer")}),
personas as ({R.PERSONAS_SQL.format(customer="customer")}),
daily as (select sale_dt, count(*) as n_lines from trans group by 1)
"""


def _values(rows: list[tuple]) -> str:
    def text(v):
        return f"date '{v}'" if hasattr(v, "isoformat") else str(v).lower() if isinstance(v, bool) else repr(v)

    return "values " + ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


def _nth(name: str, month: int, weekday: int, nth: str) -> str:
    order = "d desc" if nth == "last" else "d"
    place = 1 if nth == "last" else nth
    return f"""{name} as (select year(d) as yr, d as {name} from alldays where month(d) = {month} and dayofweek(d) = {weekday}
  qualify row_number() over (partition by year(d) order by {order}) = {place})"""


#: Easter by the rule of the Gregorian calendar, not from the list that the calendar under test reads.
EASTERS = """easters(yr, easter) as (
  select yr, make_date(yr, p // 31, p % 31 + 1) from (
    select yr, yr % 19 as a, yr // 100 as b, yr % 100 as c, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 as h,
      (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as l, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 as p
    from (select unnest(range(2013, 2028)) as yr)))"""

CALENDAR = f"""
alldays as (select cast(unnest(generate_series(date '2012-01-01', date '2020-12-31', interval 1 day)) as date) as d),
fiscal_years as (
  select y, cast(make_date(y, 1, 31) + cast(((6 - dayofweek(make_date(y, 1, 31)) + 3) % 7) - 3 as int) + 1 as date) as first_day
  from range(2010, 2023) r(y)),
fiscal_weeks as (
  select d, y as yr_454, date_diff('day', first_day, d) // 7 as w, date_diff('day', first_day, d) % 7 + 1 as day_454
  from alldays join fiscal_years on first_day <= d
  qualify row_number() over (partition by d order by first_day desc) = 1),
fiscal_months(m, first_w) as (values (1,0),(2,4),(3,9),(4,13),(5,17),(6,22),(7,26),(8,30),(9,35),(10,39),(11,43),(12,48)),
fiscal as (
  select d as day_dt, yr_454, m as mth_454, w - first_w + 1 as wk_454, day_454
  from fiscal_weeks join fiscal_months on first_w <= w
  qualify row_number() over (partition by d order by m desc) = 1),
shifts as (
  select yr_454 + 1 as yr, case when max(wk_454) = 5 then 1 else 0 end as shift_wk from fiscal where mth_454 = 12 group by 1),
{_nth("mothers_day", 5, 0, 2)},
{_nth("memorial_day", 5, 1, "last")},
{_nth("fathers_day", 6, 0, 3)},
{_nth("labor_day", 9, 1, 1)},
{_nth("thanksgiving", 11, 4, 4)},
{EASTERS},
holidays as (
  select yr, make_date(yr, 1, 1) as new_years_day, make_date(yr, 2, 14) as valentines_day, easter, mothers_day, memorial_day,
    fathers_day, labor_day, thanksgiving, make_date(yr, 12, 25) as christmas
  from mothers_day join memorial_day using (yr) join fathers_day using (yr) join labor_day using (yr)
  join thanksgiving using (yr) left join easters using (yr)),
anchors as (
  select yr, name, dt from (unpivot holidays on columns(* exclude (yr)) into name name value dt)
  union all select year(d), 'epiphany_sunday', min(d) from alldays where dayofweek(d) = 0 and dayofyear(d) > 1 group by 1
  union all select year(d), 'month_' || strftime(d, '%m'), d from alldays where day(d) = 1
  union all select year(d), 'month_end_' || strftime(d, '%m'), max(d) from alldays group by 1, 2),
fiscal_windows(event, first_yr, last_yr, shifted, lo, hi) as ({_values([tuple(w) for w in S.FISCAL_WINDOWS])}),
holiday_windows(event, first_yr, last_yr, a, lo, b, hi) as ({_values([tuple(w) for w in S.HOLIDAY_WINDOWS])}),
dated_windows(event, a, b) as ({_values(S.DATED_WINDOWS)}),
excluded(event, day_dt) as ({_values(S.EXCLUDED_DAYS)}),
event_days as (
  select distinct event, day_dt from (
    select event, day_dt from fiscal join shifts on shifts.yr = year(day_dt) join fiscal_windows
      on year(day_dt) between first_yr and last_yr
      and mth_454 * 100 + (wk_454 + case when shifted then shift_wk else 0 end) * 10 + day_454 between lo and hi
    union all
    select w.event, d from holiday_windows w join anchors s on s.name = w.a join anchors e on e.name = w.b and e.yr = s.yr
      join alldays on year(d) = s.yr and d between s.dt + w.lo and e.dt + w.hi
      where s.yr between first_yr and last_yr
    union all
    select event, d from dated_windows join alldays on d between a and b)
  where (event, day_dt) not in (select (event, day_dt) from excluded)),
flags as (
  select d as day_dt, {", ".join(f"count(*) filter (where event = '{e}') as {e}" for e in S.CALENDAR_FLAGS)}
  from alldays left join event_days on d = day_dt where year(d) between 2013 and 2019 group by 1),
numbered_days as (
  select event, day_dt, date_diff('day', date '2000-01-01', day_dt)
    - row_number() over (partition by event order by day_dt) as run
  from event_days where event in ({sql_list(S.EVENT_NAMES)}) and year(day_dt) between 2013 and 2019),
spans as (
  select event, year(max(day_dt)) as yr, min(day_dt) as start_dt, max(day_dt) as end_dt from numbered_days group by event, run),
lookback as (select * from spans where end_dt between {FEATURE_END} - interval 4 year and {FEATURE_END} - 1)
"""


def _lookback(day: str, years: int) -> str:
    return f"{day} between {FEATURE_END} - interval {years} year and {FEATURE_END} - 1"


def _sum_if(condition: str, value: str = "spend_gross") -> str:
    return f"sum(case when {condition} then {value} else 0 end)"


def _in_event(e: str) -> str:
    return f"sum(case when {e} = 1 then spend_gross else 0 end) / nullif(cast(sum(spend_gross) as double), 0)"


CATEGORIES = {
    name: f"prod_merchlevel2 in ({sql_list(groups)})" + (" or merch_type = 'Restaurant'" if name == "food" else "")
    for name, groups in S.CATEGORY_GROUPS.items()
}
LAST_YEAR = _lookback("sale_dt", 1)

STATS_SUMS = {
    "fl_spend": f"intent_channel in {FLS}",
    "merch_spend": f"intent_channel in {FLS} and merch_type = 'Merch' and channel <> 'RESTAURANT'",
    "womens_prod_spend": f"intent_channel in {FLS} and prod_gender = 'F'",
    "mens_prod_spend": f"intent_channel in {FLS} and prod_gender = 'M'",
    **{f"{name}_spend": f"intent_channel in {FLS} and ({c})" for name, c in CATEGORIES.items()},
    "giftcard_spend": f"intent_channel in {FLS} and tender_giftcard = 1",
    "web_spend": "intent_channel = 'N.COM'",
    "rack_spend": "intent_channel = 'RACK'",
    "jwn_spend": "true",
    "fl_spend_ly": f"intent_channel in {FLS} and {LAST_YEAR}",
}
STATS_COUNTS = {
    "fl_items": f"count(*) filter (where intent_channel in {FLS})",
    "sale_items": f"sum(case when intent_channel in {FLS} then full_line_sale_ind else 0 end)",
    "fl_trips": f"count(distinct case when intent_channel in {FLS} then corp_trip_key end)",
    "fl_divs": f"count(distinct case when intent_channel in {FLS} then prod_div end)",
    "jwn_channels": "count(distinct intent_channel)",
    "fl_shopped_ly_ind": f"max(case when intent_channel in {FLS} and {LAST_YEAR} then 1 else 0 end)",
    "fl_trips_ly": f"count(distinct case when intent_channel in {FLS} and {LAST_YEAR} then corp_trip_key end)",
}


def _years(event: str, extra: str = "") -> str:
    return f"count(distinct case when event = '{event}'{extra} then yr end)"


FEATURE_TABLES = f"""
post as (select t.*, acq_dt from trans t join funnel f on t.cust_key = f.cust_key and t.sale_dt >= f.acq_dt),
pop as (
  select p.cust_key from post p join customers c on c.cust_key = p.cust_key where current_employee_ind = 0 group by 1
  having max(spend_discount_employee_ind) = 0 and max(case when {_lookback("sale_dt", 2)} and merch_type = 'Merch'
    and intent_channel in {FLS} and channel <> 'RESTAURANT' then 1 else 0 end) = 1),
bt as (select post.* from post join pop using (cust_key) where {_lookback("sale_dt", 4)}),
fl as (select * from bt where intent_channel in {FLS}),
fl_flags as (select * from fl join flags on sale_dt = day_dt),
espend as (
  select cust_key, {", ".join(f"round({_in_event(e.event)}, 10) as {e.short_event}_pct_spend" for e in EVENTS)}
  from fl_flags group by 1),
espend_ly as (
  select cust_key, {", ".join(f"round({_in_event(e.event)}, 10) as {e.short_event}_pct_spend" for e in EVENTS)}
  from fl_flags where {LAST_YEAR} group by 1),
etrips as (
  select cust_key, {", ".join(
      f"round(count(distinct case when {e.event} = 1 then corp_trip_key end) / cast(count(distinct corp_trip_key) as double), 10)"
      f" as {e.short_event}_pct_trips" for e in EVENTS)}
  from fl_flags group by 1),
shopped as (
  select p.cust_key, {", ".join(
      f"case when {_years(e.event)} = 0 then 0 else round({_years(e.event, ' and fl.corp_trip_key is not null')}"
      f" / cast({_years(e.event)} as double), 10) end as {e.short_event}_pct_shopped" for e in EVENTS)}
  from pop p join funnel f on f.cust_key = p.cust_key join lookback s on f.acq_dt <= s.end_dt
  left join fl on fl.cust_key = p.cust_key and fl.sale_dt between s.start_dt and s.end_dt group by 1),
shopped_ly as (
  select cust_key, {", ".join(f"max({e.event}) as {e.short_event}_shopped_ind" for e in EVENTS)}
  from fl_flags where {LAST_YEAR} group by 1),
stats as (
  select cust_key, {", ".join(f"{_sum_if(c)} as {name}" for name, c in STATS_SUMS.items())},
    {", ".join(f"{c} as {name}" for name, c in STATS_COUNTS.items())},
    max(case when intent_channel in {FLS} then sale_dt end) as fl_last_sale_dt
  from bt group by 1),
target as (
  select distinct cust_key, 1 as target_shopped_ind from post
  where sale_dt between {START} and {END} and intent_channel in {FLS})
"""


def _months(later: str, earlier: str) -> str:
    same = f"(day({later}) = day({earlier}) or ({later} = last_day({later}) and {earlier} = last_day({earlier})))"
    whole = f"((year({later}) - year({earlier})) * 12 + month({later}) - month({earlier}))"
    return f"({whole} + case when {same} then 0 else (day({later}) - day({earlier})) / 31.0::double end)"


def _pct(num: str, den: str = "fl_spend", scale: int = 100) -> str:
    return f"case when coalesce({den}, 0) = 0 then 0 else {scale} * cast({num} as double) / cast({den} as double) end"


MATRIX_COLUMNS = {
    "tenure_total_months": _months(FEATURE_END, "acq_dt"),
    "loyalty_tender_ind": "coalesce(loyalty_tender_ind, 0)",
    "loyalty_nontender_ind": "coalesce(loyalty_nontender_ind, 0)",
    "fl_total_spend": "coalesce(fl_spend, 0)::double",
    "fl_total_trips": "coalesce(fl_trips, 0)",
    "fl_avg_spend_per_trip": _pct("fl_spend", "fl_trips", 1),
    "sale_pct_items": _pct("sale_items", "fl_items"),
    "merch_pct_spend": _pct("merch_spend"),
    "womens_prod_pct_spend": _pct("womens_prod_spend"),
    "mens_prod_pct_spend": _pct("mens_prod_spend"),
    **{f"{name}_pct_spend": _pct(f"{name}_spend") for name in CATEGORIES},
    "giftcard_pct_spend": _pct("giftcard_spend"),
    "web_pct_spend": _pct("web_spend"),
    "rack_pct_spend": _pct("rack_spend", "jwn_spend"),
    "fl_total_divs": "coalesce(fl_divs, 0)",
    "total_channels": "coalesce(jwn_channels, 0)",
    "months_since_last_sale": _months(START, "fl_last_sale_dt"),
    "fl_shopped_ly_ind": "coalesce(fl_shopped_ly_ind, 0)",
    "fl_total_spend_ly": "coalesce(fl_spend_ly, 0)::double",
    **{f"{s}_pct_spend": f"100 * coalesce({s}_pct_spend, 0)::double" for s in S.SHORT_NAMES},
    **{f"{s}_pct_shopped": f"100 * coalesce({s}_pct_shopped, 0)::double" for s in S.SHORT_NAMES},
    **{f"{s}_shop_ly_ind": f"coalesce({s}_shopped_ind, 0)" for s in S.SHORT_NAMES},
}

MATRIX = f"""
matrix as (
  select distinct pop.cust_key, persona, coalesce(target_shopped_ind, 0) as target_shopped_ind,
    {", ".join(f"{MATRIX_COLUMNS[f]} as {f}" for f in FEATURES)}
  from pop join personas using (cust_key) join funnel using (cust_key) left join loyalty using (cust_key)
  left join stats using (cust_key) left join espend using (cust_key) left join shopped using (cust_key)
  left join shopped_ly using (cust_key) left join target using (cust_key))
"""

# -- tables behind the steps after the matrix ---------------------------------------------

LONG = f"""
long_matrix as (
  select cust_key, persona, target_shopped_ind, feature, value from (
    unpivot (select cust_key, persona, target_shopped_ind, {", ".join(f"{f}::double as {f}" for f in FEATURES)} from matrix)
    on {", ".join(FEATURES)} into name feature value value))
"""

TYPES = """
types as (
  select feature, count(distinct round(value, 9)) as n_distinct,
    case when count(distinct round(value, 9)) > 8 then 'continuous' when count(distinct round(value, 9)) > 2 then 'ordinal' else 'binary' end
      as feature_type
  from long_matrix group by 1)
"""

IMPORTANCES = """
importances as (
  select persona, feature, round(ln(1 + round(var_samp(value), 9)), 6) as importance, any_value(feature_type) as feature_type
  from long_matrix join types using (feature) group by 1, 2)
"""

COEFS = """
coefs as (select persona, cust_key % 5 as replicate, feature, round(avg(value), 6) as coef from long_matrix group by 1, 2, 3),
raw_summary as (
  select persona, feature, avg(case when abs(coef) > 1e-6 then 1.0::double else 0 end) as prop_selected, avg(coef) as mean_coef,
    abs(avg(coef)) as abs_mean_coef, stddev_samp(coef) as std from coefs group by 1, 2),
summary as (
  select persona, feature, round(prop_selected, 6) as prop_selected, round(mean_coef, 6) as mean_coef,
    round(abs_mean_coef, 6) as abs_mean_coef, round(std, 6) as std from raw_summary)
"""

SCORED = f"""
scored as (
  select *, case when prob >= 0.5 then 1 else 0 end as pred from (
    select cust_key, persona, target_shopped_ind as y,
      round(cast(('0x' || substr(md5('{C.SCORE_SEED}-' || cust_key), 1, 6))::bigint as double) / {16**6}, 3) as prob from matrix))
"""

CHOSEN = """
chosen as (
  select persona, feature from summary
  qualify row_number() over (partition by persona order by prop_selected desc, abs_mean_coef desc, feature) <= 35)
"""


def _place(seed: int, by: str) -> str:
    partition = f"partition by {by} " if by else ""
    return f"row_number() over ({partition}order by md5('{seed}-' || cust_key))"


SPLIT = f"""
strata as (select persona, target_shopped_ind, count(*) as size from matrix group by 1, 2),
strata_exact as (select *, floor({S.TRAIN_SIZE} * sum(size) over ()) * size / sum(size) over () as exact from strata),
strata_quota as (
  select persona, target_shopped_ind, floor(exact) + case when row_number() over (
      order by round(exact - floor(exact), 9) desc, persona, target_shopped_ind)
    <= round(sum(exact) over ()) - sum(floor(exact)) over () then 1 else 0 end as quota from strata_exact),
split as (
  select matrix.*, case when {_place(S.SPLIT_SEED, "persona, target_shopped_ind")} <= quota then 1 else 0 end as is_train
  from matrix join strata_quota using (persona, target_shopped_ind))
"""

DISTRIBUTION = f"""
ppop as (
  select c.cust_key, persona, any_value(acq_dt) as acq_dt from post p join customers c using (cust_key) join personas using (cust_key)
  where current_employee_ind = 0 group by 1, 2
  having max(spend_discount_employee_ind) = 0
    and max(case when year(sale_dt) between {C.FIRST_YEAR} and {C.LAST_YEAR} and intent_channel in {FLS} then 1 else 0 end) = 1),
year_spans as (
  select * from spans where yr between {C.FIRST_YEAR} and {C.LAST_YEAR} and year(start_dt) between {C.FIRST_YEAR} and {C.LAST_YEAR}),
dist as (
  select persona, event, yr as year, start_dt, end_dt, count(distinct t.cust_key) as n_shopped,
    count(distinct b.cust_key) as n_existing
  from ppop b join year_spans s on b.acq_dt <= s.end_dt
  left join (select cust_key, sale_dt from trans
    where year(sale_dt) between {C.FIRST_YEAR} and {C.LAST_YEAR} and intent_channel in {FLS}) t
    on t.cust_key = b.cust_key and t.sale_dt between s.start_dt and s.end_dt
  group by 1, 2, 3, 4, 5)
"""

# --- assembly ---------------------------------------------------------------------------

ORACLES: dict[str, str] = {}


def _final(columns: str, body: str, digits: int) -> str:
    """Columns as ``name:kind`` with kind i (bigint), f (double), d (date text) or s (text)."""
    out = []
    for item in columns.split():
        name, kind = item.split(":")
        out.append(
            {
                "i": f'cast("{name}" as bigint) as "{name}"',
                "f": f'round(cast("{name}" as double), {digits}) + 0.0::double as "{name}"',
                "d": f'cast(cast("{name}" as date) as varchar) as "{name}"',
                "s": f'cast("{name}" as varchar) as "{name}"',
            }[kind]
        )
    return f"select {', '.join(out)} from ({body})"


def _add(name: str, parts: list[str], columns: str, body: str) -> None:
    with_list = ",".join(p.strip() for p in parts)
    ORACLES[name] = f"with {with_list}\n{_final(columns, body, C.DIGITS.get(name, 6))}"


def _kinds(names, kind: str) -> str:
    return " ".join(f"{n}:{kind}" for n in names)


WHOLE_FEATURES = [
    f for f in FEATURES if f.endswith("_ind") or f in ("fl_total_trips", "fl_total_divs", "total_channels")
]
IDS = "cust_key:i persona:i target_shopped_ind:i"
MATRIX_KINDS = f"{IDS} " + " ".join(f"{f}:{'i' if f in WHOLE_FEATURES else 'f'}" for f in FEATURES)
TRANS_KINDS = (
    "cust_key:i tran_key:i tran_line_key:i corp_trip_key:s sale_dt:d intent_channel:s channel:s merch_type:s prod_div:s "
    "prod_merchlevel2:s prod_gender:s full_line_sale_ind:i spend_gross:f tender_giftcard:i"
)
PERSONA_NAMES = [f"persona_{p}" for p in S.PERSONAS]

WITH_FEATURES = [TABLES, CALENDAR, FEATURE_TABLES]
WITH_MATRIX = WITH_FEATURES + [MATRIX]
WITH_LONG = WITH_MATRIX + [LONG]
WITH_TYPES = WITH_LONG + [TYPES]


def _pivot(value: str, source: str, keys: str) -> str:
    columns = ", ".join(f"max(case when persona = {p} then {value} end) as persona_{p}" for p in S.PERSONAS)
    return f"select {keys}, {columns} from {source} group by {keys}"


def _sources_and_calendar() -> None:
    _add("scan_trans", [TABLES], f"{TRANS_KINDS} spend_discount_employee_ind:i", "from trans")
    slugs = _values([tuple(e) for e in EVENTS])
    _add(
        "event_config",
        [TABLES, CALENDAR, f"config(event, short_event, event_slug) as ({slugs})"],
        "event:s short_event:s event_slug:s n_lines:i",
        """select event, short_event, event_slug, sum(n_lines) as n_lines from config left join
        (select event, day_dt, n_lines from event_days join daily on sale_dt = day_dt) using (event) group by 1, 2, 3""",
    )
    _add("roundtrip_csv", WITH_MATRIX, MATRIX_KINDS, "from matrix")
    per_year = "(select year(sale_dt) as yr_cal, sum(n_lines) as n_lines from daily group by 1)"
    _add(
        "yearly_holidays",
        [TABLES, CALENDAR],
        f"yr_cal:i {_kinds(S.HOLIDAY_COLUMNS, 'd')} n_lines:i",
        f"select h.*, yr as yr_cal, n_lines from holidays h left join {per_year} on yr_cal = yr where yr between 2013 and 2019",
    )
    _add(
        "calendar_454",
        [TABLES, CALENDAR],
        "day_dt:d yr_454:i mth_454:i wk_454:i day_454:i n_lines:i",
        """select fiscal.*, coalesce(n_lines, 0) as n_lines from fiscal left join daily on sale_dt = day_dt
        where year(day_dt) between 2013 and 2019""",
    )
    _add(
        "extra_week",
        [TABLES, CALENDAR],
        "yr_cal:i shift_wk:i n_lines:i",
        f"""select yr_cal, shift_wk, n_lines from (select yr_454 + 1 as yr_cal, case when max(wk_454) = 5 then 1 else 0 end as shift_wk
        from fiscal where mth_454 = 12 and year(day_dt) between 2013 and 2019 group by 1) left join {per_year} using (yr_cal)""",
    )
    with_lines = "coalesce(n_lines, 0) as n_lines from flags left join daily on sale_dt = day_dt"
    _add(
        "event_calendar",
        [TABLES, CALENDAR],
        f"day_dt:d {_kinds(S.CALENDAR_FLAGS, 'i')} n_lines:i",
        f"select flags.*, {with_lines}",
    )
    anyof = {name: " or ".join(f"{m} = 1" for m in members) for name, members in S.ROLLUPS.items()}
    allof = {n: " and ".join(f"({anyof[m]})" for m in members) for n, members in S.ROLLUP_PAIRS.items()}
    rolled = ", ".join(f"({c})::int as {n}" for n, c in (anyof | allof).items())
    _add(
        "event_rollups",
        [TABLES, CALENDAR],
        f"day_dt:d {_kinds([*S.ROLLUPS, *S.ROLLUP_PAIRS], 'i')} n_lines:i",
        f"select day_dt, {rolled}, {with_lines}",
    )
    lines = "(select count(*) from trans where sale_dt between start_dt and end_dt) as n_lines"
    _add(
        "event_span",
        [TABLES, CALENDAR],
        "start_dt:d end_dt:d n_lines:i",
        f"select start_dt, end_dt, {lines} from spans where event = '{S.DEFAULT_EVENT}' and yr = {S.DEFAULT_YEAR}",
    )
    for name, source in (("event_spans_all", "spans"), ("event_dates_lookback", "lookback")):
        _add(name, [TABLES, CALENDAR], "event:s yr:i start_dt:d end_dt:d n_lines:i", f"select *, {lines} from {source}")


def _population_and_features() -> None:
    _add("post_acq_trans", WITH_FEATURES, f"{TRANS_KINDS} spend_discount_employee_ind:i acq_dt:d", "from post")
    _add("base_population", WITH_FEATURES, "cust_key:i", "from pop")
    _add("persona_population", WITH_FEATURES + [DISTRIBUTION], "cust_key:i persona:i", "from ppop")
    _add("base_trans", WITH_FEATURES, TRANS_KINDS, "from bt")
    _add(
        "target_label",
        WITH_FEATURES,
        "cust_key:i target_shopped_ind:i",
        "select cust_key, coalesce(target_shopped_ind, 0) as target_shopped_ind from pop left join target using (cust_key)",
    )
    for name, source, suffix, kind in (
        ("pct_spend_in_event", "espend", "pct_spend", "f"),
        ("pct_spend_in_event_ly", "espend_ly", "pct_spend", "f"),
        ("pct_trips_in_event", "etrips", "pct_trips", "f"),
        ("pct_events_shopped", "shopped", "pct_shopped", "f"),
        ("event_shopped_ly", "shopped_ly", "shopped_ind", "i"),
    ):
        _add(name, WITH_FEATURES, f"cust_key:i {_kinds([f'{s}_{suffix}' for s in S.SHORT_NAMES], kind)}", f"from {source}")
    kinds = f"cust_key:i {_kinds(STATS_SUMS, 'f')} {_kinds(STATS_COUNTS, 'i')} fl_last_sale_dt:d"
    _add("cust_stats", WITH_FEATURES, kinds, "from stats")
    _add("feature_matrix", WITH_MATRIX, MATRIX_KINDS, "from matrix")
    _add(
        "tenure_recency",
        WITH_FEATURES,
        "cust_key:i tenure_total_months:f months_since_last_sale:f",
        f"""select cust_key, {_months(FEATURE_END, 'acq_dt')} as tenure_total_months,
        {_months(START, 'fl_last_sale_dt')} as months_since_last_sale
        from pop join funnel using (cust_key) left join stats using (cust_key)""",
    )


def _distribution() -> None:
    parts = WITH_FEATURES + [DISTRIBUTION]
    _add(
        "persona_event_dist",
        parts,
        "persona:i event:s year:i start_dt:d end_dt:d n_shopped:i n_existing:i n_notshopped:i",
        "select *, n_existing - n_shopped as n_notshopped from dist",
    )
    share = "select persona, event, sum(n_shopped) / sum(n_existing)::double as share from dist"
    pivots = " union all ".join(
        f"select '{years}' as years, * from ({_pivot('share', f'({share} {where} group by 1, 2)', 'event')})"
        for years, where in (("all", ""), (C.LAST_YEAR, f"where year = {C.LAST_YEAR}"))
    )
    _add("persona_event_pct", parts, f"years:s event:s {_kinds(PERSONA_NAMES, 'f')}", pivots)

    def tested(name: str, by: list[str], outcomes: list[str]) -> str:
        factors = by + ["outcome"]
        long = " union all ".join(f"select {', '.join(by)}, '{o}' as outcome, {o} as n from wide" for o in outcomes)
        grid = " cross join ".join(f"(select distinct {f} from wide)" for f in by)
        grid += f" cross join (values {', '.join(repr((o,)).replace(',)', ')') for o in outcomes)}) v(outcome)"
        margins = " * ".join(f"(sum(o) over (partition by {f}) / total)" for f in factors)
        levels = " * ".join(f"count(distinct {f})" for f in factors)
        summed = " - ".join(f"count(distinct {f})" for f in factors)
        return f"""select '{name}' as test, sum((o - e) * (o - e) / e) as statistic, {levels} - {summed} + {len(factors) - 1} as dof,
          {levels} as n_cells, max(total) as total from (select *, {margins} * total as e from (
          select *, sum(o) over () as total from (select {', '.join(factors)}, coalesce(sum(n), 0)::double as o
            from (select * from {grid}) left join ({long}) using ({', '.join(factors)}) group by all)))"""

    wide = "wide as (select *, n_existing - n_shopped as n_notshopped from dist)"
    _add(
        "chi2_persona_event",
        parts + [wide],
        "test:s statistic:f dof:i n_cells:i total:f",
        tested("persona_year_event", ["persona", "year", "event"], ["n_shopped", "n_existing"])
        + " union all "
        + tested("persona_event", ["persona", "event"], ["n_shopped", "n_notshopped"]),
    )
    _add(
        "label_rate_by_persona",
        WITH_MATRIX,
        "persona:i n:i n_pos:i pct:f",
        "select persona, count(*) as n, sum(target_shopped_ind) as n_pos, avg(target_shopped_ind) as pct from matrix group by 1",
    )


def _sampling_and_scaling() -> None:
    _add(
        "sample_per_group",
        WITH_MATRIX,
        IDS,
        f"from matrix qualify {_place(S.SAMPLE_SEED, 'persona')} <= {C.N_SAMPLE} // (select count(distinct persona) from matrix)",
    )
    _add("sample_n", WITH_MATRIX, IDS, f"from matrix qualify {_place(S.SAMPLE_SEED, '')} <= {C.N_SAMPLE}")
    quota = f"""
    sizes as (select persona, target_shopped_ind, count(*) as size from matrix group by 1, 2),
    exacts as (select *, ({C.N_SAMPLE} // (select count(distinct persona) from matrix)) * size::double
      / sum(size) over (partition by persona) as exact from sizes),
    quotas as (select persona, target_shopped_ind, floor(exact) + case when row_number() over (partition by persona
        order by round(exact - floor(exact), 9) desc, target_shopped_ind)
      <= round(sum(exact) over (partition by persona)) - sum(floor(exact)) over (partition by persona)
      then 1 else 0 end as quota from exacts)"""
    _add(
        "sample_stratified",
        WITH_MATRIX + [quota],
        IDS,
        f"""select matrix.* from matrix join quotas using (persona, target_shopped_ind)
        qualify {_place(S.SAMPLE_SEED, 'persona, target_shopped_ind')} <= quota""",
    )
    _add("stratified_split", WITH_MATRIX + [SPLIT], f"{IDS} is_train:i", "from split")
    _add(
        "stratified_folds",
        WITH_MATRIX,
        f"{IDS} fold:i",
        f"select *, ({_place(S.SPLIT_SEED, 'persona, target_shopped_ind')} - 1) % 5 as fold from matrix",
    )
    draws = f"""
    indexed as (select cust_key, persona, target_shopped_ind, {_place(S.SAMPLE_SEED, '')} - 1 as i, count(*) over () as n from matrix),
    drawn as (select ('0x' || substr(md5('{S.SAMPLE_SEED}-draw-' || i), 1, 13))::bigint % n as i, count(*) as draws
      from indexed group by 1)"""
    _add("bootstrap_resample", WITH_MATRIX + [draws], f"{IDS} draws:i", "from indexed join drawn using (i)")

    logged = [f for f in FEATURES if f in S.LOG_FEATURES]
    replaced = ", ".join(f"case when {f} <= 0 then -1 else ln({f}) end as log_{f}" for f in logged)
    kinds = " ".join(
        f"log_{n}:f" if n in logged else f"{n}:{k}" for n, k in (item.split(":") for item in MATRIX_KINDS.split())
    )
    _add(
        "log_features",
        WITH_MATRIX,
        f"{kinds} months_since_last_squared:f",
        f"""select * exclude ({', '.join(logged)}), {replaced},
        months_since_last_sale * months_since_last_sale as months_since_last_squared from matrix""",
    )
    scaled = ", ".join(
        f"({f} - (select avg({f}) from split where is_train = 1)) / (select case when coalesce(stddev_pop({f}), 0) <= 1e-9 then 1"
        f" else stddev_pop({f}) end from split where is_train = 1) as {f}"
        for f in FEATURES
    )
    _add(
        "scale_standard",
        WITH_MATRIX + [SPLIT],
        f"{IDS} {_kinds(FEATURES, 'f')} is_train:i",
        f"select cust_key, persona, target_shopped_ind, is_train, {scaled} from split",
    )

    def by_rule(f: str) -> str:
        value = f"case when {f} <= 0 then -0.5 else ln({f}) end" if f in logged else f
        if "_pct_" in f:
            return f"{value} / 100.0::double"
        if f.endswith("_ind"):
            return value
        if f == "tenure_total_months":
            return f"case when {f} > 96 then 1 else {f} / 96 end"
        if "months" in f:
            return f"{f} / 24"
        return f"({value} - min({value}) over ()) / (max({value}) over () - min({value}) over ())::double"

    kinds = " ".join(f"{f}:{'i' if f.endswith('_ind') else 'f'}" for f in FEATURES)
    _add(
        "transform_by_rule",
        WITH_MATRIX,
        f"{IDS} {kinds}",
        f"select cust_key, persona, target_shopped_ind, {', '.join(f'{by_rule(f)} as {f}' for f in FEATURES)} from matrix",
    )
    whole = "floor(tenure_total_months)"
    logs = {"log1p": f"ln(1 + {whole})", "log": f"ln(nullif({whole}, 0))", "floored": f"case when {whole} <= 0 then -1 else ln(nullif({whole}, 0)) end"}
    on_unit = ", ".join(
        f"({v} - min({v}) over ()) / (max({v}) over () - min({v}) over ()) as tenure_{n}" for n, v in logs.items()
    )
    _add(
        "min_max_log",
        WITH_MATRIX,
        f"cust_key:i tenure:f {_kinds([f'tenure_{n}' for n in logs], 'f')}",
        f"select cust_key, tenure_total_months as tenure, {on_unit} from matrix",
    )
    _add(
        "score_deciles",
        WITH_MATRIX + [SCORED],
        "cust_key:i persona:i y:i prob:f pred:i pct_rank:f decile:i",
        """select *, ceil(round(10 * pct_rank, 9)) as decile from (select *, (rank() over (partition by persona order by prob)
        + (count(*) over (partition by persona, prob) - 1) / 2.0::double) / count(*) over (partition by persona) as pct_rank from scored)""",
    )


def _profiling_and_selection() -> None:
    types = {f: "int" if f.endswith("_ind") else "bigint" if f in WHOLE_FEATURES else "double" for f in FEATURES}
    profiles = " union all ".join(
        f"select '{f}' as column_name, '{types[f]}' as data_type, min({f})::double as min_value, max({f})::double as max_value, "
        f"count(*) - count({f}) as n_null from matrix"
        for f in FEATURES
    )
    _add("column_profile", WITH_MATRIX, "column_name:s data_type:s min_value:f max_value:f n_null:i", profiles)
    _add(
        "key_alignment",
        WITH_MATRIX,
        "n_both:i n_left_only:i n_right_only:i aligned:i",
        "select count(*) as n_both, 0 as n_left_only, 0 as n_right_only, 1 as aligned from matrix",
    )
    high = """
    spread as (select persona, feature from long_matrix group by 1, 2 having max(value) > min(value)),
    centred as (select cust_key, l.persona, l.feature, value - avg(value) over (partition by l.persona, l.feature) as x
      from long_matrix l join spread s on s.persona = l.persona and s.feature = l.feature),
    pairs as (
      select a.persona, a.feature as feature_1, b.feature as feature_2,
        round(abs(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x))), 9) as corr
      from centred a join centred b on a.cust_key = b.cust_key and a.feature <> b.feature group by 1, 2, 3),
    high as (select *, dense_rank() over (partition by persona order by corr desc) as rank from pairs where corr > 0.8 and corr < 1)"""
    _add("high_corr_pairs", WITH_LONG + [high], "persona:i feature_1:s feature_2:s corr:f rank:i", "from high")
    total = " + ".join(f"coalesce({p}, 0)" for p in PERSONA_NAMES)
    _add(
        "high_corr_pivot",
        WITH_LONG + [high],
        f"feature_1:s feature_2:s {_kinds(PERSONA_NAMES, 'f')} sum:f",
        f"select *, {total} as sum from ({_pivot('corr', 'high', 'feature_1, feature_2')})",
    )
    _add(
        "low_variance",
        WITH_LONG,
        "persona:i feature:s variance:f rank:i",
        """select *, dense_rank() over (partition by persona order by variance) as rank from (select persona, feature,
        round(var_samp(value), 9) as variance from long_matrix group by 1, 2) where variance < 0.05""",
    )
    low = """select persona, feature, round(var_samp(value), 9) as variance from long_matrix group by 1, 2
      having round(var_samp(value), 9) < 0.05"""
    _add(
        "low_variance_pivot",
        WITH_LONG,
        f"feature:s {_kinds(PERSONA_NAMES, 'f')}",
        _pivot("variance", f"({low})", "feature"),
    )
    _add(
        "value_counts",
        WITH_MATRIX,
        "target_shopped_ind:i n:i",
        "select target_shopped_ind, count(*) as n from matrix group by 1",
    )
    counted = "select persona, feature, count(value) as n_nonnull from long_matrix group by 1, 2"
    dropped = sorted({(p, f) for p in S.PERSONAS for f in S.DROPPED_EVERYWHERE + S.DROPPED_BY_PERSONA[p]})
    _add("nonnull_features", WITH_LONG, "persona:i feature:s n_nonnull:i", counted)
    _add(
        "keep_features",
        WITH_LONG + [f"dropped(persona, feature) as ({_values(dropped)})"],
        "persona:i feature:s n_nonnull:i",
        f"{counted} having (persona, feature) not in (select (persona, feature) from dropped)",
    )
    _add("feature_types", WITH_TYPES, "feature:s n_distinct:i feature_type:s", "from types")

    with_importances = WITH_TYPES + [IMPORTANCES]
    ranked = """(select *, rank() over (partition by persona, feature_type order by importance desc) as r from importances)"""
    _add(
        "rank_importance",
        with_importances,
        f"feature_type:s feature:s {_kinds(PERSONA_NAMES, 'i')}",
        _pivot("r", ranked, "feature_type, feature"),
    )
    _add(
        "rank_from_top",
        with_importances,
        "persona:i feature:s importance:f feature_type:s rank:f",
        """select *, 35 - (rank() over (partition by persona order by importance)
        + (count(*) over (partition by persona, importance) - 1) / 2.0::double) as rank from importances""",
    )
    quotas = """
    totals(persona, n) as (values (1, 51), (2, 45), (4, 55), (5, 71)),
    given(persona, feature_type, q) as (values (3, 'continuous', 32), (3, 'binary', 13), (3, 'ordinal', 11)),
    per_type as (select persona, feature_type, count(*) as k, sum(count(*)) over (partition by persona) as all_k,
      any_value(n) as n from importances left join totals using (persona) group by 1, 2),
    shares as (select *, floor(n * k / all_k::double) as whole, n * k / all_k::double - floor(n * k / all_k::double) as rest from per_type),
    quotas as (select persona, feature_type, case when n >= all_k then k else whole + case when row_number() over (
        partition by persona order by round(rest, 9) desc, feature_type) <= n - sum(whole) over (partition by persona)
        then 1 else 0 end end as q from shares where n is not null union all from given),
    averaged as (select *, rank() over (partition by persona, feature_type order by importance desc)
      + (count(*) over (partition by persona, feature_type, importance) - 1) / 2.0 as r from importances)"""
    _add(
        "top_stratified",
        with_importances + [quotas],
        "persona:i feature:s importance:f feature_type:s",
        "select averaged.* from averaged join quotas using (persona, feature_type) where r <= q",
    )
    with_coefs = WITH_LONG + [COEFS]
    kinds = "persona:i feature:s prop_selected:f mean_coef:f abs_mean_coef:f std:f"
    _add("bootstrap_summary", with_coefs, kinds, "from raw_summary")
    limit = "case persona when 1 then 57 when 2 then 49 when 3 then 60 when 4 then 59 else 55 end"
    order = "row_number() over (partition by persona order by prop_selected desc, abs_mean_coef desc, feature)"
    _add("top_bootstrapped", with_coefs, kinds, f"from summary qualify {order} <= {limit}")
    least = "case persona when 2 then 70 when 4 then 49 when 5 then 71 else 0 end"
    above = "count(*) filter (where prop_selected > 0.5) over (partition by persona)"
    _add(
        "threshold_bootstrapped",
        with_coefs,
        kinds,
        f"from summary qualify case when {above} < {least} then {order} <= {least} else prop_selected > 0.5 end",
    )
    users = {f: [p for p in S.PERSONAS if f not in S.DROPPED_EVERYWHERE + S.DROPPED_BY_PERSONA[p]] for f in FEATURES}
    narrowed = {f: ps for f, ps in users.items() if ps}
    columns = ", ".join(
        f"case when persona in ({', '.join(map(str, ps))}) then {f} end as {f}" for f, ps in narrowed.items()
    )
    _add(
        "narrow_by_persona",
        WITH_MATRIX,
        f"{IDS} " + " ".join(f"{f}:{'i' if f in WHOLE_FEATURES else 'f'}" for f in narrowed),
        f"select cust_key, persona, target_shopped_ind, {columns} from matrix",
    )
    member = ", ".join(f"count(*) filter (where persona = {p}) as persona_{p}" for p in S.PERSONAS)
    _add(
        "feature_membership",
        with_coefs + [CHOSEN],
        f"feature:s {_kinds(PERSONA_NAMES, 'i')}",
        f"select feature, {member} from chosen group by 1",
    )
    by_type = ", ".join(f"count(*) filter (where feature_type = '{k}') as {k}" for k in ("binary", "ordinal", "continuous"))
    _add(
        "membership_by_type",
        WITH_TYPES + [COEFS, CHOSEN],
        "persona:i binary:i ordinal:i continuous:i total:i",
        f"select persona, {by_type}, count(*) as total from chosen join types using (feature) group by 1",
    )
    _add(
        "best_params",
        with_importances,
        "persona:i width:f",
        """select persona, min(length(feature)) as width from importances
        where (persona, importance) in (select (persona, max(importance)) from importances group by persona) group by 1""",
    )


def _evaluation() -> None:
    parts = WITH_MATRIX + [SCORED]
    _add(
        "score_metrics",
        parts,
        "persona:i n:i null_accuracy:f accuracy:f precision:f recall:f bal_accuracy:f log_loss:f roc_auc:f",
        """select persona, count(*) as n, 1 - avg(y) as null_accuracy, avg((y = pred)::int) as accuracy,
        coalesce(sum(y * pred) / nullif(sum(pred), 0)::double, 0) as precision, coalesce(sum(y * pred) / nullif(sum(y), 0)::double, 0) as recall,
        0.5 * (sum(y * pred) / nullif(sum(y), 0)::double + sum((1 - y) * (1 - pred)) / nullif(sum(1 - y), 0)::double) as bal_accuracy,
        -avg(y * ln(greatest(1e-15, least(1 - 1e-15, prob))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, prob)))) as log_loss,
        (sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1) / 2.0::double) / nullif(sum(y) * sum(1 - y), 0)::double as roc_auc
        from (select *, rank() over (partition by persona order by prob)
          + (count(*) over (partition by persona, prob) - 1) / 2.0::double as r from scored) group by 1""",
    )
    margin = " ".join(
        f"when {p} then {w[-1]!r}::double + " + " + ".join(f"({v!r}::double) * {f}::double" for f, v in zip(C.FIXED_FEATURES, w, strict=False))
        for p, w in C.FIXED_COEFS.items()
    )
    _add(
        "score_fixed",
        WITH_MATRIX,
        "cust_key:i persona:i y:i pred:i prob:f",
        f"""select *, (prob > 0.5)::int as pred from
        (select cust_key, persona, target_shopped_ind as y, 1 / (1 + exp(-(case persona {margin} end))) as prob from matrix)""",
    )
    _add(
        "export_order",
        WITH_MATRIX,
        "row_number:i persona:s target_shopped_ind:s cust_key:s",
        """select row_number() over (order by persona::varchar desc, target_shopped_ind::varchar desc, cust_key::varchar) as row_number,
        persona::varchar as persona, target_shopped_ind::varchar as target_shopped_ind, cust_key::varchar as cust_key from matrix""",
    )
    _add("loaded_table", WITH_MATRIX, MATRIX_KINDS, "from matrix")
    _add("persona_folders", WITH_MATRIX + [SPLIT], f"{IDS} is_train:i", "from split")
    _add(
        "reloaded_models",
        WITH_MATRIX + [SPLIT],
        "persona:i n_rows:i n_changed:i",
        "select persona, count(*) as n_rows, 0 as n_changed from split where not is_train group by 1",
    )
    _add("confusion_matrix", parts, "persona:i y:i pred:i n:i", "select persona, y, pred, count(*) as n from scored group by all")
    _add(
        "percentile_cutoff",
        parts,
        "cust_key:i persona:i y:i prob:f pred:i cutoff:f",
        """select cust_key, persona, y, prob, (prob >= cutoff)::int as pred, cutoff from scored
        join (select persona, quantile_cont(prob, 0.95) as cutoff from scored group by 1) using (persona)""",
    )


for _section in (
    _sources_and_calendar,
    _population_and_features,
    _distribution,
    _sampling_and_scaling,
    _profiling_and_selection,
    _evaluation,
):
    _section()
