"""Names, lists and date rules that results depend on."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple


class Event(NamedTuple):
    event: str
    short_event: str
    event_slug: str


# The modelled events, their short names and file slugs.
MODELLED_EVENTS = [
    Event("anniversary_early_access", "anniversary_early", "annearly"),
    Event("anniversary_public_event", "anniversary_public", "annpub"),
    Event("december_half_yearly", "december_halfyear", "dechy"),
    Event("may_half_yearly", "may_halfyear", "mayhy"),
    Event("mktg_wellness", "wellness", "wellness"),
    Event("mktg_spring_fashion", "spring_fashion", "spring"),
    Event("mktg_fall_fashion", "fall_fashion", "fall"),
    Event("mktg_holiday_light", "holiday_light", "hollite"),
    Event("mktg_holiday_full", "holiday_full", "holfull"),
    Event("mktg_backtoschool", "backtoschool", "school"),
    Event("mktg_holiday_dressing", "holiday_dressing", "holdress"),
    Event("mktg_valentines_day", "valentines_day", "valent"),
    Event("mktg_mothers_day", "mothers_day", "mothers"),
    Event("mktg_fathers_day", "fathers_day", "fathers"),
]
EVENT_NAMES = [e.event for e in MODELLED_EVENTS]
SHORT_NAMES = [e.short_event for e in MODELLED_EVENTS]

# The daily flags of the event calendar, in column order.
CALENDAR_FLAGS = [
    "anniversary_early_access",
    "anniversary_l4_preshop",
    "anniversary_public_event",
    "black_friday_cyber_monday",
    "christmas",
    "december_half_yearly",
    "easter",
    "fathers_day",
    "mothers_day",
    "thanksgiving",
    "valentines_day",
    "labor_day_clearance",
    "march_triple_rewards",
    "may_triple_rewards",
    "september_triple_rewards",
    "fall_clearance",
    "june_summer_clearance",
    "may_half_yearly",
    "winter_clearance",
    "mktg_wellness",
    "mktg_spring_fashion",
    "mktg_fall_fashion",
    "mktg_holiday_light",
    "mktg_holiday_full",
    "mktg_backtoschool",
    "mktg_holiday_dressing",
    "mktg_valentines_day",
    "mktg_mothers_day",
    "mktg_fathers_day",
]

# Which flags make up each rollup flag.
ROLLUPS = {
    "holiday": ["easter", "christmas", "thanksgiving", "mothers_day", "fathers_day", "valentines_day"],
    "loyalty": [
        "anniversary_early_access",
        "anniversary_l4_preshop",
        "march_triple_rewards",
        "may_triple_rewards",
        "september_triple_rewards",
    ],
    "sale": [
        "anniversary_early_access",
        "anniversary_l4_preshop",
        "anniversary_public_event",
        "black_friday_cyber_monday",
        "december_half_yearly",
        "fall_clearance",
        "june_summer_clearance",
        "labor_day_clearance",
        "may_half_yearly",
        "winter_clearance",
    ],
}
ROLLUP_PAIRS = {
    "holiday_loyalty": ["holiday", "loyalty"],
    "holiday_sale": ["holiday", "sale"],
    "loyalty_sale": ["loyalty", "sale"],
    "holiday_loyalty_sale": ["holiday", "loyalty", "sale"],
}


class FiscalWindow(NamedTuple):
    """Days whose fiscal position lies in [lo, hi], in calendar years [first, last].

    A position is the three digits month, week, day of the 4-5-4 calendar, so 624 is
    month 6, week 2, day 4.  With ``shifted`` one week is added after a 53-week year.
    """

    event: str
    first: int
    last: int
    shifted: bool
    lo: int
    hi: int


# Event windows that follow the fiscal calendar.
FISCAL_WINDOWS = [
    FiscalWindow("anniversary_early_access", 0, 2015, False, 614, 625),
    FiscalWindow("anniversary_early_access", 2016, 9999, True, 625, 635),
    FiscalWindow("anniversary_l4_preshop", 2016, 9999, True, 624, 624),
    FiscalWindow("anniversary_public_event", 0, 2015, False, 626, 711),
    FiscalWindow("anniversary_public_event", 2016, 9999, True, 636, 721),
    FiscalWindow("march_triple_rewards", 0, 2015, False, 234, 241),
    FiscalWindow("march_triple_rewards", 2016, 9999, True, 244, 251),
    FiscalWindow("may_triple_rewards", 2015, 9999, False, 414, 421),
    FiscalWindow("september_triple_rewards", 0, 2015, False, 834, 841),
    FiscalWindow("september_triple_rewards", 2016, 9999, True, 844, 851),
    FiscalWindow("fall_clearance", 0, 2014, False, 1014, 1031),
    FiscalWindow("fall_clearance", 2015, 9999, True, 956, 957),
    FiscalWindow("fall_clearance", 2015, 9999, True, 1015, 1031),
    FiscalWindow("june_summer_clearance", 0, 2014, False, 526, 541),
    FiscalWindow("june_summer_clearance", 2015, 2015, False, 536, 551),
    FiscalWindow("may_half_yearly", 0, 2015, False, 434, 511),
    FiscalWindow("may_half_yearly", 2016, 9999, True, 444, 521),
    FiscalWindow("winter_clearance", 0, 2014, False, 124, 211),
    FiscalWindow("winter_clearance", 2015, 2015, False, 124, 141),
    FiscalWindow("winter_clearance", 2016, 2016, False, 126, 141),
    FiscalWindow("winter_clearance", 2017, 9999, True, 136, 151),
    FiscalWindow("winter_clearance", 2017, 9999, True, 211, 211),
    FiscalWindow("mktg_fall_fashion", 0, 9999, False, 731, 747),
    FiscalWindow("mktg_fall_fashion", 0, 9999, False, 811, 827),
    FiscalWindow("mktg_holiday_light", 0, 9999, False, 942, 1027),
    FiscalWindow("mktg_backtoschool", 0, 9999, False, 811, 837),
    FiscalWindow("mktg_holiday_dressing", 0, 9999, False, 931, 1117),
    FiscalWindow("mktg_mothers_day", 0, 9999, False, 321, 421),
]


class HolidayWindow(NamedTuple):
    """Days from ``start`` + ``lo`` to ``end`` + ``hi``, in calendar years [first, last].

    ``start`` and ``end`` name holiday columns; ``epiphany_sunday`` (first Sunday after
    New Year's Day), ``month_NN`` (first of a month) and ``month_end_NN`` are derived.
    """

    event: str
    first: int
    last: int
    start: str
    lo: int
    end: str
    hi: int


# Event windows that follow holidays and calendar months.
HOLIDAY_WINDOWS = [
    HolidayWindow("black_friday_cyber_monday", 0, 9999, "thanksgiving", 1, "thanksgiving", 4),
    HolidayWindow("christmas", 0, 9999, "christmas", 0, "christmas", 0),
    HolidayWindow("december_half_yearly", 0, 9999, "christmas", 1, "month_end_12", 0),
    HolidayWindow("december_half_yearly", 0, 2016, "new_years_day", 0, "epiphany_sunday", 0),
    HolidayWindow("december_half_yearly", 2017, 9999, "new_years_day", 0, "new_years_day", 1),
    HolidayWindow("easter", 0, 9999, "easter", 0, "easter", 0),
    HolidayWindow("fathers_day", 0, 9999, "fathers_day", 0, "fathers_day", 0),
    HolidayWindow("mothers_day", 0, 9999, "mothers_day", 0, "mothers_day", 0),
    HolidayWindow("thanksgiving", 0, 9999, "thanksgiving", 0, "thanksgiving", 0),
    HolidayWindow("valentines_day", 0, 9999, "valentines_day", 0, "valentines_day", 0),
    HolidayWindow("labor_day_clearance", 2014, 2015, "labor_day", -5, "labor_day", 6),
    HolidayWindow("labor_day_clearance", 2016, 9999, "labor_day", -3, "labor_day", 6),
    HolidayWindow("mktg_wellness", 0, 9999, "christmas", 1, "month_end_12", 0),
    HolidayWindow("mktg_wellness", 0, 9999, "month_01", 0, "month_end_02", 0),
    HolidayWindow("mktg_spring_fashion", 0, 9999, "month_02", 0, "month_end_03", 0),
    HolidayWindow("mktg_fall_fashion", 0, 9999, "month_09", 0, "month_end_09", 0),
    HolidayWindow("mktg_holiday_light", 0, 9999, "month_11", 0, "thanksgiving", 0),
    HolidayWindow("mktg_holiday_full", 0, 9999, "thanksgiving", 1, "christmas", -1),
    HolidayWindow("mktg_backtoschool", 0, 9999, "month_08", 0, "month_end_08", 0),
    HolidayWindow("mktg_holiday_dressing", 0, 9999, "month_12", 0, "month_end_12", 0),
    HolidayWindow("mktg_valentines_day", 0, 9999, "new_years_day", 0, "valentines_day", 0),
    HolidayWindow("mktg_mothers_day", 0, 9999, "month_05", 0, "mothers_day", 0),
    HolidayWindow("mktg_fathers_day", 0, 9999, "mothers_day", 1, "fathers_day", 0),
]

# Event windows given as plain dates, and days taken out of an event.
DATED_WINDOWS = [
    ("anniversary_l4_preshop", date(2015, 7, 8), date(2015, 7, 8)),
    ("december_half_yearly", date(2013, 1, 6), date(2013, 1, 6)),
    ("labor_day_clearance", date(2013, 8, 28), date(2013, 9, 15)),
]
EXCLUDED_DAYS = [("mktg_holiday_light", date(2015, 10, 26))]

# Easter Sundays.
EASTER_SUNDAYS = [
    date(2013, 3, 31),
    date(2014, 4, 20),
    date(2015, 4, 5),
    date(2016, 3, 27),
    date(2017, 4, 16),
    date(2018, 4, 1),
    date(2019, 4, 21),
    date(2020, 4, 12),
    date(2021, 4, 4),
    date(2022, 4, 17),
    date(2023, 4, 9),
    date(2024, 3, 31),
    date(2025, 4, 20),
    date(2026, 4, 5),
    date(2027, 3, 28),
]
# Fixed value: the one list entry that older results were made with; see ``legacy_easter``.
LEGACY_EASTER_2024 = date(2024, 3, 21)

HOLIDAY_COLUMNS = [
    "new_years_day",
    "valentines_day",
    "easter",
    "mothers_day",
    "memorial_day",
    "fathers_day",
    "labor_day",
    "thanksgiving",
    "christmas",
]

CALENDAR_START = date(2013, 1, 1)

# Selling channels and transaction kinds.
FULL_LINE_CHANNELS = ["FLS", "N.COM"]
WEB_CHANNEL = "N.COM"
RACK_CHANNEL = "RACK"
RESTAURANT_CHANNEL = "RESTAURANT"
MERCH_TYPE = "Merch"
RESTAURANT_TYPE = "Restaurant"

# Product groups behind each spend category.
CATEGORY_GROUPS = {
    "accessories": [
        "Umbrellas",
        "Small Leather Goods",
        "Belts & Braces",
        "Apparel care",
        "Eyewear",
        "Neckwear",
        "Gloves/Mittens",
        "Headwear",
        "Scarves/Wraps/Ponchos",
    ],
    "apparel": [
        "Suits/Sets/Wardrobers",
        "Bottoms",
        "Sleepwear",
        "Dresses",
        "Hosiery",
        "Swimwear",
        "Tops",
        "Jumpsuits/Coveralls",
        "Jacket/Sportcoat",
        "Outerwear",
        "Underwear/Lingerie",
    ],
    "babypet": ["Baby Accessories", "Pet Accessories"],
    "bag": ["Bags"],
    "beauty": [
        "Fragrance",
        "Personal Care Accessories",
        "Hair Accessories",
        "Hair Care",
        "Makeup",
        "Skin/Body Treatment",
    ],
    "entertainment": ["Toys/Games", "Recreation/Entertainment"],
    "food": ["Food"],
    "home": ["Home", "Memorabilia & Collectibles", "Stationery/Giftwrap"],
    "jewelry": ["Jewelry", "Jewelry Care"],
    "other": ["Gift/Operational", "DNU I", "NOT USED I"],
    "shoe": ["Shoes", "Shoe care"],
}

ID_COLUMNS = ["cust_key", "persona", "target_shopped_ind"]

# Exported feature names, in export order.
FEATURE_COLUMNS = (
    ["tenure_total_months", "loyalty_tender_ind", "loyalty_nontender_ind"]
    + ["fl_total_spend", "fl_total_trips", "fl_avg_spend_per_trip", "sale_pct_items"]
    + ["merch_pct_spend", "womens_prod_pct_spend", "mens_prod_pct_spend"]
    + [f"{category}_pct_spend" for category in CATEGORY_GROUPS]
    + ["giftcard_pct_spend", "web_pct_spend", "rack_pct_spend"]
    + ["fl_total_divs", "total_channels", "months_since_last_sale"]
    + ["fl_shopped_ly_ind", "fl_total_spend_ly"]
    + [f"{short}_pct_spend" for short in SHORT_NAMES]
    + [f"{short}_pct_shopped" for short in SHORT_NAMES]
    + [f"{short}_shop_ly_ind" for short in SHORT_NAMES]
)

PERSONAS = [1, 2, 3, 4, 5]

# Pipeline defaults.
DEFAULT_EVENT = "anniversary_public_event"
DEFAULT_YEAR = 2017
FEATURE_DATE_OFFSET = 30
SAMPLE_SIZE = 250_000
SAMPLE_SEED = 30132
SPLIT_SEED = 8379
TRAIN_SIZE = 0.7
LOG_FEATURES = [
    "fl_total_spend",
    "fl_total_trips",
    "fl_avg_spend_per_trip",
    "fl_total_spend_ly",
    "fl_total_trips_ly",
    "fl_avg_spend_per_trip_ly",
]

# Hand-picked features left out of every persona, and of single personas.
DROPPED_EVERYWHERE = ["womens_prod_pct_spend", "fl_shopped_ly_ind", "wellness_pct_shopped"]
DROPPED_BY_PERSONA = {
    1: [
        "log_fl_total_trips",
        "holiday_dressing_pct_shopped",
        "holiday_full_pct_shopped",
        "spring_fashion_pct_shopped",
        "fall_fashion_pct_shopped",
        "backtoschool_pct_shopped",
    ],
    2: [f"{short}_pct_shopped" for short in SHORT_NAMES] + ["wellness_shop_ly_ind"],
    3: ["log_fl_total_trips", "wellness_shop_ly_ind"],
    4: ["log_fl_total_trips", "fall_fashion_pct_shopped", "wellness_shop_ly_ind", "food_pct_spend"],
    5: ["log_fl_total_trips", "food_pct_spend"],
}

# Forest depth per persona, and the grids of the searches.
FOREST_DEPTH = {1: 11, 2: 10, 3: 11, 4: 12, 5: 9}
ENET_ALPHAS = [1e-5, 1e-4, 1e-3, 1e-2, 1e-1]
ENET_L1_RATIOS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
FOREST_DEPTHS = list(range(5, 20))
BOOST_DEPTHS = list(range(2, 7))
L1_CS = [1e-3, 1e-2, 1e-1, 1.0, 1e1, 1e2, 1e3]
