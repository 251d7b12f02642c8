"""The physical plans stay the ones that were meant."""

import contextlib
import io
import re
from datetime import date

import pytest

from footfall.operators import calendar as C
from footfall.operators import distribution as D
from footfall.operators import features as FE
from footfall.operators import matrix as M
from footfall.operators import sampling as SA
from footfall.sources.retail import RetailTables, retail_tables
from footfall.sources.staging import materialize

FEATURE_END = date(2017, 6, 21)


@pytest.fixture(scope="module")
def stored(spark):
    t = retail_tables(spark, "/root/testdata/sf0.001")
    return RetailTables(**{f: materialize(getattr(t, f), f) for f in RetailTables.__dataclass_fields__})


@pytest.fixture(scope="module")
def events(spark):
    return materialize(C.default_event_calendar(spark, date(2019, 12, 31)), "events")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_no_cross_joins_and_one_scan_per_grain(stored, events):
    matrix = plan(M.feature_matrix(stored, events, date(2017, 7, 21), date(2017, 8, 6), FEATURE_END))
    dist = plan(D.persona_event_dist(stored, events, 2013, 2017))
    for text in (matrix, dist):
        assert "NestedLoop" not in text and "Cartesian" not in text
    assert len(re.findall(r"FileScan parquet \[cust_key#\d+L,corp_trip_key", matrix)) == 2
    assert dist.count("sale_dt#") and len(re.findall(r"FileScan parquet \[[^\]]*intent_channel", dist)) == 1


def test_scans_are_pruned_and_filtered(stored, events):
    text = plan(FE.cust_stats(stored, events, FEATURE_END))
    assert "GreaterThanOrEqual(sale_dt,2013-06-21), LessThanOrEqual(sale_dt,2017-06-20)" in text
    spend = plan(FE.pct_spend_in_event(stored, events, FEATURE_END))
    scan = next(s for s in re.findall(r"FileScan parquet \[[^\]]*\]", spend) if "sale_dt" in s)
    assert "prod_div" not in scan and "prod_gender" not in scan and "corp_trip_key" not in scan


def test_lines_are_summed_before_they_are_shuffled(stored, events):
    text = plan(FE.pct_spend_in_event(stored, events, FEATURE_END))
    scan = text.index("FileScan parquet", text.index("partial_sum"))
    assert text.rindex("Exchange hashpartitioning(cust_key", 0, scan) < text.rindex("partial_sum", 0, scan)


def test_choosing_rows_shuffles_nothing(spark, stored):
    chosen = plan(SA.sample_per_group(stored.personas, 50, seed=1))
    assert "hashpartitioning" not in chosen and "rangepartitioning" not in chosen and "Window" not in chosen


def test_load_delimited(spark, stored):
    from footfall.sources import tables as IO
    from footfall.sources.staging import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/footfall-personas.csv"
    IO.write_delimited(stored.personas, path)
    IO.load_delimited(spark, path, stored.personas.schema, "loaded_personas")
    assert sorted(spark.table("loaded_personas").collect()) == sorted(stored.personas.collect())
    spark.sql("drop table loaded_personas")


def test_calendar_scans_the_sales_once(spark):
    from footfall.plans import catalog as C

    context = C.Context(spark, "/root/testdata/sf0.001")
    before = context.daily.inputFiles()
    for build in (C.event_calendar, C.event_rollups, C.calendar_454):
        text = plan(build(context))
        assert "lineitem" not in text and "orders.parquet" not in text
        assert context.daily.inputFiles() == before  # the one scan was stored


def test_last_year_spend_is_one_pass(stored, events):
    text = plan(FE.pct_spend_in_event_ly(stored, events, FEATURE_END))
    assert len(re.findall(r"FileScan parquet \[[^\]]*spend_gross", text)) == 1


def test_tasks_of_the_matrix_follow_the_size_of_the_input(spark, monkeypatch):
    from footfall.sources import staging

    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")}
    monkeypatch.setattr(staging, "TASK_BYTES", 1 << 20)
    rows = spark.range(1_000_000).selectExpr("id * 7 as id", "sha2(string(id), 256) as text").groupBy("id").agg({"text": "max"})
    usual = len(staging.materialize(rows).inputFiles())
    with staging.partitions_by_size(spark, 100 * staging.TASK_BYTES):
        sized = len(staging.materialize(rows.select("*")).inputFiles())
    assert sized > 1.5 * usual, (sized, usual)
    assert before == {k: spark.conf.get(k, None) for k in before}
