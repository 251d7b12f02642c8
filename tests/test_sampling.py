from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from footfall.operators import ranking as R
from footfall.operators import sampling as SA
from footfall.operators import scaling as SC


def people(spark, sizes):
    """sizes: {(persona, target): n}"""
    rows, key = [], 0
    for (persona, target), n in sizes.items():
        for _ in range(n):
            rows.append((key, persona, target))
            key += 1
    return spark.createDataFrame(rows, "cust_key long, persona int, target_shopped_ind int")


def test_equal_samples_are_exact_and_repeatable(spark):
    df = people(spark, {(1, 0): 900, (1, 1): 100, (2, 0): 50, (3, 0): 10})
    sample = SA.sample_per_group(df, 100, seed=1)
    assert Counter(r.persona for r in sample.collect()) == {1: 33, 2: 33, 3: 10}  # 3 is smaller than its share
    keys = {r.cust_key for r in sample.collect()}
    assert keys == {r.cust_key for r in SA.sample_per_group(df.repartition(5), 100, seed=1).collect()}
    assert keys != {r.cust_key for r in SA.sample_per_group(df, 100, seed=2).collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 130), seed=st.integers(0, 5))
def test_sample_n_has_n_rows(spark, n, seed):
    df = people(spark, {(1, 0): 120})
    got = [r.cust_key for r in SA.sample_n(df, n, seed).collect()]
    assert len(got) == min(n, 120) == len(set(got))


def test_largest_remainders(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (1, "b", 10), (2, "a", 3), (2, "b", 7)], "g int, s string, size long")
    got = {(r.g, r.s): r.quota for r in SA.allocate(sizes, ["g", "s"], "6", within=["g"]).collect()}
    assert got == {(1, "a"): 3, (1, "b"): 3, (2, "a"): 2, (2, "b"): 4}
    got = {(r.g, r.s): r.quota for r in SA.allocate(sizes, ["g", "s"], "7").collect()}
    assert sum(got.values()) == 7


def test_stratified_sample(spark):
    df = people(spark, {(1, 0): 80, (1, 1): 20, (2, 0): 30, (2, 1): 30})
    got = Counter((r.persona, r.target_shopped_ind) for r in SA.sample_stratified(df, 40, seed=3).collect())
    assert got == {(1, 0): 16, (1, 1): 4, (2, 0): 10, (2, 1): 10}


def test_split_is_complete_and_stratified(spark):
    sizes = {(p, t): 37 * p + 11 * t for p in (1, 2, 3) for t in (0, 1)}
    df = people(spark, sizes)
    split = SA.stratified_split(df, 0.7, seed=8379).collect()
    assert len(split) == len({r.cust_key for r in split}) == sum(sizes.values())
    train = Counter((r.persona, r.target_shopped_ind) for r in split if r.is_train)
    assert sum(train.values()) == int(0.7 * sum(sizes.values()))
    assert all(abs(train[k] - 0.7 * n) < 1 for k, n in sizes.items())


def test_folds_differ_by_one_row(spark):
    folded = SA.stratified_folds(people(spark, {(1, 0): 53, (1, 1): 7}), 5, seed=1).collect()
    for target in (0, 1):
        counts = Counter(r.fold for r in folded if r.target_shopped_ind == target)
        assert len(counts) == 5 and max(counts.values()) - min(counts.values()) <= 1


def test_bootstrap_draws_n_rows(spark):
    df = people(spark, {(1, 0): 500})
    drawn = SA.bootstrap_resample(df, seed=4).collect()
    assert sum(r.draws for r in drawn) == 500
    assert 280 < len(drawn) < 350  # about 1 - 1/e of the rows


def test_poisson_weights(spark):
    df = people(spark, {(1, 0): 20000}).select(SA.poisson_weight(9, 0).alias("w"))
    counts = Counter(r.w for r in df.collect())
    assert sum(w * n for w, n in counts.items()) / 20000 == pytest.approx(1.0, abs=0.03)
    assert counts[0.0] / 20000 == pytest.approx(0.3679, abs=0.015)
    assert counts[2.0] / 20000 == pytest.approx(0.1839, abs=0.015)


def test_floored_log(spark):
    df = spark.createDataFrame([(0.0,), (-3.0,), (1.0,), (2.718281828459045,), (None,)], "fl_total_spend double")
    out = SC.log_features(df)
    assert out.columns == ["log_fl_total_spend"]
    assert [r[0] for r in out.collect()] == [-1.0, -1.0, 0.0, pytest.approx(1.0), None]


def test_standard_scaling(spark):
    train = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, constant double")
    test = spark.createDataFrame([(4.0, 6.0)], "a double, constant double")
    scaled, other = SC.scale_data(train, test, ["a", "constant"])
    got = [tuple(r) for r in scaled.collect()]
    assert [g[0] for g in got] == pytest.approx([-1.224744871391589, 0, 1.224744871391589])
    assert [g[1] for g in got] == [0, 0, 0]
    assert tuple(other.first()) == pytest.approx((2 / 0.816496580927726, 1.0))


def test_scaling_by_rule(spark):
    df = spark.createDataFrame(
        [(10.0, 1, 120.0, 1.0, 0.0), (20.0, 0, 48.0, 3.0, 1.0)],
        "x_pct_spend double, y_ind int, tenure_total_months double, divs double, fl_total_spend double",
    )
    out = SC.transform_by_rule(df, df.columns, ["fl_total_spend"], -0.5)
    rows = SC.cap_months(out.withColumn("months_since_last_sale", out.divs), "tenure_total_months").collect()
    assert [r.x_pct_spend for r in rows] == [0.1, 0.2] and [r.y_ind for r in rows] == [1, 0]
    assert [r.tenure_total_months for r in rows] == [1.0, 0.5] and [r.divs for r in rows] == [0.0, 1.0]
    assert [r.fl_total_spend for r in rows] == [0.0, 1.0]


def test_min_max_log(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (7.9,)], "x double")
    assert [r.x_scaled for r in SC.min_max_log(df, "x").collect()] == pytest.approx([0, 1 / 3, 1])


def test_ranks_and_percentiles_over_many_ranges(spark):
    values = [(1, float(v % 37)) for v in range(1000)] + [(2, float(v)) for v in range(101)]
    df = spark.createDataFrame(values, "g int, v double")
    ranks = {(r.g, r.v): r for r in R.value_ranks(df, ["g"], "v").collect()}
    group = sorted(v for g, v in values if g == 1)
    for v in set(group):
        places = [i + 1 for i, x in enumerate(group) if x == v]
        assert ranks[(1, v)].avg_rank == sum(places) / len(places)
    assert {r.g: r.percentile for r in R.percentile(df, ["g"], "v", 0.95).collect()}[2] == 95.0
    deciles = R.percent_ranks(df.where("g = 2"), ["g"], "v").collect()
    assert Counter(r.decile for r in deciles) == {**{d: 10 for d in range(1, 11)}, 10: 11} or len(deciles) == 101
