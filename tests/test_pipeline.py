import tempfile
from datetime import date
from pathlib import Path

import pytest
from pyspark.ml.classification import LogisticRegressionModel
from retail_fixture import line, tables

from footfall import settings as S
from footfall.operators import calendar as C
from footfall.plans import pipeline as P
from footfall.sources import staging
from footfall.sources import tables as IO
from footfall.sources.retail import retail_tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder():
    return tempfile.mkdtemp(prefix="run-")


def test_event_config(spark, folder):
    path = f"{folder}/events.json"
    with open(path, "w") as f:
        f.write('[\n {"event": "mktg_wellness",\n  "short_event": "wellness", "event_slug": "wellness"}\n]')
    assert [tuple(r) for r in IO.read_event_config(spark, path).collect()] == [("mktg_wellness", "wellness", "wellness")]
    assert IO.read_event_config(spark).count() == 14


def test_tables_by_suffix(spark, folder):
    t = tables(spark, [line(1, "2016-07-01")], {1: "2013-01-01"})
    for name in IO.TABLE_NAMES:
        getattr(t, name).write.parquet(f"{folder}/warehouse/{name}_test")
        getattr(t, name).createOrReplaceTempView(f"wh_{name}_test")
    assert IO.parquet_tables(spark, f"{folder}/warehouse", test=True).trans.count() == 1
    assert IO.warehouse_tables(spark, "wh_", test=True).funnel.count() == 1


def test_delimited_files(spark, folder):
    df = spark.createDataFrame([(i, i % 5 + 1, i % 2, i / 7) for i in range(50)], "cust_key long, persona int, target_shopped_ind int, x double")
    IO.export_matrix(df, f"{folder}/export", single_file=True)
    back = IO.read_delimited(spark, f"{folder}/export", df.schema)
    assert [r.persona for r in back.collect()] == sorted((r.persona for r in df.collect()), reverse=True)
    assert sorted(back.collect()) == sorted(df.collect())
    lines = [r.value for r in spark.read.text(f"{folder}/export").collect()]
    assert lines[0] == "cust_key|persona|target_shopped_ind|x"
    IO.write_delimited(df, f"{folder}/plain", sep=",", gzip=False)
    assert IO.read_delimited(spark, f"{folder}/plain", df.schema, sep=",").count() == 50
    IO.save_by_persona(df, f"{folder}/by_persona")
    assert spark.read.parquet(f"{folder}/by_persona").where("persona = 3").count() == 10


def test_stored_tables_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(staging, "_written", {})
    paths = [staging.materialize(spark.range(3), name).inputFiles()[0].removeprefix("file://") for name in ("a", "b")]
    assert all(Path(p).exists() for p in paths)
    assert staging.remove_stored(spark) == 2 and staging.remove_stored(spark) == 0
    assert not any(Path(p).parent.exists() for p in paths)


def test_checkpoint_folder_comes_from_the_session(spark, folder):
    table = staging.materialize(spark.range(5), "five")
    assert table.count() == 5 and staging.checkpoint_dir(spark) in table.inputFiles()[0]


def test_whole_run(spark, folder):
    run = P.Run(
        out=f"{folder}/run", sample_size=1000, n_resample=2, n_trees=5, n_boosts=2, max_iter=10,
        forest_depth={p: 3 for p in S.PERSONAS}, top_forest={p: 20 for p in S.PERSONAS},
        top_logistic={p: 20 for p in S.PERSONAS}, search=("enet",), n_folds=2,
        grids={"enet": [{"alpha": 0.01, "l1_ratio": 1.0}, {"alpha": 100.0, "l1_ratio": 1.0}]},
    )
    assert run.slug == "annpub17"
    events = C.default_event_calendar(spark, date(2019, 12, 31)).persist()
    scores = P.run_all(run, retail_tables(spark, SF), events, models=["rf_gini", "enet"])
    assert {(r.model, r.persona) for r in scores.collect()} == {(m, p) for m in ("rf_gini", "enet") for p in S.PERSONAS}
    train = spark.read.parquet(run.path("unscaled_train_sample"))
    test = spark.read.parquet(run.path("unscaled_test_sample"))
    sample = spark.read.parquet(run.path("sample"))
    assert train.count() == int(0.7 * sample.count()) and train.count() + test.count() == sample.count()
    assert "log_fl_total_spend" in train.columns and "fl_total_spend" not in train.columns
    results = spark.read.parquet(run.path("search/enet"))
    assert results.count() == 2 * len(S.PERSONAS) and spark.read.parquet(run.path("persona_event_test")).count() == 1
    models = IO.load_models(spark, LogisticRegressionModel, run.path("models/enet"))
    assert sorted(models) == S.PERSONAS and models[1].numFeatures <= 20
    assert {m.getRegParam() for m in models.values()} <= {0.01, 100.0}


def test_the_planted_depth_is_fitted(spark, tmp_path):
    """The label is whether two signs agree, which a single split cannot see."""
    import random

    draw = random.Random(3)
    rows = []
    for key in range(800):
        a, b = draw.uniform(-1, 1), draw.uniform(-1, 1)
        rows.append((key, 1 + key % 2, int((a > 0) == (b > 0)), a, b))
    train = spark.createDataFrame(rows, "cust_key long, persona int, target_shopped_ind int, a double, b double")
    run = P.Run(out=str(tmp_path), n_trees=15, n_folds=2, search=("rf_gini",), grids={"rf_gini": [{"depth": 1}, {"depth": 5}]})
    make = P.searched(run, "rf_gini", train, {1: ["a", "b"], 2: ["a", "b"]})
    assert [make(p, 400).getMaxDepth() for p in (1, 2)] == [5, 5]
