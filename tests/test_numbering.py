import random

from footfall.functions.numbering import numbered


def test_numbers_within_groups(spark):
    draw = random.Random(3)
    rows = [(draw.choice([None, "a", "a", "a", "b"]), draw.choice([None, *range(40)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, x int, _at int").repartition(7)
    found = [r.asDict() for r in numbered(df, ["x"], ["g"], "place", size="n").collect()]
    assert sorted(r["_at"] for r in found) == list(range(2000))
    for g in (None, "a", "b"):
        group = sorted((r["place"], r["x"] is not None, r["x"] or 0, r["n"]) for r in found if r["g"] == g)
        assert [p for p, *_ in group] == list(range(len(group))) and {n for *_, n in group} == {len(group)}
        assert [k[1:3] for k in group] == sorted(k[1:3] for k in group)


def test_numbers_whole_table(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(0,)] * 3, "x int").repartition(5)
    found = sorted((r.position, r.x) for r in numbered(df, ["x"]).collect())
    assert found == [(i, int(i > 2)) for i in range(503)]
    assert numbered(df.limit(0), ["x"]).count() == 0
