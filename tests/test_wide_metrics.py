"""Metrics of predictions in columns against those of the long table, with ties, and pairs against their direct count."""

import numpy as np
import pytest
from granary.operators import evaluation as E, metrics as M
from granary.operators.wide_metrics import Wide


@pytest.mark.parametrize("digits", [0, 1, 9])
def test_wide_equals_long(spark, digits):
    """Few values tie many rows, also over the bounds; buckets of 20 rows make cells of pairs."""
    rng = np.random.default_rng(digits)
    rows = [(i, "abc"[min(i % 5, 2)], *(round(float(v), digits) for v in rng.normal(size=3)), float(i % 5 > 1)) for i in range(900)]
    wide = spark.createDataFrame(rows, "id long, grp string, truth double, model double, other double, flat double").repartition(4)
    names = ["model", "other", "flat"]
    got = {r.name: r.asDict() for r in E._with_lift(Wide(wide, names, 20).metrics(0.25)).collect()}
    long = wide.unpivot(["id", "grp", "truth"], names, "name", "pred")
    want = {r["name"]: r.asDict() for r in E.all_metrics(long, ["name"]).collect()}
    assert set(got) == set(want) and list(got["model"]) == list(want["model"])
    for name in names:
        for c, v in want[name].items():
            assert v == got[name][c] if isinstance(v, str) else np.isclose(v, got[name][c], rtol=1e-9, atol=1e-12, equal_nan=True), (name, c)


def test_many_groups_are_left_to_the_long_table(spark):
    df = spark.range(300).selectExpr("id", "concat('g', id % 150) as grp", "cast(id as double) as truth", "cast(id % 7 as double) as model")
    assert not Wide(df, ["model"]).fits


def test_inversions():
    rng = np.random.default_rng(3)
    part = np.sort(rng.integers(0, 4, 200))
    order = rng.integers(0, 30, 200).astype(float)
    want = [sum(order[i] > order[j] for j in range(200) for i in range(j) if part[i] == part[j] == p) for p in range(4)]
    assert M._inversions(order, part, 4).tolist() == want
    assert M._inversions(np.zeros(0), np.zeros(0, np.int64), 1).tolist() == [0]
