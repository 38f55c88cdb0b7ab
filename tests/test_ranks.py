import math

import numpy as np
import pytest
from granary.functions.exprs import row_numbers
from granary.operators import metrics as M


def rows_with_ties():
    rng = np.random.default_rng(3)
    value = lambda: [None, float("nan"), 0.0, 0.0, float(rng.integers(-3, 3)), float(rng.normal())][rng.integers(0, 6)]
    return [([None, "a", "a", "a", "b"][rng.integers(0, 5)], i, f"t{i:04d}", value()) for i in range(600)] + [("c", 600, "t0600", 1.0)]


@pytest.mark.parametrize("tie", ["id", "name"])
@pytest.mark.parametrize("down", [False, True])
def test_split_row_numbers(spark, tie, down):
    rows = rows_with_ties()
    df = spark.createDataFrame(rows, "g string, id long, name string, x double")
    order = lambda r: ((0, 0.0) if r[3] is None else (2, 0.0) if math.isnan(r[3]) else (1, r[3]), r[1])
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=order, reverse=down), 1):
            want[r[1]] = n
    for large in (40, 10_000):
        got = row_numbers(df, ["g"], {"n": ("x", down)}, tie, large)
        assert {r.id: r.n for r in got.collect()} == want and got.columns == [*df.columns, "n"]
    whole = sorted(rows, key=order, reverse=down)
    got = {r.id: r.n for r in row_numbers(df, [], {"n": ("x", down)}, tie, 40).collect()}
    assert got == {r[1]: n for n, r in enumerate(whole, 1)}
    assert row_numbers(df.limit(0), [], {"n": ("x", down)}, tie, 40).count() == 0


@pytest.mark.parametrize("ties", ["order", "average"])
def test_split_ranks(spark, ties):
    df = spark.createDataFrame([r for r in rows_with_ties() if r[3] is None or not math.isnan(r[3])], "g string, id long, name string, x double")
    one, many = ({r.id: r.rk_x for r in M.ranked(df, ["g"], ["x"], "id", ties, large).collect()} for large in (10_000, 40))
    assert one == many
    if ties == "average":
        frame = df.filter("x is not null and g = 'a'").toPandas()
        want = dict(zip(frame["id"], frame["x"].rank() - 1))
        # nulls come before all values
        base = df.filter("x is null and g = 'a'").count()
        assert all(one[i] == w + base for i, w in want.items())


def test_top_picks_of_a_large_group(spark):
    df = spark.createDataFrame([("a", i, float(i % 7), float(i)) for i in range(300)] + [("b", 1, 1.0, 2.0)], "g string, id long, pred double, truth double")
    few, many = (sorted((r.g, r.id) for r in M.top_picks(df, ["g"], 0.1, large=large).collect()) for large in (10_000, 50))
    assert few == many and len(few) == 31


def test_top_k_capture_of_a_large_group(spark):
    from granary.operators.signal import topk_capture

    df = spark.createDataFrame([("ab"[i % 2], i, float(i * 7 % 31), float(i * 11 % 53)) for i in range(300)], "g string, id long, pred double, truth double")
    whole, split = (sorted(map(tuple, topk_capture(df, ["g"], [0.1, 0.3], large).collect())) for large in (10_000, 50))
    assert len(whole) == 4 and all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:]) for a, b in zip(whole, split))


@pytest.mark.parametrize("group", [[], ["g"]])
def test_pairs_of_a_group_beyond_one_range(spark, group):
    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2], i, float(rng.integers(0, 40)), float(rng.integers(0, 60))) for i in range(240)]
    df = spark.createDataFrame(rows, "g string, id long, pred double, truth double")
    for r in M.concordance(df, group, bucket=20, block=40).collect():
        own = [x for x in rows if not group or x[0] == r.g]
        signs = [(a[2] - b[2]) * (a[3] - b[3]) for i, a in enumerate(own) for b in own[:i]]
        untied = sum(a[3] != b[3] for i, a in enumerate(own) for b in own[:i])
        assert (r.right, r.discordant, r.pairs, r.all_pairs) == (sum(s > 0 for s in signs), sum(s < 0 for s in signs), untied, len(signs))


def test_partial_correlation_writes_only_what_it_ranks(spark, monkeypatch):
    from granary.functions import exprs
    from granary.operators.signal import partial_rank_correlation

    df = spark.createDataFrame([("ab"[i % 2], i, float(i * 7 % 31), float(i * 11 % 53), float(i * 5 % 43), "wide") for i in range(300)], "g string, id long, x double, y double, z double, other string")
    seen = []
    stored = exprs.stored
    monkeypatch.setattr(exprs, "stored", lambda d, name: seen.append(d.columns) or stored(d, name))
    whole, split = ({r.g: r.partial for r in partial_rank_correlation(df, ["g"], "x", "y", "z", large=large).collect()} for large in (10_000, 50))
    assert seen and not any("other" in c for c in seen) and whole == pytest.approx(split)
