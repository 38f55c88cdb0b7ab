"""Edges of the core operators that the tables of the comparisons do not reach."""

import itertools

import numpy as np
import pytest
from granary.functions.exprs import clean, strip
from granary.operators import fits as G, items as I, labels as L, metrics as M, rollouts as R, signal as S
from granary.streaming import jobs as J
from pyspark.sql import functions as F


def values(df, column):
    return df.select(column.alias("v")).first()[0]


def test_clean_and_strip(spark):
    one = spark.range(1)
    assert [values(one, clean(F.lit(x))) for x in (3, 2.5, True, float("nan"), float("-inf"))] == [3.0, 2.5, 1.0, None, None]
    assert [values(one, clean(F.lit(x))) for x in ("3", "abc", None)] == [None, None, None]
    assert values(one, strip(F.lit("\u3000\t q x\n\u00a0"))) == "q x"
    assert values(one, I.normalize_answer(F.lit("\n\\boxed{ 1\u2003/ 2 }. "))) == "1/2"


@pytest.mark.parametrize(
    "text,want",
    [("[\"it's\", 'x']", ["it's", "x"]), ("['a, b', 'c']", ["a, b", "c"]), ("['it\\\\'s',]", ["it's"]), (" [] ", []), ("['a' 'b']", None), ("['a', b]", None), ("no list", None), ("[\"a\", 'say \"b\"']", ["a", 'say "b"'])],
)
def test_parse_choices(spark, text, want):
    df = spark.createDataFrame([(text.replace("\\\\", "\\"),)], "t string")
    assert df.select(I.parse_choices("t")).first()[0] == want


def test_reward_summary_of_nested_numbers(spark):
    df = spark.createDataFrame([("a", (1.0,), "7"), ("a", (0.0,), "x"), ("b", None, None)], "k string, reward struct<reward: double>, score string")
    assert {r.k: (r.n_rows, r.mean_reward, r.mean_tokens) for r in R.reward_summary(df, ["k"]).collect()} == {"a": (2, 0.5, None), "b": (1, None, None)}


def test_first_three_seeds_by_order(spark):
    rng = np.random.default_rng(0)
    rows = [("d", f"c{c}", seed, float(v)) for c in range(12) for seed, v in zip((30, 10, 20, 40), rng.normal(size=4))]
    own = S.seed_pairs(spark.createDataFrame(rows, "domain string, unit string, seed int, v double"), ["domain"], "unit", "v").first()
    same = S.seed_pairs(spark.createDataFrame([(d, u, s // 10 - 1, v) for d, u, s, v in rows], "domain string, unit string, seed int, v double"), ["domain"], "unit", "v").first()
    assert own.n == 12 and own.r1 == pytest.approx(same.r1) and own.r1 != 0


@pytest.mark.parametrize("bucket", [4, 1 << 16])
def test_concordance_counts_all_pairs(spark, bucket):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], float(rng.integers(0, 6)), float(rng.integers(0, 5))) for i in range(90)] + [(200, "c", 1.0, 1.0), (201, "d", 1.0, 2.0), (202, "d", 1.0, 2.0)]
    want = {}
    for g in "abcd":
        own = [r for r in rows if r[1] == g]
        pairs = list(itertools.combinations(own, 2))
        d = [(a[2] - b[2]) * (a[3] - b[3]) for a, b in pairs]
        untied = sum(a[3] != b[3] for a, b in pairs)
        right = sum(x > 0 for x in d)
        want[g] = (right, untied - right, sum(x < 0 for x in d), untied, len(pairs))
    df = spark.createDataFrame(rows, "id long, grp string, pred double, truth double").repartition(3)
    got = {r.grp: (r.right, r.wrong, r.discordant, r.pairs, r.all_pairs) for r in M.concordance(df, ["grp"], bucket=bucket).collect()}
    assert got == want


def ridge(x, y, lam=1.0):
    mean = np.nan_to_num(np.nanmean(x, axis=0))
    z = np.where(np.isnan(x), mean, x)
    mu, sd = z.mean(0), z.std(0)
    sd = np.where(sd > 1e-9, sd, 1)
    a = (z - mu) / sd
    w = np.linalg.solve(a.T @ a + lam * np.eye(x.shape[1]), a.T @ (y - y.mean()))
    return (lambda q: y.mean() + (np.where(np.isnan(q), mean, q) - mu) / sd @ w)


def table(spark, n=60, shift=1e6):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 3)) + [shift, 0, -5]
    x[rng.random(x.shape) < 0.15] = np.nan
    y = np.nan_to_num(x - [shift, 0, -5]) @ [1.0, -2.0, 0.5] + 0.1 * rng.normal(size=n)
    rows = [(i, "abc"[i % 3], *(None if np.isnan(v) else float(v) for v in x[i]), float(y[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "id long, dom string, a double, b double, c double, y double").repartition(4)


def test_leave_one_out_few_shots_and_prefixes(spark):
    x, y, df = table(spark)
    names = ["a", "b", "c"]
    got = {r.id: r.pred for r in G.loocv(df, "id", names, "y").collect()}
    for i in (0, 7, 59):
        keep = np.arange(60) != i
        assert got[i] == pytest.approx(ridge(x[keep], y[keep])(x[i : i + 1])[0], rel=1e-6)
    shots = G.few_shot(df, "dom", "id", [0, 4], 2, names, "y").collect()
    assert len(shots) == 2 * (60 + 60 - 12)
    zero = {r.id: r.pred for r in shots if r.k == 0}
    for i in (0, 1, 2):
        keep = np.arange(60) % 3 != i % 3
        assert zero[i] == pytest.approx(ridge(x[keep], y[keep])(x[i : i + 1])[0], rel=1e-6)
    assert all(len({r.id for r in shots if (r.dom, r.k, r.rep) == (d, 4, p)}) == 16 for d in "abc" for p in (0, 1))
    snaps = {(r.dom, r.t): r for r in G.snapshots(df, ["dom"], ["id"], names, "y").collect()}
    assert len(snaps) == 60
    own = np.arange(0, 60, 3)[:9]
    fit = ridge(x[own], y[own])
    assert snaps["a", 9].train_rmse == pytest.approx(np.sqrt(((fit(x[own]) - y[own]) ** 2).mean()), rel=1e-6)
    within = {r.id: r.pred for r in G.oof_predict(df.withColumn("fold", F.concat("dom", (F.col("id") % 2).cast("string"))), "fold", names, "y", within="dom").collect()}
    keep = [i for i in range(60) if i % 3 == 0 and i % 2 == 1]
    assert within[0] == pytest.approx(ridge(x[keep], y[keep])(x[:1])[0], rel=1e-6)


def test_outcomes_are_no_features(spark):
    df = spark.createDataFrame([(1, 0.1, (0.5,))], "id long, lift_nll double, reward_summary struct<pass_rate: double>")
    assert df.select(*(c.alias(k) for k, c in L.feature_columns(df, ["pass_rate", "adv_std"]).items())).first() == (0.5, None)
    with pytest.raises(ValueError):
        L.feature_columns(df, ["pass_rate", "lift_nll"])


def test_prefix_fits_of_one_long_key(spark):
    """Ranges of a key in many tasks give what one task gives."""
    rng = np.random.default_rng(8)
    rows = [(("a", "b")[i % 17 == 0], i, None if rng.random() < 0.1 else float(rng.normal() + 1e4), float(rng.normal()), float(rng.normal())) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long, a double, b double, y double").repartition(5)
    for run in (lambda block: G.snapshots(df, ["k"], ["id"], ["a", "b"], "y", block=block).select("k", "t", "base", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"), "train_rmse"), lambda block: G.prequential(df, ["k"], ["id"], ["a", "b"], "y", fallback="b", block=block).select("k", F.col("id").alias("t"), "pred")):
        one, many = (sorted(map(tuple, run(block).collect())) for block in (100_000, 250))
        assert len(one) == 3000 and [r[:2] for r in one] == [r[:2] for r in many]
        assert np.allclose([r[2:] for r in one], [r[2:] for r in many], rtol=1e-7, atol=1e-9)


def test_online_predictor_equals_refits(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 2)) * [1, 1e-3] + [0, 1e3]
    y = x @ [1.0, 500.0] + rng.normal(size=400)
    schema = "k string, i long, a double, b double, y double"
    for at in range(0, 400, 100):
        spark.createDataFrame([("k", i, float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(at, at + 100)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    J.run_available(J.online_predictor(stream, "k", "i", ["a", "b"], "y"), str(tmp_path / "log"), str(tmp_path / "out"))
    got = {r.i: r.pred for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 400 and [got[i] for i in range(4)] == [x[i, 0] for i in range(4)]
    for i in (4, 5, 99, 100, 101, 399):
        assert got[i] == pytest.approx(ridge(x[:i], y[:i])(x[i : i + 1])[0], rel=1e-9)


def test_axes_and_field(spark):
    rng = np.random.default_rng(2)
    w = rng.normal(size=(40, 4)) * [3, 2, 1, 0.1] + 100
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "id long, w array<double>")
    axes = G.principal_axes(df, "w", 3)
    values_, vectors = np.linalg.eigh(np.cov(w.T))
    rows = axes.orderBy("component").collect()
    assert [r.explained for r in rows] == pytest.approx((values_[::-1] / values_.sum())[:3].tolist())
    assert abs(np.dot(rows[0].loadings, vectors[:, -1])) == pytest.approx(1)
    points = np.array([r.point for r in G.projections(df, "w", axes).orderBy("id").collect()])
    assert points == pytest.approx((w - w.mean(0)) @ np.array([r.loadings for r in rows]).T)
    _, _, data = table(spark, shift=0.0)
    stats = G.statistics(G.centred(data, ["a", "b", "c"])[0], [], 3, "y")
    field = G.gradient_field(stats, spark.createDataFrame([(i, v[:3].tolist()) for i, v in enumerate(w - 100)], "id long, w array<double>"), 3).collect()
    assert len(field) == 75 and all(r.norm == pytest.approx(np.linalg.norm(r.descent)) for r in field)


def test_interval(spark):
    df = spark.createDataFrame([(1, 0.5), (2, -0.1), (3, -0.9)], "id long, pred double")
    assert [(r.low, r.high, r.below_resolution) for r in G.predict_interval(df, 0.25).orderBy("id").collect()] == [(0.25, 0.75, False), (-0.35, 0.15, True), (-1.15, -0.65, False)]


def test_kept_state_goes_on_after_a_restart(spark, tmp_path):
    path = str(tmp_path / "state")
    merge = lambda old, batch: batch if old is None else old.unionByName(batch)
    each = J.keep_state(path, merge)
    each(spark.range(3), 0)
    each(spark.range(3, 5), 1)
    J.keep_state(path, merge)(spark.range(3, 5), 1)  # the last batch again, by a new driver
    J.keep_state(path, merge)(spark.range(5, 6), 2)
    assert sorted(r.id for r in J.latest_state(spark, path).collect()) == [0, 1, 2, 3, 4, 5]


def test_best_pod_of_a_tick(spark):
    rows = [("d", 1, "b", "ACTIVE", 3), ("d", 1, "a", "ACTIVE", 3), ("d", 1, "c", "TERMINATED", 9), ("d", 2, "c", "ACTIVE", 9), ("e", 1, "a", "PROVISIONING", 7), ("e", 1, "b", "ACTIVE", None), ("f", 1, "a", "ERROR", 5)]
    df = spark.createDataFrame(rows, "domain string, tick int, pod string, state string, labels long")
    got = {(r.domain, r.tick): (r.pod, r.n, r.alive, r.active) for r in J.best_of_tick(df, ["domain", "tick"], "pod", "state", "labels").collect()}
    assert got["d", 1] == ("a", 3, True, True) and got["d", 2] == ("c", 9, True, True)
    assert got["e", 1] == ("a", 0, True, False) and got["f", 1] == ("a", -1, False, False)


def test_choice_index_is_read_by_its_form(spark):
    """A choice that reads like an index or a letter of another is not mistaken for it."""
    at = lambda choices, gold, form: values(spark.range(1), I.choice_index(F.array(*map(F.lit, choices)), F.lit(gold), form))
    assert at(["1", "0"], 0, "index") == 0 and at(["1", "0"], "1", "index") == 1 and at(["1", "0"], "0", "text") == 1
    assert at(["B", "A"], "A", "letter") == 0 and at(["B", "A"], " b ", "letter") == 1 and at(["B", "A"], "A", "text") == 1
    assert at(["x", "y ", "y"], " y", "text") == 1
    assert [at(["x", "y"], g, f) for g, f in ((2, "index"), (-1, "index"), ("C", "letter"), ("AB", "letter"), ("", "letter"), ("z", "text"), (None, "index"))] == [None] * 7
    with pytest.raises(ValueError):
        I.choice_index(F.array(F.lit("x")), F.lit(0), "guess")
