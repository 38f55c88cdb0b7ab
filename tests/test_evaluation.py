"""Rollout features with one exchange, probe joins with hot tokens, evaluation against direct computation, and reports."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from granary.operators import evaluation as E, labels as L, reports as P, rollouts as R, signal as S
from pyspark.sql import functions as F


def rollouts(spark, n=1500):
    rng = random.Random(2)
    some = lambda x: None if rng.random() < 0.1 else x
    rows = [
        (rng.choice(["hot"] * 5 + ["a", "b", None]), some(f"g{rng.randrange(12)}"), some(float(rng.random() < 0.4)), float(rng.randrange(1, 9)), some(-rng.random()), some(rng.random()), some(rng.random()), f"h{rng.randrange(90)}", i)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "key string, group_id string, reward double, completion_tokens double, mean_logprob double, early_logprob double, late_logprob double, comp_hash string, mean_entropy long").repartition(4)


def near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


def test_keys_in_tasks_and_in_parts_agree(spark):
    df = rollouts(spark)
    whole, split = ({r.key: r.asDict() for r in R.summarize_rollouts(df, ["key"], advantages=True, large=n).collect()} for n in (10_000, 400))
    assert set(whole) == set(split) == {"hot", "a", "b", None}
    for k in whole:
        assert list(whole[k]) == list(split[k]) and all(near(whole[k][c], split[k][c]) for c in whole[k]), k
    few = R.summarize_rollouts(df, ["key"], only=("pass_rate", "n_groups", "distinct_frac"))
    assert few.columns == ["key", "pass_rate", "distinct_frac", "n_groups"]


def test_features_of_rollouts_take_one_exchange(spark):
    plan = R.summarize_rollouts(rollouts(spark), ["key"], advantages=True)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "BroadcastExchange" not in plan and "BatchEvalPython" not in plan


def test_engineered_features(spark):
    rng = random.Random(3)
    rows = [(f"k{i % 2}", i, [rng.randrange(4) for _ in range(rng.randrange(1, 9))], None) for i in range(40)] + [("k0", 90, [], []), ("k1", 91, [1, 1], [-0.5, -0.5])]
    rows = [(k, i, t, lp if lp is not None else [-rng.random() for _ in t]) for k, i, t, lp in rows]
    got = {r.k: r for r in R.engineered_features(spark.createDataFrame(rows, "k string, id long, ids array<int>, lp array<double>"), ["k"], "id", "ids", "lp", long=4).collect()}
    for k in ("k0", "k1"):
        own = [r for r in rows if r[0] == k]
        lp = [x for r in own for x in r[3]]
        rep = [max(Counter(r[2]).values()) / len(r[2]) for r in own if r[2]]
        want = (np.std(lp), min(lp), math.exp(-np.mean(lp)), np.mean(rep), np.mean([len(r[2]) > 4 for r in own]), len({tuple(r[2]) for r in own}) / len(own))
        assert np.allclose([got[k].tok_std, got[k].tok_min, got[k].perplexity, got[k].max_tok_rep, got[k].frac_long, got[k].distinct_frac], want)


def test_probe_join_spreads_hot_tokens(spark):
    """Every bag holds `the`: beyond the broadcast its rows are dealt over parts."""
    rows = [(b, t, p) for b in range(300) for t, p in (("the", 0.5), (f"w{b % 40}", 0.3), (f"own{b}", 0.2))]
    bags = spark.createDataFrame(rows, "bag long, token string, p double").repartition(4)
    probe = spark.createDataFrame([("the", 0.1)] + [(f"w{i}", 0.02) for i in range(30)], "token string, p double")
    a, b = (sorted(map(tuple, R.cosine_to_probe(bags, probe, ["bag"], limit=n).collect())) for n in (1000, 0))
    assert len(a) == 300 and np.allclose(a, b)
    joined = R.with_probe(bags, probe, 0)
    assert joined.count() == 900 and joined.filter("q is not null").count() == 300 + sum(b % 40 < 30 for b in range(300))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def matrix(spark, chains=3, n=240):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3))
    x[rng.random(x.shape) < 0.1] = np.nan
    y = np.nan_to_num(x) @ [0.8, -0.3, 0.0] + 0.5 * rng.normal(size=n)
    rows = [(i, f"c{i % chains}", f"c{i % chains}::{i % 7}", *(None if np.isnan(v) else float(v) for v in x[i]), 1.0, float(y[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "row_id long, chain_id string, anchor string, pass_rate double, reward_mean double, extra double, flat double, y double").repartition(3)


def direct(x, y, q):
    m = np.nan_to_num(np.nanmean(x, axis=0))
    z = np.where(np.isnan(x), m, x)
    mu, sd = z.mean(0), np.where(z.std(0) > 1e-9, z.std(0), 1)
    a = (z - mu) / sd
    w = np.linalg.solve(a.T @ a + np.eye(x.shape[1]), a.T @ (y - y.mean()))
    return y.mean() + ((np.where(np.isnan(q), m, q) - mu) / sd) @ w


def spearman(p, y):
    return np.corrcoef(np.argsort(np.argsort(p, kind="stable")), np.argsort(np.argsort(y, kind="stable")))[0, 1]


@pytest.mark.parametrize("chains,scheme", [(3, "logo"), (1, "logo"), (3, "loocv")])
def test_evaluate(spark, chains, scheme):
    n = 120
    x, y, df = matrix(spark, chains, n)
    features = ["pass_rate", "reward_mean", "extra", "flat"]
    out = {r["name"]: r for r in E.evaluate(df, features, scheme, "y", alpha=0.2).collect()}
    used = "logo" if scheme == "logo" and chains > 1 else "loocv"
    fold = np.arange(n) % chains if used == "logo" else np.arange(n)
    x4 = np.column_stack([x, np.ones(n)])
    anchor = np.array([f"{i % chains}::{i % 7}" for i in range(n)])

    def oof(columns):
        p = np.empty(n)
        for f in np.unique(fold):
            p[fold == f] = direct(x4[fold != f][:, columns], y[fold != f], x4[fold == f][:, columns])
        return p

    def within(p):
        return np.mean([spearman(p[anchor == a], y[anchor == a]) for a in np.unique(anchor)])

    for name, columns in (("model", [0, 1, 2, 3]), ("difficulty_only", [0]), ("reward_only", [1])):
        p, r = oof(columns), out[name]
        assert (r.scheme, r.label, r.n, r.n_features) == (used, "y", n, 4)
        assert np.isclose(r.rmse, np.sqrt(np.mean((p - y) ** 2))) and np.isclose(r.pearson, np.corrcoef(p, y)[0, 1]) and np.isclose(r.spearman, spearman(p, y))
        assert np.isclose(r.within_anchor_spearman, within(p)) and np.isclose(r.sign_accuracy, np.mean(np.sign(p) == np.sign(y)))
        pairs = [(p[i] - p[j]) * (y[i] - y[j]) > 0 for i in range(n) for j in range(i) if anchor[i] == anchor[j]]
        assert np.isclose(r.pairwise_ranking_accuracy, np.mean(pairs))
    assert set(out) == {"model", "predict_mean", "difficulty_only", "reward_only"}  # no redundancy, no gradient here
    m, res = out["model"], np.sort(np.abs(oof([0, 1, 2, 3]) - y))
    assert np.isclose(m.q, res[min(n, math.ceil((n + 1) * 0.8)) - 1])
    singles = [within(np.round(oof([i]), 9)) for i in range(3)]
    assert m.best_single_feature == features[int(np.argmax(singles))] and np.isclose(m.best_single_spearman, max(singles), atol=1e-8)
    assert m.beats_difficulty == (round(m.within_anchor_spearman, 9) >= round(out["difficulty_only"].within_anchor_spearman, 9)) and m.beats_best_single_feature == (m.within_anchor_spearman >= max(singles))
    assert out["difficulty_only"].beats_difficulty is None


def test_evaluate_refuses(spark):
    _, _, df = matrix(spark, 3, 30)
    with pytest.raises(ValueError):
        E.evaluate(df.limit(2), ["pass_rate"])
    with pytest.raises(ValueError):
        E.evaluate(df, ["pass_rate"], "kfold")


def test_feature_screen(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2] if i < 60 else "few", float(rng.normal()), float(rng.normal()) if i % 5 else None, float(i)) for i in range(64)]
    got = {(r.feature, r.domain): r for r in S.feature_screen(spark.createDataFrame(rows, "id long, domain string, u double, v double, y double"), ["u", "v"], "y", "domain").collect()}
    assert {d for f, d in got if f == "u"} == {"a", "b", "POOLED", "AVERAGE"}  # four rows are too few
    for f, at in (("u", 2), ("v", 3)):
        for d in ("a", "b", "POOLED"):
            own = [r for r in rows if r[at] is not None and d in (r[1], "POOLED")]
            assert got[f, d].n == len(own) and np.isclose(got[f, d].spearman, spearman(np.array([r[at] for r in own]), np.array([r[4] for r in own])))
        assert np.isclose(got[f, "AVERAGE"].spearman, (got[f, "a"].spearman + got[f, "b"].spearman) / 2)
    first = max("uv", key=lambda f: abs(got[f, "AVERAGE"].spearman))
    assert {got[first, d].place for d in ("a", "AVERAGE")} == {1}


def test_dose_response(spark):
    rows = [(i, None if i % 2 else (i % 4) / 4, f"labelnoise-{25 * (i % 4):03d}-{i:03d}", 1.0 - 0.2 * (i % 4) + 0.01 * (i % 3), None if i % 5 == 0 else 1.0) for i in range(48)] + [(99, None, "random-001", 9.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, frac double, name string, lift double, reward double").withColumn("dose", S.dose_of(F.col("frac"), F.col("name")))
    got = S.dose_response(df, "dose", "lift", ["reward"]).orderBy("dose").collect()
    assert [r.dose for r in got] == [0.0, 0.25, 0.5, 0.75] and [r.n for r in got] == [12] * 4 and {r.verdict for r in got} == {"confirmed"} and all(r.non_increasing and r.spearman < -0.9 for r in got)
    assert np.isclose(got[0].mean_reward, np.mean([0.0 if i % 5 == 0 else 1.0 for i in range(0, 48, 4)]))


def test_climb(spark):
    log = [("online", 0, s, 2.0 - 0.1 * s, (0.5, None, None, 0.7)[s], 0.1, 32) for s in range(4)] + [("random", 0, s, 2.0 - 0.05 * s, 0.5 if s == 0 else None, None, 32) for s in (0, 1, 3)] + [("other", 0, 0, 1.0, None, None, 1)]
    df = spark.createDataFrame(log, "arm string, seed long, step long, nll double, acc double, predicted_lift double, gens long").repartition(3)
    for block in (2, 1000):
        got = {r.step: r for r in P.climb_comparison(df, block=block).collect()}
        assert got[2].acc_online == 0.5 and got[3].acc_online == 0.7 and got[3].acc_random == 0.5 and got[3].gens_online == 128 and got[3].gens_random == 96
        assert np.isclose(got[1].realized_lift_online, 0.1) and got[0].realized_lift_online is None and got[1].predicted_lift_random is None
        assert [got[s].in_order for s in range(4)] == [True, True, True, False] and np.isclose(got[1].nll_gap, 0.05) and got[2].n_random == 0


def test_step_summary_equals_the_flattened_table(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(rng.choice("ab"), i // 2, rng.random()) for i in range(300)], "k string, i long, x double").repartition(3)
    snaps = spark.createDataFrame([(k, t, rng.random(), 0.5 + rng.random()) for k in "abc" for t in range(0, 160, 7)], "k string, t long, mu double, sd double")
    flat = P.rows_by_step(rows, snaps, ["k"], "i", "x").groupBy("k", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("z_sum"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    want = sorted(map(tuple, flat.collect()))
    for block in (40, 10_000):
        got = sorted(map(tuple, P.step_summary(rows, snaps, ["k"], "i", "x", block).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3:] for g in got], [w[3:] for w in want])


def test_backfill_keeps_stored_features_of_unmatched_labels(spark):
    labels = spark.createDataFrame(
        [("d", "c1", 0, 0.5, 0.1, (0.9, 7)), ("d", "c2", 0, 0.5, 0.2, (0.8, None)), ("d", "c3", 0, 0.5, None, (0.7, 1))],
        "domain string, candidate_id string, seed int, nll_before double, lift_nll double, reward_summary struct<pass_rate: double, n_groups: long>",
    )
    runs = spark.createDataFrame([("d", "c1", "g", 1.0), ("d", "c1", "g", 0.0)], "domain string, candidate_id string, group_id string, reward double")
    got = {r.candidate_id: r for r in L.backfill_features(labels, runs, ["domain", "candidate_id"]).collect()}
    assert set(got) == {"c1", "c2"} and list(got["c1"].asDict())[:14] == L.ENRICHED
    assert got["c1"].matched and got["c1"].features.pass_rate == 0.5 and got["c1"].features.n_groups == 1
    assert not got["c2"].matched and got["c2"].features.pass_rate == 0.8 and got["c2"].features.reward_mean is None and got["c2"].cohort is None


def test_statistics_shuffle_rows_of_rare_keys(spark):
    """Keys with few rows, with many, and null: the sums of a direct pass, in one exchange by key and without a call for each."""
    import numpy as np
    from granary.operators import fits as G
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 else None if i % 5 == 0 else f"k{i // 6}", None if i % 7 == 0 else float(rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double").withColumn("_x", F.array("a", "b")).repartition(3)
    found = G.statistics(df, ["k"], 2, "y")
    plan = found._jdf.queryExecution().toString()
    assert plan.count("MapInPandas") and "FlatMapGroupsInPandas" not in plan
    got = {r.k: np.array(r.g) for r in found.collect()}
    assert set(got) == {r[0] for r in rows}
    for k, g in got.items():
        own = np.array([r[1:] for r in rows if r[0] == k], dtype=float)
        assert np.allclose(g, G.sums(own[:, :2], own[:, 2]))


def test_nearly_equal_features_are_flat(spark):
    """Two rows whose feature differs by less than the root of `flat`: no weight, and the mean as the next row's prediction."""
    from granary.operators import fits as G

    df = spark.createDataFrame([("a", i, 1.0 + 2e-5 * (i % 2) if i < 4 else 3.0, float(i)) for i in range(5)], "k string, i long, x double, y double")
    w = {r.t: r.w[0] for r in G.snapshots(df, ["k"], ["i"], ["x"], "y", flat=1e-9).collect()}
    assert [w[t] for t in range(1, 5)] == [0.0] * 4 and w[5] > 0.1
    pred = {r.i: r.pred for r in G.prequential(df, ["k"], ["i"], ["x"], "y", warm=2, flat=1e-9).collect()}
    assert abs(pred[4] - 1.5) < 1e-12
    assert abs({r.t: r.w[0] for r in G.snapshots(df, ["k"], ["i"], ["x"], "y").collect()}[2]) > 0.01


def test_few_shot_by_products_equals_the_join(spark):
    """Held by all tasks or joined by domain: the same predictions, of rows that the fit did not use; ids may repeat across domains."""
    from granary.operators import fits as G

    rows = [(d, i, None if i % 6 == 0 else float(i * 7 % 11), float(i * 5 % 13), float(i * 3 % 7) + (d == "b")) for d in "abc" for i in range(20)]
    df = spark.createDataFrame(rows, "d string, i long, u double, v double, y double").repartition(3)
    few = lambda n: G.few_shot(df, "d", "i", [0, 3], 2, ["u", "v"], "y", 1, keep=["d", "i", "y"], few=n)
    held = few(1000)
    assert "MapInPandas" in held._jdf.queryExecution().toString() and "SortMergeJoin" not in held._jdf.queryExecution().toString()
    one, other = ({(r.d, r.i, r.k, r.rep): r.pred for r in x.collect()} for x in (held, few(0)))
    assert len(one) == 3 * 2 * (20 + 17) and set(one) == set(other) and max(abs(one[k] - other[k]) for k in one) < 1e-9


def test_ladder_and_sweep_shuffle_once(spark, monkeypatch):
    """Ranks by fold and of all rows come from one call, and the sweep writes its labels once for all configurations."""
    from granary.operators import evaluation as E

    rows = spark.range(300).selectExpr("id as row_id", "concat('d', id % 3) as domain", "concat('c', id % 60) as candidate_id", "cast(id % 7 as double) as a", "cast(id * 37 % 101 as double) as lift_nll", "cast(null as double) as target_similarity")
    calls = []
    plain = E.M.spearman
    monkeypatch.setattr(E.M, "spearman", lambda *a, **k: calls.append(a) or plain(*a, **k))
    pred = rows.selectExpr("row_id", "domain", "a as pred", "lift_nll as y")
    got = {r.domain: (r.n, r.spearman) for r in E.spearman_with_overall(pred, "domain").collect()}
    assert not calls and set(got) == {"d0", "d1", "d2", "ALL"} and got["ALL"][0] == 300
    want = plain(pred.selectExpr("row_id as id", "pred", "y as truth"), []).first()
    assert abs(got["ALL"][1] - want.spearman) < 1e-12
    names = []
    write = E.stored
    monkeypatch.setattr(E, "stored", lambda df, name: names.append(name) or write(df, name))
    E.feature_sweep(rows, {"one": (["a"], False, None), "two": (["a"], False, "domain")})
    assert names.count("sweep-labels") == 1
