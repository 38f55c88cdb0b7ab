import numpy as np
import pytest
from granary.operators import cohorts as C, fits as G, items as I, labels as L, rollouts as R
from granary.sources import records
from granary.sources.scratch import scratch
from granary.streaming import jobs as J
from pyspark.sql import functions as F


def test_rollout_summary(spark):
    rows = [("k", "g1", 1.0)] * 4 + [("k", "g2", r) for r in (1.0, 0.0, 1.0, 0.0)] + [("e", None, None)]
    out = {r.key: r for r in R.summarize_rollouts(spark.createDataFrame(rows, "key string, group_id string, reward double"), ["key"]).collect()}
    k = out["k"]
    assert (k.n_groups, k.frac_nondegenerate, k.frac_all_correct, k.frac_all_wrong) == (2, 0.5, 0.5, 0.0)
    e = out["e"]
    assert (e.n_rollouts, e.n_groups, e.reward_mean, e.reward_std, e.pass_rate, e.mean_logprob, e.frac_nondegenerate) == (1, 0, 0.0, 0.0, 0.0, None, None)


def test_advantages(spark):
    rows = [(1, 1.0), (1, 0.0), (2, 1.0), (2, 1.0), (None, 0.5)]
    out = R.group_advantages(spark.createDataFrame(rows, "g int, reward double"), ["g"])
    assert sorted(round(r.advantage, 5) for r in out.collect()) == [-1.0, 0.0, 0.0, 0.0, 1.0]


@pytest.mark.parametrize("rule,late", [("zero", 0.0), ("last", -2.0), ("four", None)])
def test_single_token(spark, rule, late):
    row = spark.createDataFrame([([-2.0],)], "lp array<double>").select(*(c.alias(n) for n, c in R.token_stats("lp", rule).items())).first()
    assert row.late_logprob == late and row.min_logprob == -2.0


BOXES = [("\\boxed{\\frac{2}{3}}", "\\frac{2}{3}"), ("a \\boxed{1} b \\boxed{ 2 }", " 2 "), ("\\boxed{open", ""), ("none", ""), ("\\boxed{}", ""), (None, None)]


def test_boxed_and_match(spark):
    df = spark.createDataFrame([(a, b) for a, b in BOXES], "t string, want string")
    assert all(r.got == r.want or r.want is None for r in df.select("want", I.boxed("t").alias("got")).collect())
    pairs = spark.createDataFrame([("\\boxed{ \\left( 1 \\right) }.", "(1)", True), ("", "", True), ("2", "3", False)], "p string, a string, want boolean")
    assert all(r.got == r.want for r in pairs.select("want", I.exact_match("p", "a").alias("got")).collect())


def test_split_is_disjoint_and_repeatable(spark):
    items = spark.range(140).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("id"))
    a = {r.id: r.split for r in I.split_train_probe(items, 128, 3, 140).collect()}
    b = {r.id: r.split for r in I.split_train_probe(items.repartition(7), 128, 3).collect()}
    assert a == b and sum(v == "probe" for v in a.values()) == 128
    with pytest.raises(ValueError):
        I.split_train_probe(items, 140, 3, 140)
    with pytest.raises(ValueError):
        I.assert_unique(items.unionByName(items.limit(1)), "id")


def test_cohorts(spark):
    pool = spark.range(400).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt_id"), F.element_at(F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95)), (F.col("id") % 3 + 1).cast("int")).alias("pass_rate"))
    noise = C.label_noise_cohorts(pool, [0.0, 0.25, 0.5, 1.0], 8, 3, 1)
    share = {r.name: r.s for r in noise.groupBy("name").agg(F.avg(F.col("is_noisy").cast("double")).alias("s")).collect()}
    assert len(share) == 12 and set(share.values()) == {0.0, 0.25, 0.5, 1.0}
    dup = C.duplication_cohorts(pool, [1, 4], 8, 2, 1).groupBy("name").agg(F.count_distinct("prompt_id").alias("k"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r.k, r.n) for r in dup) == [(1, 8), (1, 8), (4, 8), (4, 8)]
    # a pool of five prompts fills every cohort of one, two or four of them, and none of eight
    small = C.duplication_cohorts(pool.limit(5), [1, 2, 4, 8], 8, 2, 1).orderBy("name", "pos").collect()
    orders = {n: [r.prompt_id for r in small if r.name == n] for n in {r.name for r in small}}
    assert sorted(orders) == [f"dup-k{k:02}-{j:03}" for k in (1, 2, 4) for j in (0, 1)]
    assert all(o == o[:k] * (8 // k) and len(set(o)) == k for n, o in orders.items() for k in [int(n[5:7])])
    every = C.build_all(pool.withColumn("level", F.col("prompt_id").substr(2, 1)), 8, 1).select("ord", "name", "kind", "n_with_rate").distinct().orderBy("ord").collect()
    kinds = list(dict.fromkeys(r.kind for r in every))
    assert kinds == ["label_noise", "duplication", "passband", "variance_decoupled", "by_level", "random"] and [r.ord for r in every] == list(range(len(every)))
    assert [r.name for r in every if r.kind == "duplication"] == [f"dup-k{k:02}-{j:03}" for k in (1, 2, 4, 8) for j in (0, 1)] and all(r.n_with_rate == 8 for r in every)
    stats = {r.name: r for r in C.pass_stats(C.variance_decoupled(pool, 32, 1), pool).collect()}
    assert stats["vardecouple-highvar"].within_group_var_mean > stats["vardecouple-lowvar"].within_group_var_mean
    plan = C.candidate_schedule(pool.limit(20), 48, 16, 4, 1).groupBy("state", "candidate").agg(F.count_distinct("prompt_id").alias("k")).collect()
    assert len(plan) == 48 * 16 and {r.k for r in plan} == {4}
    with pytest.raises(ValueError):
        C.random_cohorts(pool, 100, 8)
    with pytest.raises(KeyError):
        C.cohort_rows(noise, pool.limit(3), strict=True)


def direct(x, y, lam=1.0):
    m = np.array([np.nanmean(c) if np.isfinite(c).any() else 0.0 for c in x.T])
    z = np.where(np.isfinite(x), x, m)
    mu, sd = z.mean(0), z.std(0)
    sd[sd < 1e-9] = 1
    w = np.linalg.solve(((z - mu) / sd).T @ ((z - mu) / sd) + lam * np.eye(x.shape[1]), ((z - mu) / sd).T @ (y - y.mean()))
    return lambda q: y.mean() + ((np.where(np.isfinite(q), q, m) - mu) / sd) @ w


def test_fold_subtraction_equals_refits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3))
    x[rng.random((90, 3)) < 0.2] = np.nan
    y = np.nan_to_num(x) @ [1.0, -2.0, 0.5] + rng.normal(size=90)
    fold = np.arange(90) % 5
    rows = [(i, int(fold[i]), *(float(v) for v in x[i]), float(y[i])) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, fold int, a double, b double, c double, y double")
    got = {r.id: r.pred for r in G.oof_predict(df, "fold", ["a", "b", "c"], "y").collect()}
    for f in range(5):
        model = direct(x[fold != f], y[fold != f])
        for i in np.flatnonzero(fold == f):
            assert got[i] == pytest.approx(model(x[i]), abs=1e-9)


def test_labels(spark):
    plan = spark.createDataFrame([(0, "x", 0), (0, "x", 1), (1, None, 0)], "a int, c string, s int")
    done = spark.createDataFrame([(0, "x", 0), (1, None, 0)], "a int, c string, s int")
    assert [tuple(r) for r in L.pending(plan, done, ["a", "c", "s"]).collect()] == [(0, "x", 1)]
    f = spark.createDataFrame([(1, None), (2, float("nan")), (3, 4.0)], "id int, x double")
    assert sorted(r.x for r in L.impute_mean(f, f, ["x"]).collect()) == [4.0, 4.0, 4.0]


def test_tolerant_reader(spark):
    path = scratch(spark, "tolerant")
    spark.createDataFrame([('{"a": 1}',), ("broken",), ("",)], "value string").write.text(path)
    good, bad = records.read_tolerant(spark, path, "a int")
    assert [r.a for r in good.collect()] == [1] and [r.line for r in bad.collect()] == ["broken"]
    assert records.read_records(spark, path + "-none", "a int", missing_ok=True).count() == 0


def test_stream_equals_batch(spark):
    path = scratch(spark, "stream")
    rows = spark.range(300).select((F.col("id") % 4).alias("k"), F.col("id").alias("i"), (F.col("id") * 7 % 11 / 11.0).alias("x"), (F.col("id") * 5 % 13 / 13.0).alias("z"), (F.col("id") * 3 % 17 / 17.0).alias("y"))
    rows.coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    J.run_available(J.online_predictor(stream, "k", "i", ["x", "z"], "y"), f"{path}/log", f"{path}/out")
    got = {r.i: r.pred for r in spark.read.parquet(f"{path}/out").collect()}
    want = {r.i: r.pred for r in G.prequential(rows, ["k"], ["i"], ["x", "z"], "y", fallback="x").collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_exact_quantiles_are_plain_aggregates(spark):
    """Quantiles by places equal percentile, nulls and ties among the values, and no aggregate of the plan runs uncompiled."""
    from granary.operators.rollouts import summarize_rollouts

    rows = spark.range(500).selectExpr("id % 61 as k", "id % 3 as group_id", "cast(id % 2 as double) as reward", "case when id % 61 = 5 or id % 4 = 0 then null else cast(id * 37 % 11 as double) / 7 end as mean_logprob")
    names = ("logprob_p10", "logprob_p50", "logprob_p90", "reward_mean")
    out = summarize_rollouts(rows, ["k"], only=names)
    want = {r[0]: tuple(r[1] or (None,) * 3) for r in rows.groupBy("k").agg(F.percentile("mean_logprob", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))).collect()}
    assert {r.k: (r.logprob_p10, r.logprob_p50, r.logprob_p90) for r in out.collect()} == want and want[5] == (None,) * 3
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
