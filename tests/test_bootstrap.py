"""Bootstrap intervals against brute force from the weights, and what they shuffle."""

import hashlib
import math

import numpy as np
import pytest
from granary.operators import bootstrap as B
from pyspark.sql import functions as F


def weight(number: int, rep: int) -> int:
    x = (number + rep * 0x9E3779B9) % 2**32
    for _ in range(2):
        x = (x ^ (x >> 16)) * 0x45D9F3B % 2**32
    return sum(x >> 16 >= s for s in B.STEPS)


def number(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def replicates(rows, stat, reps, seed=7):
    """stat of each replicate's list of resampled rows."""
    own = [number(seed, g, i) for g, i, *_ in rows]
    out = []
    for r in range(reps):
        picked = [row for row, n in zip(rows, own) for _ in range(weight(n, r))]
        if picked:
            out.append(stat(picked))
    return out


def table(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    rows = [("ab"[i % 3 == 0], i, float(np.round(rng.normal(), 1)), float(rng.normal())) for i in range(n)] + [("c", 500, 2.5, 1.0), (None, 7, 1.0, 2.0), (None, 8, 3.0, 1.0)]
    extra = [("a", 900, None, 1.0), ("a", 901, float("nan"), 1.0), ("b", 902, float("inf"), 2.0)]
    return rows, spark.createDataFrame(rows + extra, "g string, id long, x double, y double").repartition(3)


STATS = {
    "mean": lambda r: np.mean([v[2] for v in r]),
    "std": lambda r: np.std([v[2] for v in r]),
    "sum": lambda r: np.sum([v[2] for v in r]),
    "median": lambda r: np.median([v[2] for v in r]),
    0.9: lambda r: np.quantile([v[2] for v in r], 0.9),
    "ratio": lambda r: np.sum([v[2] for v in r]) / np.sum([v[3] for v in r]),
    "pearson": lambda r: np.corrcoef([v[2] for v in r], [v[3] for v in r])[0, 1] if np.std([v[2] for v in r]) * np.std([v[3] for v in r]) > 1e-9 else 0.0,
}


def test_weights_are_those_of_the_rule():
    rows = np.array([0, 1, 12345, 2**32 - 1])
    assert B.weights(rows, 3, 40).tolist() == [[weight(int(n), r) for r in range(3, 40)] for n in rows]
    many = B.weights(np.random.default_rng(2).integers(0, 2**32, 5000), 0, 200).astype(float)
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.01
    assert abs(np.corrcoef(many[:, 0], many[:, 1])[0, 1]) < 0.05 and abs(np.corrcoef(many[0], many[1])[0, 1]) < 0.2


@pytest.mark.parametrize("stat", STATS)
def test_equals_brute_force(spark, stat):
    rows, df = table(spark)
    columns = ["x", "y"] if stat in ("ratio", "pearson") else ["x"]
    got = {r.g: r for r in B.bootstrap_ci(df, ["g"], columns, stat, 60, 7).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in "abc":
        own = [r for r in rows if r[0] == g]
        want = replicates(own, STATS[stat], 60)
        r = got[g]
        assert r.n == len(own) and r.replicates == len(want)
        assert np.allclose([r.point, r.low, r.high], [STATS[stat](own), *np.quantile(want, [0.025, 0.975])])


@pytest.mark.parametrize("p", [0.5, 0.02])
def test_windows_of_large_keys(spark, monkeypatch, p):
    rows, df = table(spark, 3000)
    whole = sorted(map(str, B.bootstrap_ci(df, ["g"], ["x"], p, 80, 7).collect()))
    monkeypatch.setattr(B, "WHOLE", 10)
    monkeypatch.setattr(B, "GRID", 64)
    assert sorted(map(str, B.bootstrap_ci(df, ["g"], ["x"], p, 80, 7).collect())) == whole
    # a window that is too narrow for some replicates is widened
    narrow = []
    settle = B.replicate_sums
    monkeypatch.setattr(B, "replicate_sums", lambda *a: narrow.append(1) or settle(*a))
    monkeypatch.setattr(B, "GRID", 4096)
    monkeypatch.setattr(B.math, "sqrt", lambda x: 0.01 * x**0.5)
    assert sorted(map(str, B.bootstrap_ci(df, ["g"], ["x"], p, 80, 7).collect())) == whole and len(narrow) > 1


@pytest.mark.parametrize("stat", ["mean", "median"])
def test_without_keys_and_empty(spark, stat):
    rows, df = table(spark, 40)
    (r,) = B.bootstrap_ci(df.filter("g = 'a'"), [], ["x"], stat, 30, 7).collect()
    own = [r[2] for r in rows if r[0] == "a"]
    assert r.n == len(own) and math.isclose(r.point, np.mean(own) if stat == "mean" else np.median(own)) and r.low <= r.point <= r.high
    (r,) = B.bootstrap_ci(df.limit(0), [], ["x"], stat, 30, 7).collect()
    assert (r.n, r.replicates) == (0, 0) and math.isnan(r.point) and math.isnan(r.low) and math.isnan(r.high)
    assert B.bootstrap_ci(df.limit(0), ["g"], ["x"], stat, 30, 7).collect() == []


def test_paired_arms(spark):
    a = spark.createDataFrame([("d", i, float(i % 5)) for i in range(50)] + [("d", 70, None), ("e", 1, 2.0)], "k string, grp long, v double")
    b = spark.createDataFrame([("d", i, float(i % 3)) for i in range(60)] + [("d", 70, 1.0)], "k string, grp long, v double")
    rows = [("d", i, float(i % 5 - i % 3)) for i in range(50)]
    (r,) = B.paired_bootstrap_ci(a, b, ["k"], "grp", "v", replicates=50, seed=3).collect()
    want = replicates(rows, STATS["mean"], 50, 3)
    assert (r.k, r.n) == ("d", 50) and np.allclose([r.point, r.low, r.high], [np.mean([x[2] for x in rows]), *np.quantile(want, [0.025, 0.975])])


def test_shuffled_rows_do_not_grow(spark):
    """A task hands on one row for each key and replicate, whatever it has read."""
    for n in (1000, 100_000):
        df = spark.range(n, numPartitions=4).select(F.lit("a").alias("g"), (F.col("id") * 7919).alias("num"), F.col("id").cast("double").alias("v"))
        plan = B.replicate_sums(df, ["g"], "num", ["v"], 50)
        before = plan._jdf.queryExecution().toString()
        assert "MapInArrow" in before and "Join" not in before and "Generate" not in before
        assert B._few_tasks(df).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert plan.count() == 51


def drawn_number(seeds: str, e: int) -> int:
    x = (int(seeds[:8], 16) + e * 0x9E3779B9) % 2**32
    x = (x ^ (x >> 16)) * 0x45D9F3B % 2**32 ^ int(seeds[8:16], 16)
    return (x ^ (x >> 16)) * 0x45D9F3B % 2**32


def exact_places(text: str, rep: int, n: int, block: int) -> list[int]:
    """The rows that a replicate draws, one number for each draw."""
    digest = lambda *parts: hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()
    size = lambda b: min(block, n - b * block)
    level = range(-(-n // block))
    first = [drawn_number(digest(text, rep, "draws", c), e) * n // 2**32 // block for c in level for e in range(size(c))] if n > block else [0] * n
    return [b * block + drawn_number(digest(text, rep, "rows", b), e) * size(b) // 2**32 for b in level for e in range(first.count(b))]


@pytest.mark.parametrize("block", [16, B.BLOCK])
@pytest.mark.parametrize("stat", ["mean", "pearson"])
def test_exact_draws_equal_brute_force(spark, stat, block):
    rows, df = table(spark)
    columns = ["x", "y"] if stat == "pearson" else ["x"]
    got = {r.g: r for r in B.bootstrap_ci(df, ["g"], columns, stat, 60, 7, exact=True, block=block).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in "abc":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        places = [exact_places(f"7:{g}", r, len(own), block) for r in range(60)]
        assert all(len(p) == len(own) for p in places)  # n draws, no more and no fewer
        want = [STATS[stat]([own[i] for i in p]) for p in places]
        r = got[g]
        assert (r.n, r.replicates) == (len(own), 60)
        assert np.allclose([r.point, r.low, r.high], [STATS[stat](own), *np.quantile(want, [0.025, 0.975])])


@pytest.mark.parametrize("block", [64, B.BLOCK])
def test_every_replicate_draws_as_many_rows_as_there_are(spark, block):
    df = spark.range(1000, numPartitions=3).select(F.when(F.col("id") < 990, "a").alias("g"), F.when(F.col("id") < 990, F.col("id")).otherwise(F.col("id") - 990).alias("num"), F.lit(2.0).alias("v"))
    sums = B.drawn_sums(df, ["g"], "num", ["v"], 50, 7, block).collect()
    assert len(sums) == 2 * 51 and {(r.g, r.w, r.s0) for r in sums} == {("a", 990.0, 1980.0), (None, 10.0, 20.0)}


def test_exact_draws_are_multinomial():
    """Each row is drawn once on average with the variance of draws with replacement, within blocks and across them."""
    n, block = 300, 32
    times = np.array([np.bincount(exact_places("7:a", r, n, block), minlength=n) for r in range(400)])
    assert (times.sum(axis=1) == n).all() and abs(times.var() - (1 - 1 / n)) < 0.02
    assert np.abs(times.mean(axis=0) - 1).max() < 0.25 and abs(times[:, :block].sum(axis=1).var() / (block * (1 - block / n)) - 1) < 0.3
    whole = B.shares("7:a", 5, n, block)
    assert whole.tolist() == np.bincount(np.array(exact_places("7:a", 5, n, block)) // block, minlength=10).tolist()


def test_exact_draws_without_keys_and_empty(spark):
    rows, df = table(spark, 40)
    (r,) = B.bootstrap_ci(df.filter("g = 'a'"), [], ["x"], "mean", 30, 7, exact=True, block=8).collect()
    own = [r[2] for r in rows if r[0] == "a"]
    assert r.n == len(own) and r.replicates == 30 and math.isclose(r.point, np.mean(own)) and r.low <= r.point <= r.high
    (r,) = B.bootstrap_ci(df.limit(0), [], ["x"], "mean", 30, 7, exact=True).collect()
    assert (r.n, r.replicates) == (0, 0) and math.isnan(r.point) and math.isnan(r.low) and math.isnan(r.high)
    assert B.bootstrap_ci(df.limit(0), ["g"], ["x"], "mean", 30, 7, exact=True).collect() == []
    with pytest.raises(ValueError):
        B.bootstrap_ci(df, ["g"], ["x"], "median", 30, 7, exact=True)


def test_sql_of_exact_draws_in_many_blocks(spark):
    """The registered SQL on keys of several blocks, with 32 rows a block and 40 replicates."""
    import duckdb
    from granary.plans.metric_plans import _drawn_sql, _interval_sql

    rows, df = table(spark, 300)
    con = duckdb.connect()
    con.execute("create table t (domain varchar, id bigint, v double)")
    con.executemany("insert into t values (?, ?, ?)", [(g, i, x) for g, i, x, _ in rows if g])
    sql = _drawn_sql("domain").replace("65536", "32").replace("65535", "31").replace("range(0, 2000)", "range(0, 40)")
    want = con.execute("with b as (select * from t)" + sql + _interval_sql("", "avg(v)")).fetchall()
    got = B.bootstrap_ci(df.filter("g is not null"), ["g"], ["x"], "mean", 40, 7, exact=True, block=32).collect()
    assert len(want) == 3 and np.allclose(sorted(w[1:] for w in want), sorted(tuple(r)[1:] for r in got), atol=1e-9)


def test_paired_query_draws_rows_and_candidates(spark):
    """Every row is a unit of its domain, beside one difference for each candidate; both draw as many units as there are."""
    import __spark_entry__ as entry
    from granary.plans.base import Tables

    path = "/root/testdata/sf0.001"
    rows = Tables(spark, path).labels.groupBy("domain").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("candidate_id").alias("candidates")).collect()
    want = {(r.domain, kind): r[kind] for r in rows for kind in ("rows", "candidates")}
    got = entry.queries()["h12_paired_bootstrap_ci"](spark, path).collect()
    assert {(r.domain, r.paired): r.n for r in got} == want and all(r.replicates == 2000 and r.low <= r.point <= r.high for r in got)
