"""Rank correlations of many columns in one exchange, against ranks of whole groups, and what is shuffled for them."""

import time

import numpy as np
import pytest
from granary.operators import evaluation as E, metrics as M, signal as S

COLUMNS = [f"x{i}" for i in range(8)]


def rows_of(spark, n=4000, name="id"):
    rng = np.random.default_rng(5)
    tens = 10.0 ** np.arange(8)
    wide = np.round(rng.normal(size=(n, 8)) * tens) / tens
    wide[:, 1] = -0.0
    ids = rng.permutation(n)
    value = lambda i, j: None if (i * 7 + j) % (5 + j) == 0 else float(wide[i, j])
    rows = [(int(ids[i]) if name == "id" else f"r{ids[i]:05d}", [None, "a", "b", "c"][rng.integers(0, 4)], None if i % 41 == 0 else float(rng.integers(0, 50)), *(value(i, j) for j in range(8))) for i in range(n)]
    return spark.createDataFrame(rows, f"id {'long' if name == 'id' else 'string'}, g string, y double, " + ", ".join(f"{c} double" for c in COLUMNS))


def found(df):
    return {(r[0], r[1]): (r[2], round(r[3], 9) + 0.0) for r in df.collect()}


@pytest.mark.parametrize("name", ["id", "text"])
@pytest.mark.parametrize("pool", [None, "POOLED"])
def test_rank_sums_equal_ranks_of_whole_groups(spark, name, pool):
    from pyspark.sql import functions as F

    df = rows_of(spark, name=name).cache()
    long = df.unpivot(["id", "g", "y"], COLUMNS, "feature", "x").filter("x is not null and y is not null")
    if pool:
        long = long.withColumn("g", F.explode(F.array("g", F.lit(pool))))
    want = found(M.spearman(long, ["feature", "g"], "x", "y"))
    for block in (100, 10_000):
        assert found(M.screened(df, "g", COLUMNS, "y", pool=pool, block=block).select("feature", "g", "n", "spearman")) == want
    assert M.screened(df.limit(0), "g", COLUMNS, "y", pool=pool).count() == 0


def written(spark, work):
    """Rows that the stages of `work` shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: list(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)))
    before = {s.stageId() for s in stages()}
    work()
    time.sleep(1)
    return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)


def test_screen_shuffles_no_row_for_each_feature(spark):
    df = rows_of(spark).cache()
    df.count()
    assert written(spark, lambda: S.feature_screen(df, COLUMNS, "y", "g").collect()) < 2 * 4000


def test_baselines_shuffle_no_row_for_each_feature(spark):
    df = rows_of(spark).filter("y is not null").selectExpr("id as row_id", "g as anchor", "id % 3 as chain_id", "y", *COLUMNS).cache()
    df.count()
    assert written(spark, lambda: E.baseline_scores(df, "chain_id", COLUMNS).collect()) < 3 * 4000
