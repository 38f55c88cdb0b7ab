"""Boosted trees from histograms against Spark's own, and models of folds that grow in the same passes."""

import numpy as np
import pytest
from granary.operators import boosting as B
from pyspark.sql import functions as F


def table(spark, n=600, parts=3):
    rng = np.random.default_rng(7)
    rows = [(i, i % 3, *(float(rng.integers(0, 9)) for _ in range(4)), None if i % 11 == 0 else float(rng.integers(0, 20)), float(rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, fold int, a double, b double, c double, d double, e double, noise double")
    return df.withColumn("y", F.col("a") * 0.3 - (F.col("b") > 4).cast("double") * F.col("c") + 0.1 * F.col("noise")).repartition(parts)


X = ["a", "b", "c", "d", "e"]


def spark_trees(df, iterations, test):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembled = lambda d: VectorAssembler(inputCols=X, outputCol="v").transform(d.fillna(0.0, X))
    model = GBTRegressor(featuresCol="v", labelCol="y", predictionCol="pred", maxIter=iterations, maxDepth=2, stepSize=0.05, subsamplingRate=1.0, minInstancesPerNode=5, seed=7).fit(assembled(df))
    return {r.row_id: r.pred for r in model.transform(assembled(test)).collect()}


def test_equals_the_trees_of_spark(spark, monkeypatch):
    """Without sampling and with few values of each feature both cut at the same places; blocks' predictions are renewed on the way."""
    monkeypatch.setattr(B, "ADDED", 4)
    df = table(spark)
    got = {r.row_id: r.pred for r in B.boosted_trees(df, X, "y", 10, share=1.0).collect()}
    want = spark_trees(df, 10, df)
    assert len(got) == 600 and max(abs(got[i] - want[i]) for i in want) < 1e-9
    oof = B.boosted_oof(df, "fold", 3, X, "y", 6, share=1.0, keep=["row_id", "fold"])
    assert oof.columns == ["row_id", "fold", "pred"]
    for k in range(3):
        own = {r.row_id: r.pred for r in oof.filter(F.col("fold") == k).collect()}
        want = spark_trees(df.filter(F.col("fold") != k), 6, df.filter(F.col("fold") == k))
        assert set(own) == set(want) and max(abs(own[i] - want[i]) for i in want) < 1e-9


def test_samples_do_not_depend_on_partitions(spark):
    one, other = ({r.row_id: r.pred for r in B.boosted_trees(table(spark, parts=n), X, "y", 5, keep=["row_id"]).collect()} for n in (1, 4))
    assert set(one) == set(other) and max(abs(one[i] - other[i]) for i in one) < 1e-9


def test_passes_serve_all_folds(spark):
    """A tree takes two passes for all models together, and each pass a job for the cached blocks and one for the sums."""
    def jobs(work):
        spark.sparkContext.setJobGroup("boosted", "")
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted"))

    df = table(spark).cache()
    df.count()
    few, more = (jobs(lambda n=n: B.boosted_oof(df, "fold", 3, X, "y", n)) for n in (2, 8))
    assert 0 < more - few <= 4 * 6


@pytest.mark.parametrize("value", [1.0, 2.0])
def test_nothing_to_split(spark, value):
    df = spark.createDataFrame([(i, 3.0, value) for i in range(20)], "row_id long, a double, y double")
    assert {r.pred for r in B.boosted_trees(df, ["a"], "y", 3).collect()} == {value}
