"""The first rows of seeded orders: the same as from whole orders, and only few of them reach a sort."""

import pytest
from granary.functions.exprs import leading, shuffle_key
from granary.operators import cohorts as C
from pyspark.sql import functions as F


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_first_rows_are_those_of_the_whole_order(spark, most):
    pool = spark.range(20_000).select(F.col("id").cast("string").alias("prompt_id"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("level"))
    for keys in ([], ["level"]):
        whole = C.shuffled(pool, 3, keys).filter(F.col("rn") <= most)
        assert sorted(map(str, C.shuffled(pool, 3, keys, most).collect())) == sorted(map(str, whole.collect()))


def test_few_rows_reach_the_sort(spark):
    pool = spark.range(50_000).select(F.col("id").cast("string").alias("prompt_id")).withColumn("_key", shuffle_key(3, "prompt_id"))
    assert 64 <= leading(pool, [], "_key", 64).count() < 200


def test_all_families_read_the_pool_once(spark, monkeypatch):
    names = []
    own = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: names.append(name) or own(df, name))
    pool = spark.range(3000).select(F.col("id").cast("string").alias("prompt_id"), (F.col("id") % 21 / 20.0).alias("pass_rate"), (F.col("id") % 2).cast("string").alias("level"))
    out = C.build_all(pool, 8, 3)
    assert names == ["cohort-pool", "cohort-members"]
    assert "cohort-pool" not in names[1:] and {r.kind for r in out.select("kind").distinct().collect()} == {"label_noise", "duplication", "passband", "variance_decoupled", "by_level", "random"}
    assert out.groupBy("name").count().filter("count <> 8").isEmpty()
