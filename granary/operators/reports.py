"""Report datasets: rollups, hydrated prompts, step tables, arm comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from granary.functions.exprs import LARGE_GROUP
from granary.functions.scans import running


def candidate_rollup(df: DataFrame, key: str, order: str, lift: str, features: list[str], kept: list[str]) -> DataFrame:
    """Per candidate: seeds, lift range, means of finite features, and the first row's metadata."""
    first = F.min(F.struct(order, *kept))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg(lift).alias("mean_lift"), F.min(lift).alias("min_lift"), F.max(lift).alias("max_lift"), *(F.avg(f).alias(f"mean_{f}") for f in features), first.alias("_first")
    ).select("*", *(F.col(f"_first.{c}").alias(c) for c in kept)).drop("_first")


def hydrate(cohorts: DataFrame, ids: str, prompts: DataFrame, key: str, text: str) -> DataFrame:
    """Cohorts with their prompts' texts in order; unknown ids have a null text."""
    rows = cohorts.select("name", F.posexplode(ids).alias("pos", key))
    joined = rows.join(prompts.select(key, text), key, "left")
    return joined.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", key, text))).alias("p")).select("name", F.transform("p", lambda x: F.struct(x[key].alias(key), x[text].alias(text))).alias("prompts"))


def compact(columns: dict[str, Column]) -> Column:
    """A map of the given names to values, without those that are null."""
    pairs = [x for name, c in columns.items() for x in (F.lit(name), c)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def climb_steps(log: DataFrame, keys: list[str], block: int = LARGE_GROUP) -> DataFrame:
    """A log of keys, step, nll, acc (null where it was not measured) and gens, with realized_lift (the loss before less the loss), acc_so_far (the last
    one measured), gens_so_far, and in_order: the step follows the one before, from 0. Runs of any length spread over tasks."""
    rows = log.withColumn("_acc", F.when(F.col("acc").isNotNull(), F.struct("step", "acc")))
    rows = running(rows, keys, ["step"], {"_nll": ("lag", "nll"), "_step": ("lag", "step"), "_last": ("max", "_acc"), "gens_so_far": ("sum", "gens")}, block)
    found = {"realized_lift": F.col("_nll") - F.col("nll"), "acc_so_far": F.col("_last.acc"), "in_order": F.col("step") == F.coalesce(F.col("_step") + 1, F.lit(0))}
    return rows.withColumns(found).drop("_acc", "_nll", "_step", "_last")


def climb_comparison(log: DataFrame, arms: tuple[str, ...] = ("online", "random"), block: int = LARGE_GROUP) -> DataFrame:
    """log: arm, seed, step, nll, acc, predicted_lift, gens. One row for each step: for every arm the number of runs and the means over them of loss, last
    accuracy, realised and predicted lift and generations so far; the first arm's advantage in loss over the second; whether all steps are in order."""
    rows = climb_steps(log, ["arm", "seed"], block)
    values = {"nll": "nll", "acc": "acc_so_far", "realized_lift": "realized_lift", "predicted_lift": "predicted_lift", "gens": "gens_so_far"}
    of = lambda arm, c: F.when(F.col("arm") == arm, F.col(c))
    out = rows.filter(F.col("arm").isin(*arms)).groupBy("step").agg(
        *(e for arm in arms for e in (F.count_if(F.col("arm") == arm).alias(f"n_{arm}"), *(F.avg(of(arm, c)).alias(f"{name}_{arm}") for name, c in values.items()))), F.bool_and("in_order").alias("in_order")
    )
    return out.withColumn("nll_gap", F.col(f"nll_{arms[1]}") - F.col(f"nll_{arms[0]}"))


def rows_by_step(rows: DataFrame, snapshots: DataFrame, key: list[str], index: str, x: str) -> DataFrame:
    """Rows seen at each step t (index < t), scaled with that snapshot's mean and deviation: the flattened table, of rows x snapshots of a key.

    For sums by step use `step_summary`, which makes no such pairs."""
    s = snapshots.select(*key, "t", "mu", "sd")
    return rows.join(s, key).filter(F.col(index) < F.col("t")).withColumn("z", (F.col(x) - F.col("mu")) / F.col("sd"))


def step_summary(rows: DataFrame, snapshots: DataFrame, key: list[str], index: str, x: str, block: int = LARGE_GROUP) -> DataFrame:
    """key, t, n, z_sum, z_min and z_max over the rows seen at each snapshot (index < t), scaled with its mean and deviation.

    Rows and snapshots lie in one order, in which running sums and extremes of x answer every snapshot: no pair is formed.
    """
    seen = rows.select(*key, F.col(index).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.monotonically_increasing_id().alias("_id"), F.col(x).cast("double").alias("_x"), F.lit(None).cast("double").alias("_mu"), F.lit(None).cast("double").alias("_sd"))
    asks = snapshots.select(*key, F.col("t").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.monotonically_increasing_id().alias("_id"), F.lit(None).cast("double").alias("_x"), F.col("mu").cast("double").alias("_mu"), F.col("sd").cast("double").alias("_sd"))
    upto = running(seen.unionByName(asks), key, ["_at", "_kind", "_id"], {"_n": ("count", "_x"), "_s": ("sum", "_x"), "_low": ("min", "_x"), "_high": ("max", "_x")}, block)
    z = lambda v: (v - F.col("_mu")) / F.col("_sd")
    out = upto.filter("_kind = 0 and _n > 0")
    return out.select(*key, F.col("_at").alias("t"), F.col("_n").alias("n"), ((F.col("_s") - F.col("_n") * F.col("_mu")) / F.col("_sd")).alias("z_sum"), z(F.col("_low")).alias("z_min"), z(F.col("_high")).alias("z_max"))
