"""Lift labels, their targets and keys, and the feature matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from granary.functions.exprs import FLAT, clean, col
from granary.sources.scratch import stored


# The features of a label row that a predictor may see, in order; its context; the domain-invariant ones.
FEATURE_KEYS = (
    "reward_mean reward_std pass_rate group_passrate_mean group_passrate_std frac_nondegenerate frac_all_correct frac_all_wrong mean_logprob surprisal_mean entropy_mean "
    "logprob_p10 logprob_p50 logprob_p90 confidence_slope redundancy_mean len_mean len_std target_similarity n_groups adv_std adv_absmean min_logprob_mean"
).split()
CONTEXT_KEYS = "fingerprint_nll fingerprint_entropy step_frac".split()
MECHANISM_KEYS = "reward_mean reward_std pass_rate group_passrate_mean group_passrate_std frac_nondegenerate frac_all_correct frac_all_wrong redundancy_mean target_similarity n_groups".split()
# What is measured after an update, which no feature may be.
OUTCOMES = "acc_after nll_after kl_after lift_acc lift_nll kl_drift utility delta_probe_nll kl_train".split()


def feature_columns(df: DataFrame, keys: list[str], nested: str = "reward_summary") -> dict[str, Column]:
    """The named features of `df`, from its columns or its struct `nested`; null where it has none. Outcomes are refused."""
    barred = [k for k in keys if k in OUTCOMES]
    if barred:
        raise ValueError(f"outcomes are no features: {barred}")
    inner = df.schema[nested].dataType.fieldNames() if nested in df.columns else []
    pick = lambda k: clean(k) if k in df.columns else clean(F.col(nested).getField(k)) if k in inner else F.lit(None).cast("double")
    return {k: pick(k) for k in keys}


def build_xy(df: DataFrame, ids: list[str], mode: str, keys: list[str] = FEATURE_KEYS, context: bool = True, standardize: str | None = None) -> DataFrame:
    """ids, anchor, the features, and y of the rows that have a target; `standardize` names the column within which features are scaled."""
    names = [*keys, *(CONTEXT_KEYS if context else [])]
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0")) if c in df.columns else F.lit("0")
    anchor = F.concat_ws("::", part("chain_id"), part("anchor_index"))
    out = df.select(*ids, anchor.alias("anchor"), *(c.alias(k) for k, c in feature_columns(df, names).items()), clean(target(df, mode)).alias("y")).filter("y is not null")
    return zscore_by_group(out, standardize, names) if standardize else out


def lift_columns() -> dict[str, Column]:
    return {
        "lift_acc": F.col("acc_after") - F.col("acc_before"),
        "lift_nll": F.col("nll_before") - F.col("nll_after"),
        "kl_drift": F.greatest(F.col("kl_after") - F.col("kl_before"), F.lit(0.0)),
    }


def lift_label(before: DataFrame, after: DataFrame, anchor: list[str]) -> DataFrame:
    """Measurements after training against those of their anchor before it."""
    return after.join(before, anchor).withColumns(lift_columns())


def utility(acc: float = 1.0, nll: float = 0.0, kl: float = 0.05, scale: float = 100.0) -> Column:
    return scale * (acc * F.col("lift_acc") + nll * F.col("lift_nll") - kl * F.col("kl_drift"))


def target(df: DataFrame, mode: str, **weights) -> Column:
    """The label of a mode: its own column, else for utility its parts, else the nearest other label; null drops the row."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    if mode == "acc":
        return have("lift_acc")
    if mode == "nll":
        return F.coalesce(have("lift_nll"), -have("delta_probe_nll"))
    parts = utility(**weights) if {"lift_acc", "lift_nll", "kl_drift"} <= set(df.columns) else F.lit(None).cast("double")
    return F.coalesce(have("utility"), parts, have("lift_acc"), have("lift_nll"), -have("delta_probe_nll"))


def pending(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the plan whose key has no label yet; nulls in keys compare equal."""
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    return plan.alias("p").join(done.select(*keys).distinct().alias("d"), same, "left_anti")


def branch_delta(states: DataFrame, branches: DataFrame, key: str) -> DataFrame:
    return branches.join(states.select(key, F.col("nll").alias("state_nll")), key, "left").withColumn("delta_probe_nll", F.col("nll") - F.col("state_nll"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order; a min over structs, so groups shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*order, *(c for c in rest if c not in order))
    return df.groupBy(*keys).agg(F.min(ordered).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def step_fraction(df: DataFrame, chain: list[str], anchor: str) -> DataFrame:
    anchors = df.groupBy(*chain).agg(F.greatest(F.max(anchor), F.lit(1)).alias("_last"))
    return df.join(anchors, chain).withColumn("step_frac", F.col(anchor) / F.col("_last")).drop("_last")


def label_key(*parts) -> Column:
    return F.concat_ws(".", *(F.coalesce(col(p).cast("string"), F.lit("0")) for p in parts))


def zscore_by_group(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Features scaled within groups by mean and population deviation (too small: 1); missing stays missing. `df` is written once, as it is read twice."""
    df = stored(df, "unscaled")
    stats = df.groupBy(group).agg(*(a for f in features for a in (F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))))
    joined = df.join(stats, group)
    scaled = {f: (F.col(f) - F.coalesce(f"_m_{f}", F.lit(0.0))) / F.when(F.col(f"_s_{f}") > FLAT, F.col(f"_s_{f}")).otherwise(1.0) for f in features}
    return joined.withColumns(scaled).select(*df.columns)


def impute_mean(train: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
    """Missing features get the training rows' mean, or 0 where no training row has the feature."""
    means = train.agg(*(F.coalesce(F.avg(clean(f)), F.lit(0.0)).alias(f"_m_{f}") for f in features))
    filled = rows.crossJoin(F.broadcast(means)).withColumns({f: F.coalesce(clean(f), F.col(f"_m_{f}")) for f in features})  # one row of means
    return filled.select(*rows.columns)


def denoise_seeds(df: DataFrame, keys: list[str], features: list[str], y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(clean(y)).alias(y), *(F.avg(clean(f)).alias(f) for f in features), F.count(F.lit(1)).alias("n_seeds"))


# The columns of an enriched label, beside its features.
ENRICHED = "domain candidate_id seed chain_id anchor_index cohort lift_nll lift_acc nll_before nll_after kl_drift step_frac target_similarity rollout_count".split()


def backfill_features(labels: DataFrame, rollouts: DataFrame, keys: list[str], group: str = "group_id", stored_as: str = "reward_summary") -> DataFrame:
    """The 14 columns of enriched labels, `features` and `matched`: features computed again from the rollouts of each label's keys.

    Labels without rollouts keep their stored summary, read into the same fields; labels without lift_nll are left out;
    a column that the labels lack is null. advantage is taken from the rollouts, where they have it.
    """
    from granary.operators.rollouts import summarize_rollouts

    again = summarize_rollouts(rollouts, keys, group)
    names = [c for c in again.columns if c not in keys]
    new = again.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*names).alias("_new"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    kept = labels.schema[stored_as].dataType.names if stored_as in labels.columns else []
    old = F.struct(*((F.col(stored_as)[c] if c in kept else F.lit(None)).cast(again.schema[c].dataType).alias(c) for c in names))
    rows = labels.filter(F.col("lift_nll").isNotNull()).join(new, same, "left")
    columns = [F.col(c) if c in labels.columns else F.lit(None).cast("string").alias(c) for c in ENRICHED]
    return rows.select(*columns, F.coalesce("_new", old).alias("features"), F.col("_new").isNotNull().alias("matched"))
