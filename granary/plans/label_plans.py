"""Queries over lift labels and feature matrices."""

from pyspark.sql import functions as F

from granary.functions.exprs import clean, r9
from granary.operators import labels as L

from .base import query

LIFT = """, l as (select *, acc_after - acc_before as lift_acc, nll_before - nll_after as lift_nll, greatest(kl_after - kl_before, 0) as kl_drift from v_labels)"""


def lifted(t):
    return t.labels.withColumns(L.lift_columns())


@query("e1_lift_label", LIFT + " select row_id, round(lift_acc, 9) + 0.0::double as lift_acc, round(lift_nll, 9) + 0.0::double as lift_nll, round(kl_drift, 9) + 0.0::double as kl_drift from l")
def e1(t):
    labels = t.labels
    before = labels.select("row_id", "acc_before", "nll_before", "kl_before")
    after = labels.select("row_id", "acc_after", "nll_after", "kl_after")
    return L.lift_label(before, after, ["row_id"]).select("row_id", *(r9(c).alias(c) for c in ("lift_acc", "lift_nll", "kl_drift")))


@query("e2_utility", LIFT + " select row_id, round(100 * (lift_acc + 0.5 * lift_nll - 0.05 * kl_drift), 9) + 0.0::double as utility from l")
def e2(t):
    return lifted(t).select("row_id", r9(L.utility(nll=0.5)).alias("utility"))


@query(
    "e3_target",
    LIFT + """, m as (select row_id, case when row_id % 3 <> 0 then lift_acc end as lift_acc, case when row_id % 5 <> 0 then lift_nll end as lift_nll, kl_drift, lift_nll / 2 as delta from l)
select row_id, round(coalesce(100 * (lift_acc + 0 * lift_nll - 0.05 * kl_drift), lift_acc, lift_nll, -delta), 9) + 0.0::double as utility, round(coalesce(lift_nll, -delta), 9) + 0.0::double as nll,
  round(lift_acc, 9) + 0.0::double as acc from m""",
)
def e3(t):
    rows = lifted(t).select(
        "row_id", F.when(F.col("row_id") % 3 != 0, F.col("lift_acc")).alias("lift_acc"), F.when(F.col("row_id") % 5 != 0, F.col("lift_nll")).alias("lift_nll"), "kl_drift",
        (F.col("lift_nll") / 2).alias("delta_probe_nll"),
    )
    return rows.select("row_id", *(r9(L.target(rows, m)).alias(m) for m in ("utility", "nll", "acc")))


@query("e4_pending", " select chain_id, anchor_index, candidate_id, seed from v_labels where not (row_id % 4 = 0 and domain <> 'BUILDING')")
def e4(t):
    keys = ["chain_id", "anchor_index", "candidate_id", "seed"]
    return L.pending(t.labels, t.labels.filter("row_id % 4 = 0 and domain <> 'BUILDING'"), keys).select(*keys)


@query(
    "e5_branch_delta",
    """, s as (select o_custkey as state_index, avg(o_totalprice) as nll from orders where o_custkey % 11 <> 0 group by 1)
select o_orderkey as row_id, round(case when o_orderkey % 7 = 0 then null else o_totalprice end - s.nll, 6) + 0.0::double as delta_probe_nll from orders left join s on state_index = o_custkey""",
)
def e5(t):
    orders = t["orders"]
    states = orders.filter("o_custkey % 11 <> 0").groupBy(F.col("o_custkey").alias("state_index")).agg(F.avg("o_totalprice").alias("nll"))
    branches = orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("state_index"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("nll"))
    return L.branch_delta(states, branches, "state_index").select("row_id", (F.round("delta_probe_nll", 6) + 0.0).alias("delta_probe_nll"))


@query(
    "e6_dedup_labels",
    LIFT + """, k as (select domain, candidate_id, kind, row_id, lift_nll, row_number() over (partition by domain, candidate_id, kind order by row_id) as k from l)
select domain, candidate_id, kind, row_id, round(lift_nll, 9) + 0.0::double as lift_nll from k where k = 1""",
)
def e6(t):
    rows = lifted(t).select("domain", "candidate_id", "kind", "row_id", "lift_nll")
    return L.keep_first(rows, ["domain", "candidate_id", "kind"], ["row_id"]).withColumn("lift_nll", r9("lift_nll"))


E7_FEATURES = ["n_rollouts", "n_groups", *(k for k in L.FEATURE_KEYS if k not in ("n_groups", "target_similarity"))]


def _e7_sql() -> str:
    from .rollout_plans import D4_BODY

    old = {"pass_rate": "pass_old", "mean_logprob": "lp_old"}
    return f"""{LIFT}{D4_BODY}, ft as (select rr.*, g2.* exclude (candidate_id, seed) from rr join g2 using (candidate_id, seed)),
k as (select *, concat('cand-', right(candidate_id, 5)) as c, concat('cohort-', kind) as cohort, 0.2::double as pass_old, x1 as lp_old, cast(row_id % 5 as bigint) as groups_old from l)
select k.domain, k.c as candidate_id, k.seed, chain_id, anchor_index, cohort, round(lift_nll, 9) + 0.0::double as lift_nll, round(acc_after - acc_before, 9) + 0.0::double as lift_acc, round(nll_before, 9) as nll_before, round(nll_after, 9) as nll_after,
  round(greatest(kl_after - kl_before, 0), 9) as kl_drift, round(anchor_index / 3.0::double, 9) as step_frac, round(x2, 9) as target_similarity, cast(row_id % 300 as bigint) as rollout_count, ft.candidate_id is not null as matched,
  """ + ", ".join(f"ft.{f}" if f == "n_rollouts" else f"coalesce(ft.{f}, groups_old) as {f}" if f == "n_groups" else f"round(case when ft.candidate_id is not null then ft.{f} else {old.get(f, 'null')} end, 9) + 0.0::double as {f}" for f in E7_FEATURES
    ) + " from k left join ft on ft.candidate_id = k.c and ft.seed = k.seed"


@query("e7_backfill_features", _e7_sql())
def e7(t):
    from granary.operators.rollouts import group_advantages

    row = F.col("row_id")
    labels = lifted(t).select(
        "domain", F.concat(F.lit("cand-"), F.substring("candidate_id", -5, 5)).alias("candidate_id"), "seed", "chain_id", "anchor_index", F.concat(F.lit("cohort-"), "kind").alias("cohort"), "lift_nll", (F.col("acc_after") - F.col("acc_before")).alias("lift_acc"),
        "nll_before", "nll_after", F.greatest(F.col("kl_after") - F.col("kl_before"), F.lit(0.0)).alias("kl_drift"), (F.col("anchor_index") / F.lit(3.0)).alias("step_frac"), F.col("x2").alias("target_similarity"), (row % 300).alias("rollout_count"),
        F.struct(F.lit(0.2).alias("pass_rate"), F.col("x1").alias("mean_logprob"), (row % 5).alias("n_groups")).alias("reward_summary"),
    )
    out = L.backfill_features(labels, group_advantages(t.rollouts, ["candidate_id", "seed", "group_id"]), ["candidate_id", "seed"])
    numbers = ("lift_nll", "lift_acc", "nll_before", "nll_after", "kl_drift", "step_frac", "target_similarity")
    features = [F.col("features")[f].alias(f) if f in ("n_rollouts", "n_groups") else r9(F.col("features")[f]).alias(f) for f in E7_FEATURES]
    return out.select(*(r9(c).alias(c) if c in numbers else c for c in L.ENRICHED), "matched", *features)


@query("e8_step_frac", " select row_id, round(anchor_index::double / greatest(max(anchor_index) over (partition by chain_id, domain), 1), 9) as step_frac from v_labels")
def e8(t):
    return L.step_fraction(t.labels, ["chain_id", "domain"], "anchor_index").select("row_id", r9("step_frac").alias("step_frac"))


@query("e9_label_key", " select row_id, concat(chain_id, '.', coalesce(cast(nullif(anchor_index, 2) as varchar), '0'), '.', candidate_id, '.', seed) as label_key from v_labels")
def e9(t):
    return t.labels.select("row_id", L.label_key("chain_id", F.nullif("anchor_index", F.lit(2)), "candidate_id", "seed").alias("label_key"))


FEATURES = ["x1", "x2", "x3"]


def _features_sql() -> str:
    """Common tables up to `fx`: labels with every feature, their lines being their rollouts."""
    import re

    from .rollout_plans import D4_BODY

    body = D4_BODY.replace("v_rollouts", "v_order_rollouts").replace("candidate_id, seed", "row_id").replace("group by 1, 2, 3", "group by row_id, group_id")
    body = re.sub(r"group by 1, 2\b", "group by row_id", body)
    own = ", ".join(k for k in L.FEATURE_KEYS if k != "target_similarity")
    return f"""{LIFT}{body}, ft as (select row_id, {own} from rr join g2 using (row_id)),
fx as (select l.*, ft.* exclude (row_id), cast(l.row_id % 89 as double) / 89.0e0 as target_similarity, 1.4e0 + cast(l.row_id % 83 as double) / 83.0e0 as fingerprint_nll,
  case when l.row_id % 5 <> 0 then cast(l.row_id % 61 as double) / 61.0e0 end as fingerprint_entropy, cast(anchor_index as double) / 3.0e0 as step_frac, concat(chain_id, '::', anchor_index) as anchor
  from l left join ft on l.row_id = ft.row_id)"""


FX = _features_sql()
ALL = [*L.FEATURE_KEYS, *L.CONTEXT_KEYS]


def featured(t):
    """Labels with every feature: the statistics of their orders' lines, and stand-ins for the rest."""
    from granary.operators.rollouts import summarize_rollouts

    names = tuple(k for k in L.FEATURE_KEYS if k != "target_similarity")
    stats = summarize_rollouts(t.order_rollouts, ["row_id"], only=names, advantages=True).select("row_id", F.struct(*names).alias("reward_summary"))
    row = F.col("row_id")
    extra = {
        "target_similarity": (row % 89).cast("double") / 89.0, "fingerprint_nll": F.lit(1.4) + (row % 83).cast("double") / 83.0,
        "fingerprint_entropy": F.when(row % 5 != 0, (row % 61).cast("double") / 61.0), "step_frac": F.col("anchor_index").cast("double") / 3.0,
    }
    return lifted(t).withColumns(extra).join(stats, "row_id", "left")


@query("f1_feature_vector", FX + " select row_id, " + ", ".join(f"round({k}, 9) + 0.0::double as {k}" for k in ALL) + " from fx")
def f1(t):
    rows = featured(t)
    return rows.select("row_id", *(r9(c).alias(k) for k, c in L.feature_columns(rows, ALL).items()))


@query("f2_build_matrix", FX + " select row_id, anchor, domain, " + ", ".join(f"round({k}, 9) + 0.0::double as {k}" for k in ALL) + ", round(lift_nll, 9) + 0.0::double as y from fx where row_id % 6 <> 0")
def f2(t):
    rows = featured(t).withColumn("lift_nll", F.when(F.col("row_id") % 6 != 0, F.col("lift_nll")))  # the others have no target
    out = L.build_xy(rows, ["row_id", "domain"], "nll")
    return out.select("row_id", "anchor", "domain", *(r9(k).alias(k) for k in [*ALL, "y"]))


def _scaled(k: str) -> str:
    return f"case when {k} is not null then ({k} - coalesce(avg({k}) over w, 0)) / (case when stddev_pop({k}) over w > 1e-9 then stddev_pop({k}) over w else 1 end) end"


@query(
    "f2_standardized_mechanism",
    FX + " select row_id, anchor, domain, " + ", ".join(f"round({_scaled(k)}, 7) + 0.0::double as {k}" for k in L.MECHANISM_KEYS) + ", round(lift_nll, 9) + 0.0::double as y from fx window w as (partition by domain)",
)
def f2_standardized(t):
    """The domain-invariant features, scaled within domains, without context."""
    out = L.build_xy(featured(t), ["row_id", "domain"], "nll", L.MECHANISM_KEYS, False, "domain")
    return out.select("row_id", "anchor", "domain", *((F.round(k, 7) + 0.0).alias(k) for k in L.MECHANISM_KEYS), r9("y").alias("y"))


@query(
    "f3_impute_mean",
    """, m as (select avg(x1) as m from v_labels where chain_id <> 0) select row_id, round(coalesce(x1, (select m from m), 0), 9) + 0.0::double as x1, round(x2, 9) as x2 from v_labels""",
)
def f3(t):
    rows = t.labels.select("row_id", "chain_id", "x1", "x2")
    return L.impute_mean(rows.filter("chain_id <> 0"), rows, ["x1", "x2"]).select("row_id", r9("x1").alias("x1"), r9("x2").alias("x2"))


@query(
    "f4_zscore_by_group",
    """ select row_id, """ + ", ".join(f"round(({c} - avg({c}) over w) / (case when stddev_pop({c}) over w > 1e-9 then stddev_pop({c}) over w else 1 end), 9) + 0.0::double as {c}" for c in FEATURES)
    + " from v_labels window w as (partition by domain)",
)
def f4(t):
    rows = t.labels.select("row_id", "domain", *FEATURES)
    return L.zscore_by_group(rows, "domain", FEATURES).select("row_id", *(r9(f).alias(f) for f in FEATURES))


@query(
    "f5_denoise_seeds",
    LIFT + " select domain, candidate_id, round(avg(lift_nll), 9) + 0.0::double as y, round(avg(x1), 9) + 0.0::double as x1, round(avg(x3), 9) as x3, count(*) as n_seeds from l group by 1, 2",
)
def f5(t):
    rows = lifted(t).withColumnRenamed("lift_nll", "y")
    return L.denoise_seeds(rows, ["domain", "candidate_id"], ["x1", "x3"], "y").select("domain", "candidate_id", *(r9(c).alias(c) for c in ("y", "x1", "x3")), "n_seeds")


@query("f6_finite_target", " select row_id, round(x1, 9) + 0.0::double as y from v_labels where x1 is not null and row_id % 19 <> 0 and row_id % 23 <> 0")
def f6(t):
    odd = F.when(F.col("row_id") % 19 == 0, F.lit(float("nan"))).when(F.col("row_id") % 23 == 0, F.lit(float("inf"))).otherwise(F.col("x1"))
    return t.labels.select("row_id", r9(clean(odd)).alias("y")).filter("y is not null")
