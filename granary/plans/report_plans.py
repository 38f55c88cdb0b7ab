"""Queries of report datasets."""

from pyspark.sql import Window as W, functions as F

from granary.functions.exprs import r9
from granary.operators import reports as P

from .base import query
from .label_plans import LIFT, lifted


@query(
    "j1_candidate_rollup",
    LIFT + """ select candidate_id, count(*) as n_seeds, round(avg(lift_nll), 9) + 0.0::double as mean_lift, round(min(lift_nll), 9) + 0.0::double as min_lift, round(max(lift_nll), 9) + 0.0::double as max_lift,
  round(avg(x1), 9) + 0.0::double as mean_x1, arg_min(kind, seed) as kind, arg_min(domain, seed) as domain from l group by 1""",
)
def j1(t):
    out = P.candidate_rollup(lifted(t), "candidate_id", "seed", "lift_nll", ["x1"], ["kind", "domain"])
    return out.select("candidate_id", "n_seeds", *(r9(c).alias(c) for c in ("mean_lift", "min_lift", "max_lift", "mean_x1")), "kind", "domain")


@query(
    "j2_hydrate_prompts",
    """, m as (select o_custkey as name, list(o_orderkey order by o_orderkey) as ids from orders group by 1), e as (select name, unnest(ids) as id, unnest(range(0, len(ids))) as pos from m)
select cast(name as varchar) as name, string_agg(coalesce(o_orderpriority, '?'), ',' order by pos) as prompts from e left join (select * from orders where o_orderkey % 4 <> 0) p on p.o_orderkey = e.id group by 1""",
)
def j2(t):
    orders = t["orders"]
    cohorts = orders.groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    prompts = orders.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    out = P.hydrate(cohorts, "ids", prompts, "id", "text")
    return out.select("name", F.array_join(F.transform("prompts", lambda p: F.coalesce(p["text"], F.lit("?"))), ",").alias("prompts"))


@query(
    "j3_compact_rows",
    " select row_id, concat_ws(',', case when x1 is not null then 'diff' end, 'pos', case when seed > 3 then 'late' end) as present from v_labels",
)
def j3(t):
    present = F.map_keys(P.compact({"diff": F.col("x1"), "pos": F.col("x2"), "late": F.when(F.col("seed") > 3, F.col("x3"))}))
    return t.labels.select("row_id", F.array_join(present, ",").alias("present"))


@query("j4_kind_counts", ", f as (select candidate_id, arg_min(kind, seed) as kind from v_labels group by 1) select kind, count(*) as n from f group by 1")
def j4(t):
    first = t.labels.groupBy("candidate_id").agg(F.min_by("kind", "seed").alias("kind"))
    return first.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_CLIMB = " ".join(
    f"cast(count(*) filter (arm = '{a}') as bigint) as n_{a}, " + ", ".join(f"round(avg({c}) filter (arm = '{a}'), 9) + 0.0::double as {n}_{a}" for n, c in (("nll", "nll"), ("acc", "acc_so_far"), ("realized_lift", "realized"), ("predicted_lift", "predicted_lift"), ("gens", "so_far"))) + ","
    for a in ("online", "random")
)


@query(
    "j5_climb_comparison",
    """, g as (select case when chain_id = 0 then 'online' else 'random' end as arm, candidate_id, seed as step, nll_after as nll, case when seed % 3 = 0 then acc_after end as acc, x2 as predicted_lift, 32 as gens, row_id from v_labels where row_id % 50 <> 7),
r as (select *, lag(nll) over w - nll as realized, last_value(acc ignore nulls) over (w rows between unbounded preceding and current row) as acc_so_far, sum(gens) over (w rows between unbounded preceding and current row) as so_far, step = coalesce(lag(step) over w + 1, 0) as ok
  from g window w as (partition by arm, candidate_id order by step))
select step, """ + _CLIMB + """ bool_and(ok) as in_order, round(avg(nll) filter (arm = 'random') - avg(nll) filter (arm = 'online'), 9) + 0.0::double as nll_gap from r group by 1""",
)
def j5(t):
    """Some steps are missing, as in a log that broke off."""
    arm = F.when(F.col("chain_id") == 0, "online").otherwise("random")
    rows = t.labels.filter("row_id % 50 <> 7")
    log = rows.select(arm.alias("arm"), F.col("candidate_id").alias("seed"), F.col("seed").alias("step"), F.col("nll_after").alias("nll"), F.when(F.col("seed") % 3 == 0, F.col("acc_after")).alias("acc"), F.col("x2").alias("predicted_lift"), F.lit(32).alias("gens"))
    out = P.climb_comparison(log)
    plain = ("step", "n_online", "n_random", "in_order")
    return out.select(*(c if c in plain else r9(c).alias(c) for c in out.columns))


@query(
    "j6_rows_by_step",
    """, s as (select candidate_id, seed + 1 as t, avg(x3) over w as mu, stddev_pop(x3) over w as sd from v_labels window w as (partition by candidate_id order by seed rows between unbounded preceding and current row))
select candidate_id, cast(t as int) as t, count(*) as n, round(sum((x3 - mu) / sd), 6) + 0.0::double as z_sum, round(max((x3 - mu) / sd), 6) + 0.0::double as z_max from v_labels join s using (candidate_id) where seed < t and sd > 1e-6 group by 1, 2""",
)
def j6(t):
    w = W.partitionBy("candidate_id").orderBy("seed").rowsBetween(W.unboundedPreceding, 0)
    snaps = t.labels.select("candidate_id", (F.col("seed") + 1).alias("t"), F.avg("x3").over(w).alias("mu"), F.stddev_pop("x3").over(w).alias("sd")).filter("sd > 1e-6")
    out = P.step_summary(t.labels.select("candidate_id", "seed", "x3"), snaps, ["candidate_id"], "seed", "x3")
    return out.select("candidate_id", F.col("t").cast("int").alias("t"), "n", (F.round("z_sum", 6) + 0.0).alias("z_sum"), (F.round("z_max", 6) + 0.0).alias("z_max"))
