"""Queries of signal, reliability and effects."""

from pyspark.sql import functions as F

from granary.functions.exprs import pearson, r9
from granary.operators import labels as L, signal as S

from .base import query
from .label_plans import ALL, FX, LIFT, featured, lifted
from .metric_plans import COR

GATE = """, u as (select domain, candidate_id, lab as label, case lab when 'acc' then lift_acc when 'nll' then lift_nll else x3 end as v from l, (values ('acc'), ('nll'), ('x3')) q(lab)),
p as (select label, candidate_id, avg(v) as m, var_samp(v) as s, count(v) as n from u group by 1, 2),
g as (select label, count(*) as n_cohorts, count(*) filter (n >= 2) as n_with_repeats, avg(s) filter (n >= 2) as w, var_samp(m) as b from p group by 1),
gate as (select label, n_cohorts, n_with_repeats, b / (b + w) as icc, sqrt(b) / (sqrt(w) + 1e-12) as snr, sqrt(w) as within_std, sqrt(b) as between_std,
  case when b + w > 1e-18 then case when b / (b + w) >= 0.5 then 'strong_signal' when b / (b + w) >= 0.2 then 'usable_signal' else 'noise_dominated' end else 'insufficient_repeats' end as verdict from g)"""


def gate_rows(t):
    rows = lifted(t).select("candidate_id", F.col("lift_acc").alias("acc"), F.col("lift_nll").alias("nll"), "x3")
    return S.gate(S.unpivoted(rows, ["candidate_id"], ["acc", "nll", "x3"]), "candidate_id", "value", ["label"])


@query("i1_gate", LIFT + GATE + " select label, n_cohorts, n_with_repeats, round(icc, 9) as icc, round(snr, 9) as snr, round(within_std, 9) as within_std, round(between_std, 9) as between_std, verdict from gate")
def i1(t):
    return gate_rows(t).select("label", "n_cohorts", "n_with_repeats", *(r9(c).alias(c) for c in ("icc", "snr", "within_std", "between_std")), "verdict")


@query(
    "gate_report",
    """, r as (select candidate_id, seed, avg(reward) as m from v_rollouts group by 1, 2), x as (select candidate_id, seed, m - avg(m) over () as lift from r),
p as (select candidate_id, avg(lift) as m, var_samp(lift) as s, count(*) as n from x group by 1), g as (select count(*) as n_cohorts, avg(s) filter (n >= 2) as w, var_samp(m) as b from p)
select n_cohorts, round(b / (b + w), 9) as icc, round(sqrt(b) / (sqrt(w) + 1e-12), 9) as snr,
  case when b / (b + w) >= 0.5 then 'strong_signal' when b / (b + w) >= 0.2 then 'usable_signal' else 'noise_dominated' end as verdict from g""",
)
def gate_report(t):
    """The flagship: rollouts to advantages to per-cohort features to lifts to the signal gate."""
    from granary.operators.rollouts import summarize_rollouts

    features = summarize_rollouts(t.rollouts, ["candidate_id", "seed"], only=("reward_mean",))
    base = features.agg(F.avg("reward_mean").alias("base"))  # one row
    lifts = features.crossJoin(F.broadcast(base)).select("candidate_id", "seed", (F.col("reward_mean") - F.col("base")).alias("lift"))
    return S.gate(lifts, "candidate_id", "lift").select("n_cohorts", r9("icc").alias("icc"), r9("snr").alias("snr"), "verdict")


@query("i2_proxy_correlation", LIFT + f" select domain, round({COR.format(x='lift_nll', y='lift_acc')}, 9) + 0.0::double as r from l group by 1")
def i2(t):
    return lifted(t).groupBy("domain").agg(r9(pearson("lift_nll", "lift_acc")).alias("r"))


@query("i3_gate_decision", LIFT + GATE + " select bool_or(verdict in ('strong_signal', 'usable_signal')) as proceed, count(*) as n_labels from gate where label in ('acc', 'nll')")
def i3(t):
    good = F.col("verdict").isin("strong_signal", "usable_signal")
    return gate_rows(t).filter("label in ('acc', 'nll')").agg(F.bool_or(good).alias("proceed"), F.count(F.lit(1)).alias("n_labels"))


WIDE = LIFT + """, wd as (select domain, candidate_id, max(lift_nll) filter (seed = 0) as s0, max(lift_nll) filter (seed = 1) as s1, max(lift_nll) filter (seed = 2) as s2, max(x3) filter (seed = 0) as pred from l group by 1, 2
  having count(*) filter (seed < 3) = 3)"""
RK = ", ".join(f"cast(row_number() over (partition by domain order by {c}, candidate_id) - 1 as double) as r_{c}" for c in ("s0", "s1", "s2"))
R1 = f""", rs as (select domain, {RK} from wd), rel as (select domain, count(*) as n, ({' + '.join(COR.format(x=f'r_s{a}', y=f'r_s{b}') for a, b in ((0, 1), (0, 2), (1, 2)))}) / 3 as r1 from rs group by 1)"""


def wide(t):
    return S.seed_columns(lifted(t), ["domain"], "candidate_id", "lift_nll", "x3")


def reliability(t):
    return S.seed_pairs(lifted(t), ["domain"], "candidate_id", "lift_nll")


@query("i4_seed_reliability", WIDE + R1 + " select domain, n, round(r1, 9) + 0.0::double as r1 from rel")
def i4(t):
    return reliability(t).select("domain", "n", r9("r1").alias("r1"))


@query(
    "i5_spearman_brown",
    WIDE + R1 + """ select domain, round(case when r1 > 0 then 3 * r1 / (1 + 2 * r1) else 0 end, 9) as rel3, round(sqrt(3 * greatest(r1, 1e-6) / (1 + 2 * greatest(r1, 1e-6))), 9) as ceiling from rel""",
)
def i5(t):
    r = F.col("r1")
    return reliability(t).select("domain", r9(S.spearman_brown(r, 3)).alias("rel3"), r9(F.sqrt(S.spearman_brown(r, 3, 1e-6))).alias("ceiling"))


MEANS = {"m0": "s0", "m1": "s1", "m2": "s2", "m3": "(s0 + s1) / 2", "m4": "(s0 + s2) / 2", "m5": "(s1 + s2) / 2", "m6": "(s0 + s1 + s2) / 3"}
PROJ = ", mm as (select domain, candidate_id, pred, " + ", ".join(f"{e} as {m}" for m, e in MEANS.items()) + " from wd), rm as (select domain, " + ", ".join(
    f"cast(row_number() over (partition by domain order by {c}, candidate_id) - 1 as double) as k_{c}" for c in ("pred", *MEANS)
) + " from mm), cc as (select domain, " + ", ".join(f"{COR.format(x='k_pred', y=f'k_{m}')} as c{i}" for i, m in enumerate(MEANS)) + " from rm group by 1)"


@query(
    "i6_seed_projection",
    WIDE + R1 + PROJ + """ select domain, k, round((c0 + c1 + c2) / 3, 9) + 0.0::double as rho1, round((c3 + c4 + c5) / 3, 9) + 0.0::double as rho2, round(c6, 9) + 0.0::double as rho3,
  round(least(1, c6 / sqrt(3 * greatest(r1, 1e-6) / (1 + 2 * greatest(r1, 1e-6)))) * sqrt(k * greatest(r1, 1e-6) / (1 + (k - 1) * greatest(r1, 1e-6))), 6) + 0.0::double as projected
from cc join rel using (domain), (values (1), (2), (3), (5), (8), (10)) q(k)""",
)
def i6(t):
    out = S.seed_projection(wide(t), ["domain"], "pred", "candidate_id", reliability(t), [1, 2, 3, 5, 8, 10])
    return out.select("domain", "k", *(r9(c).alias(c) for c in ("rho1", "rho2", "rho3")), (F.round("projected", 6) + 0.0).alias("projected"))


@query(
    "i7_crossfit_oracle",
    WIDE + """, f as (select domain, candidate_id as id, h as hold, case h when 0 then (s1 + s2) / 2 when 1 then (s2 + s0) / 2 else (s0 + s1) / 2 end as pred, case h when 0 then s0 when 1 then s1 else s2 end as truth,
  (s0 + s1 + s2) / 3 as a from wd, (values (0), (1), (2)) q(h)),
n as (select *, count(*) over (partition by domain, hold) as n, row_number() over (partition by domain, hold order by pred desc, id desc) as rp, row_number() over (partition by domain, hold order by a desc, id desc) as ra from f)
select domain, round(avg(truth) filter (rp <= greatest(1, round_even(n * 0.2::double, 0))), 9) as honest, round(avg(a) filter (hold = 0 and ra <= greatest(1, round_even(n * 0.2::double, 0))), 9) as naive,
  round(avg(a) filter (hold = 0), 9) + 0.0::double as random from n group by 1""",
)
def i7(t):
    out = S.crossfit_oracle(wide(t), ["domain"], "candidate_id", 0.2)
    return out.select("domain", *(r9(c).alias(c) for c in ("honest", "naive", "random")))


@query(
    "i8_parametric_oracle",
    WIDE + R1 + """, ms as (select domain, avg((s0 + s1 + s2) / 3) as m, stddev_pop((s0 + s1 + s2) / 3) as s from wd group by 1)
select domain, round(m + 1.3998 * sqrt(3 * greatest(r1, 1e-6) / (1 + 2 * greatest(r1, 1e-6))) * s, 9) + 0.0::double as oracle from ms join rel using (domain)""",
)
def i8(t):
    m3 = (F.col("s0") + F.col("s1") + F.col("s2")) / 3
    stats = wide(t).groupBy("domain").agg(F.avg(m3).alias("m"), F.stddev_pop(m3).alias("s")).join(reliability(t), "domain")
    return stats.select("domain", r9(S.parametric_oracle(F.col("m"), F.col("s"), F.col("r1"), 0.2)).alias("oracle"))


@query(
    "i9_partial_rank_corr",
    LIFT + f""", k as (select domain, cast(row_number() over (partition by domain order by x3, row_id) as double) as a, cast(row_number() over (partition by domain order by lift_nll, row_id) as double) as b,
  cast(row_number() over (partition by domain order by x1, row_id) as double) as c from l where x1 is not null),
q as (select domain, count(*) as n, {COR.format(x='a', y='b')} as ab, {COR.format(x='a', y='c')} as ac, {COR.format(x='b', y='c')} as bc from k group by 1)
select domain, n, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 9) + 0.0::double as partial from q""",
)
def i9(t):
    out = S.partial_rank_correlation(lifted(t).withColumnRenamed("row_id", "id"), ["domain"], "x3", "lift_nll", "x1")
    return out.select("domain", "n", r9("partial").alias("partial"))


@query(
    "i10_single_feature_screen",
    FX + f""", lg as (select feature, domain, row_id, y, x from (unpivot (select row_id, domain, lift_nll as y, {', '.join(f'round(cast({k} as double), 9) as {k}' for k in ALL)} from fx) on {', '.join(ALL)} into name feature value x)),
bo as (select feature, unnest([domain, 'POOLED']) as domain, row_id, x, y from lg),
a as (select *, cast(row_number() over (partition by feature, domain order by x, row_id) as double) as rx, cast(row_number() over (partition by feature, domain order by y, row_id) as double) as ry from bo),
c as (select feature, domain, count(*) as n, {COR.format(x='rx', y='ry')} as s from a group by 1, 2 having count(*) > 5), m as (select feature, cast(sum(n) as bigint) as n, avg(s) as s from c where domain <> 'POOLED' group by 1),
pl as (select feature, cast(row_number() over (order by round(abs(s), 9) desc, feature) as int) as place from m)
select feature, domain, n, round(s, 9) + 0.0::double as spearman, place from (select * from c union all select feature, 'AVERAGE', n, s from m) left join pl using (feature)""",
)
def i10(t):
    data = L.build_xy(featured(t), ["row_id", "domain"], "nll")
    data = data.withColumns({k: F.round(k, 9) for k in ALL})  # equal to nine decimals is a tie
    return S.feature_screen(data, ALL, "y", "domain", "row_id").withColumn("spearman", r9("spearman"))


@query(
    "i11_dose_response",
    LIFT + """, d as (select row_id, case when row_id % 3 = 0 then left(kind, 1)::double / 4 - 0.25 when row_id % 3 = 1 then cast(regexp_extract(printf('labelnoise-%03d-001', (left(kind, 1)::int - 1) * 25), '^labelnoise-([0-9]+)', 1) as double) / 100 end as dose,
  lift_nll - left(kind, 1)::double / 20 as lift, x1, x2, x3, acc_after from l),
p as (select dose, count(*) as n, avg(lift) as m, stddev_pop(lift) as s, avg(coalesce(x1, 0)) as a, avg(x2) as b, avg(x3) as c, avg(acc_after) as e from d where dose is not null group by 1),
r as (select *, coalesce(m > lag(m) over (order by dose) + 1e-9, false) as rises from p),
k as (select cast(row_number() over (order by dose, row_id) as double) as rd, cast(row_number() over (order by lift, row_id) as double) as rl from d where dose is not null), q as (select """
    + COR.format(x="rd", y="rl")
    + """ as rho from k)
select dose, n, round(m, 9) + 0.0::double as mean_lift, round(s, 9) as sd_lift, round(a, 9) + 0.0::double as mean_x1, round(b, 9) as mean_x2, round(c, 9) as mean_x3, round(e, 9) as mean_acc_after, rises, not bool_or(rises) over () as non_increasing,
  round(rho, 9) + 0.0::double as spearman, case when rho < -0.3 then 'confirmed' else 'weak_or_absent' end as verdict from r, q""",
)
def i11(t):
    """A third of the cohorts state their dose, a third have it in their name, the others have none."""
    step, third = F.substring("kind", 1, 1).cast("int"), F.col("row_id") % 3
    stated = F.when(third == 0, step.cast("double") / 4 - 0.25)
    name = F.when(third == 1, F.format_string("labelnoise-%03d-001", (step - 1) * 25)).otherwise("random-001")
    rows = lifted(t).withColumns({"dose": S.dose_of(stated, name), "lift": F.col("lift_nll") - step.cast("double") / 20})
    out = S.dose_response(rows, "dose", "lift", ["x1", "x2", "x3", "acc_after"], "row_id")
    plain = ("dose", "n", "rises", "non_increasing", "verdict")
    return out.select(*(c if c in plain else r9(c).alias(c) for c in out.columns))


PCT = LIFT + """, pc as (select *, (row_number() over (partition by domain order by lift_nll, row_id) - 1)::double / greatest(count(*) over (partition by domain) - 1, 1) as pct from l)"""


def percentiles(t):
    return S.within_percentile(lifted(t), ["domain"], "lift_nll", "row_id")


@query(
    "i12_tercile_effects",
    PCT + """, lg as (select pct >= 2.0::double / 3 as hi, f as feature, case f when 'x1' then x1 when 'x2' then x2 else x3 end as x from pc, (values ('x1'), ('x2'), ('x3')) q(f) where pct >= 2.0::double / 3 or pct <= 1.0::double / 3)
select feature, round((avg(x) filter (hi) - avg(x) filter (not hi)) / sqrt((var_pop(x) filter (hi) + var_pop(x) filter (not hi)) / 2), 9) + 0.0::double as d, count(x) filter (hi) as n_high, count(x) filter (not hi) as n_low
from lg where x is not null group by 1""",
)
def i12(t):
    return S.tercile_effects(percentiles(t).select("pct", "x1", "x2", "x3"), ["x1", "x2", "x3"]).select("feature", r9("d").alias("d"), "n_high", "n_low")


@query(
    "i13_kind_mix",
    PCT + """, s as (select kind, case when pct >= 2.0::double / 3 then 'HIGH' when pct <= 1.0::double / 3 then 'LOW' end as side from pc)
select side, kind, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by side), 9) as share from s where side is not null group by 1, 2""",
)
def i13(t):
    side = F.when(F.col("pct") >= 2 / 3, "HIGH").when(F.col("pct") <= 1 / 3, "LOW")
    counts = percentiles(t).select("kind", side.alias("side")).filter("side is not null").groupBy("side", "kind").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("side").agg(F.sum("n").alias("total"))
    return counts.join(totals, "side").select("side", "kind", "n", r9(F.col("n") / F.col("total")).alias("share"))


@query("i14_within_domain_percentile", PCT + " select row_id, round(pct, 9) as pct from pc")
def i14(t):
    return percentiles(t).select("row_id", r9("pct").alias("pct"))


@query(
    "i15_domain_summary",
    LIFT + """ select domain, count(*) as n, round(avg(acc_before), 9) as acc_before, count(*) filter (abs(lift_acc) > 1e-6) as nonzero, round(min(lift_nll), 9) + 0.0::double as min_lift, round(max(lift_nll), 9) as max_lift from l group by 1""",
)
def i15(t):
    return lifted(t).groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), r9(F.avg("acc_before")).alias("acc_before"), F.count_if(F.abs("lift_acc") > 1e-6).alias("nonzero"), r9(F.min("lift_nll")).alias("min_lift"), r9(F.max("lift_nll")).alias("max_lift")
    )


@query(
    "i16_pooled_report",
    LIFT + f" select coalesce(domain, 'POOLED') as domain, count(*) as n, round(avg(lift_nll), 9) + 0.0::double as mean_lift, round({COR.format(x='x3', y='lift_nll')}, 9) + 0.0::double as r from l group by grouping sets ((domain), ())",
)
def i16(t):
    out = lifted(t).groupingSets([["domain"], []], "domain").agg(F.count(F.lit(1)).alias("n"), F.avg("lift_nll").alias("m"), pearson("x3", "lift_nll").alias("r"))
    return out.select(F.coalesce("domain", F.lit("POOLED")).alias("domain"), "n", r9("m").alias("mean_lift"), r9("r").alias("r"))
