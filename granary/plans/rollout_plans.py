"""Queries over rollouts and token arrays."""

from pyspark.sql import functions as F

from granary.functions.exprs import clean, r9, ratio
from granary.operators import rollouts as R

from .base import query

KEYS = ["candidate_id", "seed"]
GROUP = ["candidate_id", "seed", "group_id"]

# Arrays of tokens for the queries: one completion for each order, its lines being tokens.
ARRAYS = """tok as (select l_orderkey as id, list_sort(list(cast(l_partkey % 50 as int))) as ids, list_sort(list(round(-l_discount * 10, 4))) as lp,
  list_sort(list(round(-l_tax * 10, 4))) as lp_old, list_sort(list(round(-l_quantity / 10, 4))) as lp_ref from lineitem group by l_orderkey)"""


def token_rows(t):
    agg = lambda e: F.array_sort(F.collect_list(e))
    lines = t["lineitem"]
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(
        agg((F.col("l_partkey") % 50).cast("int")).alias("ids"),
        agg(F.round(-F.col("l_discount") * 10, 4)).alias("lp"),
        agg(F.round(-F.col("l_tax") * 10, 4)).alias("lp_old"),
        agg(F.round(-F.col("l_quantity") / 10, 4)).alias("lp_ref"),
    )


ADV = """, g as (select candidate_id, seed, group_id, avg(reward) as m, stddev_pop(reward) as s from v_rollouts group by 1, 2, 3),
adv as (select r.*, case when s > 1e-9 then (reward - m) / (s + 1e-8) else 0.0 end as advantage from v_rollouts r join g using (candidate_id, seed, group_id))"""


@query(
    "d2_group_advantages",
    ADV + """ select candidate_id, seed, group_id, comp_hash, reward, completion_tokens, mean_logprob, round(advantage, 9) + 0.0::double as advantage from adv""",
)
def d2(t):
    return R.group_advantages(t.rollouts, GROUP).select(*GROUP, "comp_hash", "reward", "completion_tokens", "mean_logprob", r9("advantage").alias("advantage"))


def _half(name):
    return f"list_avg(lp[1:greatest(len(lp) // 2, 1)]) as {name}"


@query(
    "d3_token_logprob_stats",
    ", " + ARRAYS + """ select id, round(list_avg(lp), 9) + 0.0::double as mean_logprob, round(list_avg(lp[1:greatest(len(lp) // 2, 1)]), 9) + 0.0::double as early_logprob,
  round(coalesce(list_avg(lp[greatest(len(lp) // 2, 1) + 1:]), 0), 9) + 0.0::double as late_logprob, list_min(lp) + 0.0::double as min_logprob from tok""",
)
def d3(t):
    stats = R.token_stats("lp")
    return token_rows(t).select("id", *(r9(c).alias(n) for n, c in stats.items()))


D4_NAMES = (
    "n_rollouts n_groups reward_mean reward_std pass_rate group_passrate_mean group_passrate_std frac_nondegenerate frac_all_correct frac_all_wrong mean_logprob "
    "surprisal_mean entropy_mean logprob_p10 logprob_p50 logprob_p90 confidence_slope redundancy_mean min_logprob_mean len_mean len_std len_max len_cv adv_std adv_absmean "
    "reward_gap distinct_frac"
).split()
D4_BODY = ADV + """, gg as (select candidate_id, seed, group_id, count(*) as n, avg(case when reward > 0.5 then 1.0 else 0.0 end) as p, stddev_pop(reward) as s,
  min(case when reward > 0.5 then 1 else 0 end) as al, max(case when reward > 0.5 then 1 else 0 end) as an from v_rollouts group by 1, 2, 3),
g2 as (select candidate_id, seed, count(*) as n_groups, avg(p) filter (n >= 2) as group_passrate_mean, stddev_pop(p) filter (n >= 2) as group_passrate_std,
  avg(case when s > 1e-9 then 1.0 else 0.0 end) filter (n >= 2) as frac_nondegenerate, avg(al) filter (n >= 2) as frac_all_correct, avg(1 - an) filter (n >= 2) as frac_all_wrong
  from gg group by 1, 2),
rr as (select candidate_id, seed, count(*) as n_rollouts, avg(reward) as reward_mean, stddev_pop(reward) as reward_std, avg(case when reward > 0.5 then 1.0 else 0.0 end) as pass_rate,
  avg(mean_logprob) as mean_logprob, -avg(mean_logprob) as surprisal_mean, cast(null as double) as entropy_mean, quantile_cont(mean_logprob, 0.1) as logprob_p10,
  quantile_cont(mean_logprob, 0.5) as logprob_p50, quantile_cont(mean_logprob, 0.9) as logprob_p90, avg(late_logprob) - avg(early_logprob) as confidence_slope,
  avg(exp(mean_logprob)) as redundancy_mean, avg(min_logprob) as min_logprob_mean, avg(completion_tokens) as len_mean, stddev_pop(completion_tokens) as len_std,
  max(completion_tokens) as len_max, stddev_pop(completion_tokens) / (avg(completion_tokens) + 1e-9) as len_cv, stddev_pop(advantage) as adv_std, avg(abs(advantage)) as adv_absmean,
  max(reward) - min(reward) as reward_gap, count(distinct comp_hash)::double / count(comp_hash) as distinct_frac from adv group by 1, 2)"""


def features(t):
    return R.summarize_rollouts(t.rollouts, KEYS, advantages=True)


@query(
    "d4_summarize_rollouts",
    D4_BODY + " select candidate_id, seed, n_rollouts, n_groups, " + ", ".join(f"round({c}, 9) + 0.0::double as {c}" for c in D4_NAMES[2:]) + " from rr join g2 using (candidate_id, seed)",
)
def d4(t):
    return features(t).select(*KEYS, "n_rollouts", "n_groups", *(r9(c).alias(c) for c in D4_NAMES[2:]))


@query("d5_quantile", " select candidate_id, round(quantile_cont(completion_tokens, 0.25), 9) as q25, round(quantile_cont(completion_tokens, 0.95), 9) as q95 from v_rollouts group by 1")
def d5(t):
    return t.rollouts.groupBy("candidate_id").agg(*(r9(F.percentile("completion_tokens", F.lit(p))).alias(n) for n, p in (("q25", 0.25), ("q95", 0.95))))


@query(
    "d6_confidence_slope",
    """, h as (select candidate_id, early_logprob as e, case when completion_tokens = 1 then null else late_logprob end as l from v_rollouts)
select candidate_id, round(case when count(e) = count(l) then avg(l) - avg(e) end, 9) + 0.0::double as confidence_slope from h group by 1""",
)
def d6(t):
    rows = t.rollouts.select("candidate_id", F.col("early_logprob").alias("e"), F.when(F.col("completion_tokens") != 1, F.col("late_logprob")).alias("l"))
    return rows.groupBy("candidate_id").agg(r9(F.when(F.count("e") == F.count("l"), F.avg("l") - F.avg("e"))).alias("confidence_slope"))


@query("d7_distinct_frac", " select candidate_id, seed, round(count(distinct comp_hash)::double / count(comp_hash), 9) as distinct_frac from v_rollouts group by 1, 2")
def d7(t):
    return R.distinct_fraction(t.rollouts, KEYS, "comp_hash").select(*KEYS, r9("distinct_frac").alias("distinct_frac"))


@query(
    "d8_advantage_spread",
    ADV + """ select candidate_id, seed, round(stddev_pop(advantage), 9) as adv_std, round(avg(abs(advantage)), 9) as adv_absmean, round(avg(min_logprob), 9) + 0.0::double as min_logprob_mean
from adv group by 1, 2""",
)
def d8(t):
    adv = R.group_advantages(t.rollouts, GROUP)
    return adv.groupBy(*KEYS).agg(r9(F.stddev_pop("advantage")).alias("adv_std"), r9(F.avg(F.abs("advantage"))).alias("adv_absmean"), r9(F.avg("min_logprob")).alias("min_logprob_mean"))


@query(
    "d9_engineered_features",
    ", " + ARRAYS + """, k as (select id % 97 as grp, * from tok),
p as (select grp, stddev_pop(x) as tok_std, min(x) as tok_min, exp(-avg(x)) as perplexity from (select grp, unnest(lp) as x from k) group by 1),
c as (select grp, id, len, tk, count(*) as c from (select grp, id, len(ids) as len, unnest(ids) as tk from k) group by 1, 2, 3, 4),
m as (select grp, avg(top) as max_tok_rep from (select grp, id, max(c)::double / max(len) as top from c group by 1, 2) group by 1),
r as (select grp, avg(case when len(ids) > 4 then 1.0 else 0.0 end) as frac_long, count(distinct md5(array_to_string(ids, ',')))::double / count(*) as distinct_frac from k group by 1)
select grp, round(tok_std, 9) as tok_std, tok_min + 0.0::double as tok_min, round(perplexity, 9) as perplexity, round(max_tok_rep, 9) as max_tok_rep, round(frac_long, 9) as frac_long,
  round(distinct_frac, 9) as distinct_frac from p join m using (grp) join r using (grp)""",
)
def d9(t):
    rows = token_rows(t).withColumn("grp", F.col("id") % 97)
    out = R.engineered_features(rows, ["grp"], "id", "ids", "lp", long=4)
    return out.select("grp", *(r9(c).alias(c) for c in ("tok_std", "tok_min", "perplexity", "max_tok_rep", "frac_long", "distinct_frac")))


WORDS = """, w as (select source as bag, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents),
c as (select bag, token, count(*) as c from w group by 1, 2), u as (select bag, token, c::double / sum(c) over (partition by bag) as p from c)"""


@query("d10_unigrams", WORDS + " select bag, token, round(p, 9) as p from u")
def d10(t):
    return R.unigrams(t["documents"].select(F.col("source").alias("bag"), "text"), ["bag"], "text").select("bag", "token", r9("p").alias("p"))


PROBE = """, bw as (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from benchmark),
pr as (select token, count(*)::double / (select count(*) from bw) as q from bw group by 1)"""


@query(
    "d11_cosine",
    WORDS + PROBE + """, d as (select bag, coalesce(sum(p * q), 0) as dot, sqrt(sum(p * p)) as na from u left join pr using (token) group by 1)
select bag, round(dot / (na * (select sqrt(sum(q * q)) from pr) + 1e-9), 9) as similarity from d""",
)
def d11(t):
    bags = R.unigrams(t["documents"].select(F.col("source").alias("bag"), "text"), ["bag"], "text")
    probe = R.unigrams(t["benchmark"].select(F.lit(0).alias("bag"), "text"), ["bag"], "text").select("token", "p")
    return R.cosine_to_probe(bags, probe, ["bag"]).select("bag", r9("similarity").alias("similarity"))


@query(
    "d12_target_similarity",
    """, m as (select cast(doc_id % 37 as int) as cohort, text from documents union all select cast(doc_id % 37 as int), text from documents where doc_id % 5 = 0),
w as (select cohort as bag, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from m),
c as (select bag, token, count(*) as c from w group by 1, 2), u as (select bag, token, c::double / sum(c) over (partition by bag) as p from c)""" + PROBE
    + """, d as (select bag, coalesce(sum(p * q), 0) as dot, sqrt(sum(p * p)) as na from u left join pr using (token) group by 1)
select bag as cohort, round(dot / (na * (select sqrt(sum(q * q)) from pr) + 1e-9), 9) as target_similarity from d""",
)
def d12(t):
    docs = t["documents"].select((F.col("doc_id") % 37).cast("int").alias("cohort"), "doc_id", "text")
    members = docs.unionByName(docs.filter("doc_id % 5 = 0"))  # members may repeat and count each time
    bags = R.unigrams(members, ["cohort"], "text")
    probe = R.unigrams(t["benchmark"].select(F.lit(0).alias("bag"), "text"), ["bag"], "text").select("token", "p")
    return R.cosine_to_probe(bags, probe, ["cohort"]).select("cohort", r9("similarity").alias("target_similarity"))


@query("d13_probe_accuracy", " select candidate_id, seed, round(avg(reward), 9) as accuracy, count(*) as n from v_rollouts group by 1, 2")
def d13(t):
    return t.rollouts.groupBy(*KEYS).agg(r9(F.avg("reward")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("d14_probe_nll", " select candidate_id, seed, round(sum(-mean_logprob * completion_tokens) / sum(completion_tokens), 9) as nll from v_rollouts group by 1, 2")
def d14(t):
    rows = t.rollouts.withColumn("loss", -F.col("mean_logprob"))
    return R.token_weighted_nll(rows, KEYS, "loss", "completion_tokens").select(*KEYS, r9("nll").alias("nll"))


@query(
    "d15_kl_drift_probe",
    """, e as (select label, list_transform(embedding, lambda x: exp(cast(x as double))) as a, list_transform(list_reverse(embedding), lambda x: exp(cast(x as double))) as b from embeddings),
n as (select label, list_transform(a, lambda x: x / list_sum(a)) as p, list_transform(b, lambda x: x / list_sum(b)) as q from e)
select label, round(sum(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * (ln(z[1]) - ln(z[2]))))) / count(*), 9) + 0.0::double as kl from n group by 1""",
)
def d15(t):
    add = lambda s, x: s + x
    e = t["embeddings"].select("label", F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("a"))
    e = e.select("label", "a", F.reverse("a").alias("b"), F.aggregate("a", F.lit(0.0), add).alias("z"))
    n = e.select("label", F.transform("a", lambda x: x / F.col("z")).alias("p"), F.transform("b", lambda x: x / F.col("z")).alias("q"))
    return n.groupBy("label").agg(r9(F.sum(R.kl_positions(F.col("p"), F.col("q"))) / F.count(F.lit(1))).alias("kl"))


@query(
    "d16_reward_summary",
    """, e as (select event_type, case when event_id % 3 = 0 then null else value end as reward, value * 2 as score, case when event_id % 2 = 0 then cast(event_id % 100 as double) end as completion_tokens,
  cast(user_id % 50 as double) as tokens from events)
select event_type, count(*) as n_rows, round(avg(coalesce(reward, score)), 9) as mean_reward, round(avg(coalesce(completion_tokens, tokens)), 9) as mean_tokens from e group by 1""",
)
def d16(t):
    e = t["events"].select(
        "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("reward"), (F.col("value") * 2).alias("score"),
        F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 100).cast("double")).alias("completion_tokens"), (F.col("user_id") % 50).cast("double").alias("tokens"),
    )
    return R.reward_summary(e, ["event_type"]).select("event_type", "n_rows", r9("mean_reward").alias("mean_reward"), r9("mean_tokens").alias("mean_tokens"))


@query(
    "d17_policy_loss",
    ", " + ARRAYS + """, z as (select id, case when id % 2 = 0 then 1.0 else -0.5 end as a, list_zip(lp, lp_old, lp_ref[1:greatest(len(lp_ref) - 1, 1)], true) as z from tok),
l as (select id, list_avg(list_transform(z, lambda t: -least(exp(t[1] - t[2]) * a, least(greatest(exp(t[1] - t[2]), 0.8), 1.2) * a) + 0.04 * (exp(t[3] - t[1]) - (t[3] - t[1]) - 1))) as loss,
  list_avg(list_transform(z, lambda t: case when abs(exp(t[1] - t[2]) - 1) > 0.2 then 1.0 else 0.0 end)) as clipped from z)
select id % 97 as grp, round(avg(loss), 5) + 0.0::double as loss, round(avg(clipped), 9) as clipped, count(*) as n from l group by 1""",
)
def d17(t):
    rows = token_rows(t).withColumns({"a": F.when(F.col("id") % 2 == 0, 1.0).otherwise(-0.5), "ref": F.slice("lp_ref", F.lit(1), F.greatest(F.size("lp_ref") - 1, F.lit(1)))})
    loss, clipped = R.policy_loss(F.col("lp"), F.col("lp_old"), F.col("ref"), F.col("a"))
    rows = rows.select((F.col("id") % 97).alias("grp"), loss.alias("loss"), clipped.alias("clipped"))
    return rows.groupBy("grp").agg((F.round(F.avg("loss"), 5) + 0.0).alias("loss"), r9(F.avg("clipped")).alias("clipped"), F.count(F.lit(1)).alias("n"))


@query(
    "d18_active_rollouts",
    ADV + " select candidate_id, seed, count(*) filter (advantage <> 0 and completion_tokens > 0) as n_contrib, round(coalesce(avg(reward), 0), 9) as mean_reward from adv group by 1, 2",
)
def d18(t):
    adv = R.group_advantages(t.rollouts, GROUP)
    active = (F.col("advantage") != 0) & (F.col("completion_tokens") > 0)
    return adv.groupBy(*KEYS).agg(F.count_if(active).alias("n_contrib"), r9(F.coalesce(F.avg("reward"), F.lit(0.0))).alias("mean_reward"))


@query("d19_truncate_at_end", ", " + ARRAYS + " select id, ids[1:coalesce(nullif(list_position(ids, 7), 0), len(ids))] as ids from tok")
def d19(t):
    return token_rows(t).select("id", R.truncate_after(F.col("ids"), 7).alias("ids"))


@query(
    "d20_encode_window",
    ", " + ARRAYS + """, w as (select id, ids[1:2] as prompt, list_concat(ids[1:2], ids[3:])[1:5] as win from tok)
select id, win as ids, cast(greatest(len(win) - len(prompt), 0) as int) as n_target from w where len(win) > len(prompt)""",
)
def d20(t):
    n = F.size("ids")
    rows = token_rows(t).select("id", F.slice("ids", 1, 2).alias("p"), F.slice("ids", F.lit(3), F.greatest(n - 2, F.lit(0))).alias("c"))
    ids, targets = R.encode_window(F.col("p"), F.col("c"), 5)
    return rows.select("id", ids.alias("ids"), targets.alias("n_target")).filter("n_target > 0")


@query("d21_fingerprint", " select candidate_id, round(avg(-mean_logprob), 9) as fingerprint_nll, round(avg(-early_logprob), 9) + 0.0::double as fingerprint_entropy from v_rollouts group by 1")
def d21(t):
    return t.rollouts.groupBy("candidate_id").agg(r9(F.avg(-clean("mean_logprob"))).alias("fingerprint_nll"), r9(F.avg(-clean("early_logprob"))).alias("fingerprint_entropy"))


@query(
    "d22_rollout_cost",
    """, c as (select candidate_id, seed, count(*) + 2 * 128 as cost from v_rollouts group by 1, 2)
select candidate_id, seed, cost, cast(sum(cost) over (partition by candidate_id order by seed) as bigint) as running from c""",
)
def d22(t):
    from pyspark.sql import Window as W

    c = t.rollouts.groupBy(*KEYS).agg((F.count(F.lit(1)) + 2 * 128).alias("cost"))
    return c.withColumn("running", F.sum("cost").over(W.partitionBy("candidate_id").orderBy("seed").rowsBetween(W.unboundedPreceding, 0)))
