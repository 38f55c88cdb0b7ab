"""Queries of ranking and selection metrics."""

from pyspark.sql import functions as F

from granary.functions.exprs import pearson, r9, ratio
from granary.operators import bootstrap as B, metrics as M
from granary.sources.scratch import stored

from .base import query

COR = "case when count(*) >= 2 and stddev_pop({x}) > 1e-9 and stddev_pop({y}) > 1e-9 then covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) else 0 end"


@query("h1_pearson", f" select grp, round({COR.format(x='pred', y='truth')}, 9) + 0.0::double as pearson from v_predictions group by 1")
def h1(t):
    return t.predictions.groupBy("grp").agg(r9(pearson("pred", "truth")).alias("pearson"))


RANKS = """, rk as (select *, cast(row_number() over (partition by grp order by pred, id) - 1 as double) as rp, cast(row_number() over (partition by grp order by truth, id) - 1 as double) as ry from v_predictions)"""


@query(
    "h2_rank",
    RANKS + """ select id, rp as rk_pred, ry as rk_truth, rank() over (partition by grp order by bin) - 1 + (count(*) over (partition by grp, bin) - 1) / 2.0 as rk_bin
from (select *, floor(pred) as bin from rk)""",
)
def h2(t):
    rows = t.predictions.withColumn("bin", F.floor("pred"))
    return M.ranked(M.ranked(rows, ["grp"], ["pred", "truth"]), ["grp"], ["bin"], ties="average").select("id", "rk_pred", "rk_truth", "rk_bin")


@query("h3_spearman", RANKS + f" select grp, count(*) as n, round({COR.format(x='rp', y='ry')}, 9) + 0.0::double as spearman from rk group by 1")
def h3(t):
    return M.spearman(t.predictions, ["grp"]).select("grp", "n", r9("spearman").alias("spearman"))


@query(
    "h4_errors",
    """ select grp, round(sqrt(avg((pred - truth) * (pred - truth))), 9) as rmse, round(avg(abs(pred - truth)), 9) as mae,
  round(case when stddev_pop(truth) > 1e-3 then 1 - sum((pred - truth) * (pred - truth)) / (var_pop(truth) * count(*) + 1e-12) end, 3) as r2_oos from v_predictions group by 1""",
)
def h4(t):
    # of flat groups, where r2 is a ratio to 1e-12, only the errors are shown: the engines' rounding errors would differ
    out = t.predictions.groupBy("grp").agg(*M.error_columns(), F.stddev_pop("truth").alias("s"))
    return out.select("grp", r9("rmse").alias("rmse"), r9("mae").alias("mae"), F.round(F.when(F.col("s") > 1e-3, F.col("r2_oos")), 3).alias("r2_oos"))


@query(
    "h5_sign_accuracy",
    """ select grp, round(avg(case when (case when pred - 1.5 > 0.1 then 1 when pred - 1.5 < -0.1 then -1 else 0 end) = (case when truth > 0.01 then 1 when truth < -0.01 then -1 else 0 end) then 1.0 else 0.0 end), 9) as sign_accuracy
from v_predictions group by 1""",
)
def h5(t):
    same = M.sign3(F.col("pred") - 1.5, 0.1) == M.sign3(F.col("truth"), 0.01)
    return t.predictions.groupBy("grp").agg(r9(F.avg(same.cast("double"))).alias("sign_accuracy"))


@query(
    "h6_within_group_spearman",
    RANKS + f", s as (select grp, {COR.format(x='rp', y='ry')} as s from rk group by 1 having count(*) >= 2) select round(coalesce(avg(s), 0), 9) as within_spearman, count(*) as n_groups from s",
)
def h6(t):
    return M.within_group_spearman(t.predictions).select(r9("within_spearman").alias("within_spearman"), "n_groups")


PAIRS = """, pr as (select a.grp, a.pred - b.pred as dp, a.truth - b.truth as dy from v_predictions a join v_predictions b on a.grp = b.grp and a.id < b.id)"""


@query("h7_pairwise_accuracy", PAIRS + " select grp, count(*) filter (dp * dy > 0) as right_pairs, count(*) filter (dy <> 0) as pairs from pr group by 1")
def h7(t):
    return M.concordance(t.predictions, ["grp"]).filter("all_pairs > 0").select("grp", F.col("right").alias("right_pairs"), "pairs")


@query(
    "h8_top1_regret",
    """, r as (select grp, max(truth) - arg_min(truth, row(-pred, id)) as regret from v_predictions group by 1) select round(avg(regret), 9) as top1_regret, count(*) as n_groups from r""",
)
def h8(t):
    return M.top1_regret(t.predictions).select(r9("top1_regret").alias("top1_regret"), "n_groups")


PICKS = """, n as (select *, count(*) over (partition by grp) as n, row_number() over (partition by grp order by pred desc, id desc) as rp, row_number() over (partition by grp order by truth desc, id desc) as ry from v_predictions)"""


@query("h9_topk_picks", PICKS + " select id, grp from n where rp <= greatest(1, round_even(n * 0.25::double, 0))")
def h9(t):
    return M.top_picks(t.predictions, ["grp"], 0.25).select("id", "grp")


@query(
    "h10_selection_lift",
    PICKS + """, m as (select avg(truth) as model from n where rp <= greatest(1, round_even(n * 0.25::double, 0))),
o as (select avg(o) as oracle, avg(r) as random from (select grp, avg(truth) filter (ry <= greatest(1, round_even(n * 0.25::double, 0))) as o, avg(truth) as r from n group by 1))
select round(model, 9) as model, round(random, 9) as random, round(oracle, 9) as oracle, round(model - random, 9) as lift, round((model - random) / (oracle - random), 9) as frac_of_oracle from m, o""",
)
def h10(t):
    out = M.selection_lift(t.predictions)
    return out.select(*(r9(c).alias(c) for c in out.columns))


# a row's weight in a replicate: its number and the replicate's, mixed, then steps of the Poisson distribution
_MIXED = "((xor({x}, {x} >> 16)) * 73244475) % 4294967296"
_STEPS = " ".join(f"when u < {step} then {k}" for k, step in enumerate(B.STEPS))
WEIGHTED = f""", r0 as (select domain, v, cast(concat('0x', substr(md5(concat('7:', domain, ':', id)), 1, 8)) as bigint) as num from b),
r1 as (select domain, v, rep, {_MIXED.format(x="((num + rep * 2654435769) % 4294967296)")} as x from r0, range(0, 2000) q(rep)),
r2 as (select domain, v, rep, ({_MIXED.format(x="x")}) >> 16 as u from r1), w as (select domain, v, rep, case {_STEPS} else {len(B.STEPS)} end as w from r2)"""
BY_DOMAIN = ", b as (select p.*, d.domain, {v} as v from v_predictions p join v_labels d on p.id = d.row_id)"


def _interval(out, keys=("domain",)):
    return out.select(*keys, "n", *(r9(c).alias(c) for c in ("point", "low", "high")), "replicates")


def _boot_rows(t):
    return t.predictions.join(t.labels.select(F.col("row_id").alias("id"), "domain"), "id")


def _interval_sql(stat: str, point: str, keys: str = "domain") -> str:
    by = ", ".join(str(i + 1) for i in range(len(keys.split(", "))))
    return f"{stat}, pt as (select {keys}, count(*) as n, {point} as point from b group by {by}) select {keys}, any_value(n) as n, round(any_value(point), 9) as point, round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high, count(*) as replicates from mm join pt using ({keys}) group by {by}"


MEANS = ", mm as (select domain, rep, sum(w * v) / sum(w) as m from w group by 1, 2)"
MEDIANS = """, cu as (select domain, rep, v, sum(w) over (partition by domain, rep order by v) as upto, sum(w) over (partition by domain, rep) as total from w where w > 0),
mm as (select domain, rep, (min(v) filter (upto > floor((total - 1) / 2.0)) + min(v) filter (upto > ceil((total - 1) / 2.0))) / 2 as m from cu group by 1, 2)"""


def _drawn_sql(keys: str) -> str:
    """Rows of b (keys, id, v): the means of n draws with replacement from the n rows of a key, 2,000 times.

    A replicate's draws are shared out among blocks of 65,536 rows, in which each share is then drawn.
    """
    text = "concat('7:', " + "".join(f"{k}, ':', " for k in keys.split(", "))
    seeds = ", ".join(f"cast(concat('0x', substr(md5({text}rep, {{of}})), {at}, 8)) as bigint) as k{i}" for i, at in ((1, 1), (2, 9)))
    mixed = lambda name, source: f"""{name}1 as (select * exclude (e, k1), {_MIXED.format(x="((k1 + e * 2654435769) % 4294967296)")} as x from {source}),
{name}2 as (select * exclude (x, k2), xor(x, k2) as x from {name}1), {name} as (select * exclude (x), ({_MIXED.format(x="x")})::double / 4294967296::double as u from {name}2)"""  # noqa: E731
    return f""", num as (select {keys}, v, row_number() over (partition by {keys} order by id) - 1 as i from b), sz as (select {keys}, count(*) as n from b group by all),
ch as (select {keys}, n, rep, c, {seeds.format(of="':draws:', c")} from (select {keys}, n, rep, unnest(range(0, (n + 65535) // 65536)) as c from sz, range(0, 2000) r(rep) where n > 65536)),
de as (select {keys}, n, rep, k1, k2, unnest(range(0, least(65536, n - c * 65536))) as e from ch), {mixed("dm", "de")},
sh as (select {keys}, n, rep, cast(floor(u * n) as bigint) // 65536 as blk, count(*) as c from dm group by all union all select {keys}, n, rep, 0 as blk, n as c from sz, range(0, 2000) r(rep) where n <= 65536),
be as (select {keys}, rep, blk, least(65536, n - blk * 65536) as m, {seeds.format(of="':rows:', blk")}, unnest(range(0, c)) as e from sh), {mixed("bm", "be")},
pk as (select {keys}, rep, blk * 65536 + cast(floor(u * m) as bigint) as i from bm), mm as (select {keys}, rep, avg(v) as m from pk join num using ({keys}, i) group by all)"""


@query("h11_bootstrap_ci", BY_DOMAIN.format(v="truth") + _drawn_sql("domain") + _interval_sql("", "avg(v)"), ("v_labels", "v_predictions"))
def h11(t):
    return _interval(B.bootstrap_ci(_boot_rows(t), ["domain"], ["truth"], "mean", seed=7, exact=True))


@query("h11_bootstrap_median", BY_DOMAIN.format(v="truth") + WEIGHTED + _interval_sql(MEDIANS, "median(v)"), ("v_labels", "v_predictions"))
def h11m(t):
    return _interval(B.bootstrap_ci(_boot_rows(t), ["domain"], ["truth"], "median", seed=7))


@query(
    "h12_paired_bootstrap_ci",
    """, g as (select p.*, d.domain, row_number() over (partition by d.domain, grp order by pred desc, id desc) as rn, count(*) over (partition by d.domain, grp) as size from v_predictions p join v_labels d on p.id = d.row_id),
b as (select domain, 'rows' as paired, cast(id as varchar) as id, truth - pred as v from g union all
  select domain, 'candidates', grp, avg(truth) filter (rn <= greatest(1, round_even(size * 0.25, 0))) - avg(truth) from g group by domain, grp)"""
    + _drawn_sql("domain, paired")
    + _interval_sql("", "avg(v)", "domain, paired"),
    ("v_labels", "v_predictions"),
)
def h12(t):
    """Paired by row, truth less prediction; by candidate, what picking its best quarter by prediction gains over picking at random."""
    rows = stored(_boot_rows(t), "bootstrap-pairs")
    picked = M.top_picks(rows, ["domain", "grp"], 0.25).groupBy("domain", "grp").agg(F.avg("truth").alias("value"))
    chance = rows.groupBy("domain", "grp").agg(F.avg("truth").alias("value"))
    by_row = lambda value: rows.select("domain", F.lit("rows").alias("paired"), F.col("id").cast("string").alias("unit"), F.col(value).alias("value"))
    by_candidate = lambda arm: arm.select("domain", F.lit("candidates").alias("paired"), F.col("grp").alias("unit"), "value")
    a, b = by_row("truth").unionByName(by_candidate(picked)), by_row("pred").unionByName(by_candidate(chance))
    return _interval(B.paired_bootstrap_ci(a, b, ["domain", "paired"], "unit", "value", seed=7, exact=True), ["domain", "paired"])


@query(
    "h11_poisson_bootstrap",
    BY_DOMAIN.format(v="truth") + """, pc as (select domain, id, pred as px, truth as py from b)""" + WEIGHTED.replace("domain, v, ", "domain, px, py, ").replace("from b)", "from pc)")
    + """, ss as (select domain, rep, sum(w)::double as n, sum(w * px) as sx, sum(w * py) as sy, sum(w * px * px) as sxx, sum(w * py * py) as syy, sum(w * px * py) as sxy from w group by 1, 2),
mm as (select domain, rep, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) as m from ss)"""
    + _interval_sql("", "corr(pred, truth)"),
    ("v_labels", "v_predictions"),
)
def h11p(t):
    """Of a statistic of two columns: the correlation of prediction and truth."""
    return _interval(B.bootstrap_ci(_boot_rows(t), ["domain"], ["pred", "truth"], "pearson", seed=7))


@query(
    "h13_kendall_tau_a",
    """, d as (select domain, row_id, floor(x3 * 20) as x, nll_before - nll_after as y from v_labels), pr as (select a.domain, (a.x - b.x) * (a.y - b.y) as d from d a join d b on a.domain = b.domain and a.row_id < b.row_id)
select domain, count(*) as pairs, round((count(*) filter (d > 0) - count(*) filter (d < 0))::double / count(*), 9) + 0.0::double as tau from pr group by 1""",
)
def h13(t):
    """By domain, of a coarse feature with many ties."""
    rows = t.labels.select("domain", F.col("row_id").alias("id"), F.floor(F.col("x3") * 20).alias("pred"), (F.col("nll_before") - F.col("nll_after")).alias("truth"))
    return M.concordance(rows, ["domain"]).select("domain", F.col("all_pairs").alias("pairs"), r9(ratio(F.col("right") - F.col("discordant"), "all_pairs")).alias("tau"))


@query(
    "h14_direction_stats",
    """, d as (select domain, nll_before - nll_after > 0.1 as up, x3 > 2.0 as said from v_labels)
select domain, count(*) as n, round(avg(case when up = said then 1.0 else 0.0 end), 9) as accuracy, round((count(*) filter (up and said))::double / count(*) filter (up), 9) as sensitivity,
  round((count(*) filter (not up and not said))::double / count(*) filter (not up), 9) as specificity, round(avg(case when up then 1.0 else 0.0 end), 9) as base_rate,
  round(greatest(avg(case when up then 1.0 else 0.0 end), 1 - avg(case when up then 1.0 else 0.0 end)), 9) as majority from d group by 1""",
)
def h14(t):
    rows = t.labels.select("domain", (F.col("nll_before") - F.col("nll_after") - 0.1).alias("truth"), (F.col("x3") - 2.0).alias("pred"))
    out = rows.groupBy("domain").agg(*M.direction_columns())
    return out.select("domain", "n", *(r9(c).alias(c) for c in out.columns[2:]))


@query(
    "h15_spearman_p",
    RANKS + f""", s as (select grp, count(*) as n, {COR.format(x='rp', y='ry')} as r from rk group by 1), q as (select grp, n, case when n >= 4 and abs(r) < 1 - 1e-9 then abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt(2.0) end as z from s),
e as (select grp, n, z, 1 / (1 + 0.3275911 * z) as t from q)
select grp, n, z is null as is_nan, round(((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z), 9) + 0.0::double as p from e""",
)
def h15(t):
    p = M.spearman_p(F.col("spearman"), F.col("n"))
    s = M.spearman(t.predictions, ["grp"]).withColumn("p", p)
    return s.select("grp", "n", F.isnan("p").alias("is_nan"), r9(F.when(~F.isnan("p"), F.col("p"))).alias("p"))


@query(
    "h16_topk_capture",
    """, n as (select domain, row_id, x3 as pred, nll_before - nll_after as truth, count(*) over (partition by domain) as n, row_number() over (partition by domain order by x3 desc, row_id desc) as rp,
  row_number() over (partition by domain order by nll_before - nll_after desc, row_id desc) as ry from v_labels),
g as (select domain, frac, avg(truth) as random, avg(truth) filter (rp <= greatest(1, round_even(n * frac, 0))) as pick, avg(truth) filter (ry <= greatest(1, round_even(n * frac, 0))) as oracle
  from n, (values (0.1::double), (0.2::double), (0.3::double)) f(frac) group by 1, 2)
select domain, frac, round(random, 9) as random, round(pick, 9) as pick, round(oracle, 9) as oracle, round((pick - random) / (oracle - random), 9) as share from g""",
)
def h16(t):
    from granary.operators.signal import topk_capture

    rows = t.labels.select("domain", F.col("row_id").alias("id"), F.col("x3").alias("pred"), (F.col("nll_before") - F.col("nll_after")).alias("truth"))
    out = topk_capture(rows, ["domain"], [0.1, 0.2, 0.3])
    return out.select("domain", "frac", *(r9(c).alias(c) for c in ("random", "pick", "oracle", "share")))


@query(
    "h17_split_by_cohort",
    """, c as (select distinct candidate_id from v_labels), r as (select candidate_id, row_number() over (order by md5(concat('5:', candidate_id))) as rn, count(*) over () as n from c)
select row_id, rn <= greatest(1, floor(n * 0.2::double)) as is_test from v_labels join r using (candidate_id)""",
)
def h17(t):
    from granary.operators.cohorts import split_by_cohort

    return split_by_cohort(t.labels, "candidate_id", 0.2, 5).select("row_id", "is_test")


@query("h18_largest_examples", " select id, round(pred, 9) as pred, round(truth, 9) as truth from v_predictions order by abs(truth) desc, id limit 8")
def h18(t):
    return t.predictions.orderBy(F.abs("truth").desc(), "id").limit(8).select("id", r9("pred").alias("pred"), r9("truth").alias("truth"))
