"""Queries of cohort construction. The pool: orders with the pass rate of their lines."""

from pyspark.sql import functions as F

from granary.functions.exprs import r9
from granary.operators import cohorts as C

from .base import query

KEYED = """, sh as (select prompt_id, pass_rate, row_number() over (order by md5(concat('3:', prompt_id)), prompt_id) as rn, count(*) over () as n from v_pass_rates)"""


@query("c1_random_cohorts", KEYED + " select printf('random-%03d', (rn - 1) // 8) as name, 'random' as kind, cast((rn - 1) % 8 as int) as pos, prompt_id, false as is_noisy from sh where rn <= 320")
def c1(t):
    return C.random_cohorts(t.pass_rates, 40, 8, 3)


@query("c2_chunk", KEYED + " select prompt_id, cast((rn - 1) // 32 as int) as chunk from sh where ((rn - 1) // 32 + 1) * 32 <= n")
def c2(t):
    return C.chunk(C.shuffled(t.pass_rates, 3), 32).select("prompt_id", "chunk")


@query(
    "c3_grouped_cohorts",
    """, s as (select id, level, row_number() over (partition by level order by md5(concat('3:', level, ':', id)), id) as rn, count(*) over (partition by level) as n from v_items)
select concat('by_level-', replace(replace(level, ' ', '_'), '/', '-'), printf('-%03d', (rn - 1) // 8)) as name, 'by_level' as kind, cast((rn - 1) % 8 as int) as pos, id as prompt_id, false as is_noisy
from s where ((rn - 1) // 8 + 1) * 8 <= n and (rn - 1) // 8 < 10""",
)
def c3(t):
    return C.grouped_cohorts(t.items.withColumnRenamed("id", "prompt_id"), "level", 8, 10, 3)


BANDS = ", b(band, lo, hi) as (values (0, 0.0::double, 0.2::double), (1, 0.2, 0.5), (2, 0.5, 0.8), (3, 0.8, 1.0))"
# to twelve decimals: variances of simple fractions lie on ties of nine
STATS = "round(passrate_mean, 12) as passrate_mean, round(passrate_var, 12) as passrate_var, round(within_group_var_mean, 12) as within_group_var_mean, n_with_rate"
WITH_STATS = """, ps as (select m.name, avg(pass_rate) as passrate_mean, var_pop(pass_rate) as passrate_var, avg(pass_rate * (1 - pass_rate)) as within_group_var_mean, count(*) as n_with_rate
  from {members} m join v_pass_rates using (prompt_id) group by 1)"""


def _with_stats(out):
    return out.withColumns({c: F.round(c, 12) for c in ("passrate_mean", "passrate_var", "within_group_var_mean")})


@query(
    "c4_passband_cohorts",
    BANDS + """, j as (select * from v_pass_rates join b on pass_rate >= lo and (pass_rate < hi or (pass_rate = 1 and hi >= 1))),
s as (select *, row_number() over (partition by band order by md5(concat('3:', band, ':', prompt_id)), prompt_id) as rn, count(*) over (partition by band) as n from j),
m as (select printf('passband-%.1f_%.1f-%03d', lo, hi, (rn - 1) // 8) as name, 'passband' as kind, cast((rn - 1) % 8 as int) as pos, prompt_id, false as is_noisy from s where ((rn - 1) // 8 + 1) * 8 <= n)"""
    + WITH_STATS.format(members="m")
    + f" select m.*, {STATS} from m join ps using (name)",
)
def c4(t):
    return _with_stats(C.with_pass_stats(C.passband_cohorts(t.pass_rates, 8, seed=3), t.pass_rates))


@query(
    "c5_variance_decoupled",
    """, p as (select *, case when abs(pass_rate - 0.5) <= 0.15::double then 0 when pass_rate <= 0.15::double then 1 when pass_rate >= 0.85::double then 2 end as part from v_pass_rates),
s as (select *, row_number() over (partition by part order by md5(concat('3:', part, ':', prompt_id)), prompt_id) as rn from p where part is not null)
select case when part = 0 then 'vardecouple-highvar' else 'vardecouple-lowvar' end as name, 'variance_decoupled' as kind, cast(rn - 1 + case when part = 2 then 16 else 0 end as int) as pos, prompt_id, false as is_noisy
from s where rn <= case when part = 0 then 32 else 16 end""",
)
def c5(t):
    return C.variance_decoupled(t.pass_rates, 32, 3)


NOISE = """, f as (select prompt_id, (rn - 1) // 6 as chunk, (rn - 1) % 6 as pos, ([0.0, 0.25, 0.5, 1.0])[(rn - 1) // 6 % 4 + 1]::double as frac from sh where rn <= 4 * 20 * 6 and ((rn - 1) // 6 + 1) * 6 <= n),
noise as (select printf('labelnoise-%03d-%03d', cast(trunc(frac * 100) as int), chunk + 1) as name, 'label_noise' as kind, cast(pos as int) as pos, prompt_id, pos < round_even(frac * 6, 0) as is_noisy from f)"""


@query("c6_label_noise_cohorts", KEYED + NOISE + " select * from noise")
def c6(t):
    return C.label_noise_cohorts(t.pass_rates, [0.0, 0.25, 0.5, 1.0], 6, 20, 3)


def _dup(pool: str, ks: str, limit: int, size: int) -> str:
    return f"""dp as (select k, rep, prompt_id, row_number() over (partition by k, rep order by md5(concat('3:', k, ':', rep, ':', prompt_id)), prompt_id) - 1 as place, count(*) over (partition by k, rep) as have from {pool}, (select unnest([{ks}]) as k), range(0, {limit}) q(rep)),
dm as (select printf('dup-k%02d-%03d', k, rep) as name, 'duplication' as kind, cast(slot as int) as pos, prompt_id, false as is_noisy, k, rep from dp, range(0, {size}) s(slot) where have >= k and place < k and slot % k = place)"""


@query("c7_duplication_cohorts", ", " + _dup("v_pass_rates", "1, 2, 4, 8", 3, 8) + " select name, kind, pos, prompt_id, is_noisy from dm")
def c7(t):
    return C.duplication_cohorts(t.pass_rates, list(C.DISTINCT), 8, 3, 3)


def _sorted(keys: str, key: str) -> str:
    return f"select *, row_number() over (partition by {keys} order by md5(concat('3:', {key}, ':', prompt_id)), prompt_id) as rn, count(*) over (partition by {keys}) as n"


C8 = f""", pool as (select prompt_id, pass_rate, o_orderpriority as level, c_mktsegment as subject from v_pass_rates join orders on cast(o_orderkey as varchar) = prompt_id join customer on o_custkey = c_custkey),
sh as (select prompt_id, row_number() over (order by md5(concat('3:', prompt_id)), prompt_id) as rn, count(*) over () as n from pool),
f0 as (select 0 as fam, '' as a, (rn - 1) // 8 as b, printf('labelnoise-%03d-%03d', cast(trunc(([0.0, 0.25, 0.5, 1.0])[(rn - 1) // 8 % 4 + 1]::double * 100) as int), (rn - 1) // 8 + 1) as name, 'label_noise' as kind, (rn - 1) % 8 as pos, prompt_id,
  (rn - 1) % 8 < round_even(([0.0, 0.25, 0.5, 1.0])[(rn - 1) // 8 % 4 + 1]::double * 8, 0) as is_noisy from sh where rn <= 64 and ((rn - 1) // 8 + 1) * 8 <= n),
{_dup('pool', '1, 2, 4, 8', 2, 8)},
f1 as (select 1 as fam, printf('%03d', k) as a, rep as b, name, kind, pos, prompt_id, is_noisy from dm),
bd(band, lo, hi) as (values (0, 0.0::double, 0.2::double), (1, 0.2, 0.5), (2, 0.5, 0.8), (3, 0.8, 1.0)), j as (select * from pool join bd on pass_rate >= lo and (pass_rate < hi or (pass_rate = 1 and hi >= 1))), jb as ({_sorted('band', 'band')} from j),
f2 as (select 2 as fam, printf('%03d', band) as a, (rn - 1) // 8 as b, printf('passband-%.1f_%.1f-%03d', lo, hi, (rn - 1) // 8) as name, 'passband' as kind,
  (rn - 1) % 8 as pos, prompt_id, false as is_noisy from jb where ((rn - 1) // 8 + 1) * 8 <= n and (rn - 1) // 8 < 3),
vp as (select *, case when abs(pass_rate - 0.5) <= 0.15::double then 0 when pass_rate <= 0.15::double then 1 when pass_rate >= 0.85::double then 2 end as part from pool), vs as ({_sorted('part', 'part')} from vp where part is not null),
f3 as (select 3 as fam, '' as a, case when part = 0 then 0 else 1 end as b, case when part = 0 then 'vardecouple-highvar' else 'vardecouple-lowvar' end as name, 'variance_decoupled' as kind, rn - 1 + case when part = 2 then 4 else 0 end as pos, prompt_id, false as is_noisy
  from vs where rn <= case when part = 0 then 8 else 4 end),
""" + ", ".join(
    f"g{i} as ({_sorted(key, key)} from pool where {key} is not null), f{i} as (select {i} as fam, concat('by_{key}-', replace(replace({key}, ' ', '_'), '/', '-'), printf('-%03d', (rn - 1) // 8)) as a, (rn - 1) // 8 as b, a as name, 'by_{key}' as kind, (rn - 1) % 8 as pos, prompt_id, false as is_noisy from g{i} where ((rn - 1) // 8 + 1) * 8 <= n and (rn - 1) // 8 < 3)"
    for i, key in ((4, "level"), (5, "subject"))
) + """, f6 as (select 6 as fam, '' as a, (rn - 1) // 8 as b, printf('random-%03d', (rn - 1) // 8) as name, 'random' as kind, (rn - 1) % 8 as pos, prompt_id, false as is_noisy from sh where rn <= 64),
u as (select * from f0 union all select * from f1 union all select * from f2 union all select * from f3 union all select * from f4 union all select * from f5 union all select * from f6),
mm as (select name, kind, cast(pos as int) as pos, prompt_id, is_noisy, cast(dense_rank() over (order by fam, a, b, name) - 1 as int) as ord from u)""" + WITH_STATS.format(members="mm") + f" select mm.*, {STATS} from mm join ps using (name)"


@query("c8_build_all_cohorts", C8)
def c8(t):
    orders = t["orders"].select(F.col("o_orderkey").cast("string").alias("prompt_id"), F.col("o_orderpriority").alias("level"), F.col("o_custkey").alias("c_custkey"))
    pool = t.pass_rates.join(orders, "prompt_id").join(t["customer"].select("c_custkey", F.col("c_mktsegment").alias("subject")), "c_custkey").drop("c_custkey")
    return _with_stats(C.build_all(pool, 8, 3))


@query(
    "c9_cohort_pass_stats",
    KEYED + NOISE + """ select name, round(avg(pass_rate), 9) as passrate_mean, round(var_pop(pass_rate), 9) as passrate_var, round(avg(pass_rate * (1 - pass_rate)), 9) as within_group_var_mean,
  count(*) as n_with_rate from noise join v_pass_rates using (prompt_id) group by 1""",
)
def c9(t):
    out = C.pass_stats(C.label_noise_cohorts(t.pass_rates, [0.0, 0.25, 0.5, 1.0], 6, 20, 3), t.pass_rates)
    return out.select("name", *(r9(c).alias(c) for c in ("passrate_mean", "passrate_var", "within_group_var_mean")), "n_with_rate")


@query(
    "c10_candidate_schedule",
    """, sh as (select cast(o_orderkey as varchar) as prompt_id, row_number() over (order by md5(concat('3:', o_orderkey)), cast(o_orderkey as varchar)) - 1 as i, count(*) over () as n from orders),
dr as (select s, c, d, cast(concat('0x', substr(md5(concat('3:', s, ':', c, ':', d)), 1, 8)) as bigint) % (select max(n) from sh) as i from range(0, 60) a(s), range(0, 4) b(c), range(0, 16) q(d)),
f as (select s, c, i, min(d) as d from dr group by 1, 2, 3), r as (select *, row_number() over (partition by s, c order by d) - 1 as pos from f)
select cast(s as int) as state, cast(c as int) as candidate, cast(pos as int) as pos, prompt_id from r join sh using (i) where pos < 4""",
)
def c10(t):
    return C.candidate_schedule(t["orders"].select(F.col("o_orderkey").cast("string").alias("prompt_id")), 60, 4, 4, 3)


def _noise(t):
    members = C.label_noise_cohorts(t.pass_rates, [0.0, 0.25, 0.5, 1.0], 6, 20, 3)
    return members.withColumn("ord", F.substring("name", -3, 3).cast("int") - 1)


@query("c11_limit_cohorts", KEYED + NOISE + " select name, pos, prompt_id from noise where cast(right(name, 3) as int) <= 10")
def c11(t):
    return C.limit_cohorts(_noise(t), 10).select("name", "pos", "prompt_id")


@query("c12_shard_cohorts", KEYED + NOISE + " select name, pos, prompt_id from noise where (cast(right(name, 3) as int) - 1) % 3 = 1")
def c12(t):
    return C.shard_cohorts(_noise(t), 1, 3).select("name", "pos", "prompt_id")


@query(
    "c13_cohort_rows",
    KEYED + NOISE + """ select name, pos, prompt_id, is_noisy, o_orderpriority as answer from noise join orders on cast(o_orderkey as varchar) = prompt_id where o_orderkey % 5 <> 0""",
)
def c13(t):
    items = t["orders"].filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").cast("string").alias("prompt_id"), F.col("o_orderpriority").alias("answer"))
    return C.cohort_rows(C.label_noise_cohorts(t.pass_rates, [0.0, 0.25, 0.5, 1.0], 6, 20, 3), items).select("name", "pos", "prompt_id", "is_noisy", "answer")


@query("c14_pass_rates", " select group_id, round(avg(case when reward > 0.5 then 1.0 else 0.0 end), 9) as pass_rate from v_rollouts group by 1")
def c14(t):
    return C.pass_rates(t.rollouts, "group_id").select("group_id", r9("pass_rate").alias("pass_rate"))
