"""Queries of sources and sinks: tables written and read again."""

from pyspark.sql import functions as F

from granary.functions.exprs import r9
from granary.sources import records as S
from granary.sources.scratch import scratch

from .base import query

ROW = "row_id long, domain string, candidate_id string, seed int, x1 double"
PLAIN = " select row_id, domain, candidate_id, seed, round(x1, 9) + 0.0::double as x1 from v_labels"


def rows(t):
    return t.labels.select("row_id", "domain", "candidate_id", "seed", "x1")


def shown(df):
    return df.select("row_id", "domain", "candidate_id", "seed", r9("x1").alias("x1"))


def written(t, df, name):
    path = scratch(t.spark, name)
    S.write_records(df, path)
    return path


@query("a1_read_labels", PLAIN)
def a1(t):
    return shown(S.read_records(t.spark, written(t, rows(t), "a1"), ROW))


@query("a2_read_many", PLAIN)
def a2(t):
    paths = [written(t, rows(t).filter(F.col("row_id") % 3 == i), "a2") for i in range(3)]
    return shown(S.read_many(t.spark, [f"{p}/part-*" for p in paths], ROW))


@query("a3_read_tolerant", " select row_id, domain, candidate_id, seed, round(x1, 9) + 0.0::double as x1 from v_labels where row_id % 11 <> 0")
def a3(t):
    path = scratch(t.spark, "a3")
    line = F.to_json(F.struct("row_id", "domain", "candidate_id", "seed", "x1"))
    rows(t).select(F.when(F.col("row_id") % 11 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return shown(S.read_tolerant(t.spark, path, ROW)[0])


@query(
    "a4_read_rollouts",
    """, k as (select concat(candidate_id, '.', seed) as key, group_id, reward, comp_hash, row_number() over (partition by candidate_id, seed order by group_id, comp_hash, reward) - 1 as pos from v_rollouts)
select key, cast(pos as int) as pos, group_id, reward from k""",
)
def a4(t):
    members = F.array_sort(F.collect_list(F.struct("group_id", "comp_hash", "reward")))
    bags = t.rollouts.groupBy(F.concat_ws(".", "candidate_id", "seed").alias("key")).agg(members.alias("m"))
    full = bags.select("key", F.lit("math").alias("domain"), F.transform("m", lambda x: F.struct(x["group_id"].alias("group_id"), x["reward"].alias("reward"))).alias("trajs"))
    path = scratch(t.spark, "a4")
    S.write_records(full, f"{path}/all")
    return S.read_rollouts(t.spark, f"{path}/all").select("key", "pos", "group_id", "reward")


@query("a5_write_records", PLAIN)
def a5(t):
    path = written(t, rows(t), "a5")
    S.write_records(rows(t), path)  # a second time: it overwrites
    return shown(S.read_records(t.spark, path, ROW))


@query("a6_append_labels", PLAIN)
def a6(t):
    path = scratch(t.spark, "a6")
    S.append_labels(rows(t).filter("row_id % 2 = 0"), path, ["row_id"], ROW)
    S.append_labels(rows(t), path, ["row_id"], ROW)
    return shown(S.read_records(t.spark, path, ROW))


@query(
    "a7_export_nested",
    """, c as (select candidate_id, seed, case when row_id % 17 = 0 then null else row_id % 97 end as v from v_labels)
select candidate_id, concat('[', string_agg(concat('{"seed":', seed, ',"v":', coalesce(v || '.0', 'null'), '}'), ',' order by seed), ']') as document from c group by 1""",
)
def a7(t):
    v = F.when(F.col("row_id") % 17 == 0, F.lit(float("nan"))).otherwise((F.col("row_id") % 97).cast("double"))
    return S.export_nested(t.labels.select("candidate_id", "seed", v.alias("v")), "candidate_id", "seed", ["v"])


@query("a8_concat_shards", " select row_id, domain, case when row_id % 2 = 0 then seed end as seed from v_labels")
def a8(t):
    even = t.labels.filter("row_id % 2 = 0").select("row_id", "domain", "seed")
    return S.concat_shards(even, t.labels.filter("row_id % 2 <> 0").select("row_id", "domain"))


@query("a9_select_files", " select row_id, domain, candidate_id, seed, round(x1, 9) + 0.0::double as x1 from v_labels where row_id % 3 = 0")
def a9(t):
    base = scratch(t.spark, "a9")
    # one folder of files of three kinds: labels, rollouts that the glob fits too, and others
    kind = F.element_at(F.array(*map(F.lit, ("labels", "labels_rollouts", "notes"))), (F.col("row_id") % 3 + 1).cast("int"))
    rows(t).withColumn("kind", kind).write.partitionBy("kind").json(base)
    good = S.select_files(t.spark, base, "*.json", "rollouts", ROW, "*/kind=labels*/*")
    return shown(good)
