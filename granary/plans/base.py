"""How a query is registered: a function of the tables, and SQL for the same rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

QUERIES: dict = {}
SQL: dict = {}

# The stand-ins for the study's tables, for both engines, as in FIXTURES.md but for odd divisors, which keep means off rounding ties.
VIEWS = {
    "v_rollouts": """select concat('cand-', lpad(cast(l_suppkey as varchar), 5, '0')) as candidate_id, cast(l_linenumber % 3 as int) as seed,
  concat(cast(l_suppkey as varchar), '-', cast(l_partkey % 64 as varchar)) as group_id, case when l_returnflag = 'R' then 1.0e0 else 0.0e0 end as reward,
  cast(l_quantity as double) as completion_tokens, -l_extendedprice / 19997.3e0 as mean_logprob, -l_discount * 10.0e0 as early_logprob,
  -l_tax * 10.0e0 as late_logprob, -l_extendedprice / 9998.65e0 as min_logprob, md5(cast(l_partkey as varchar)) as comp_hash from lineitem""",
    "v_labels": """select c_mktsegment as domain, cast(c_nationkey % 3 as int) as chain_id, cast(c_nationkey % 4 as int) as anchor_index,
  concat('cust-', lpad(cast(o_custkey as varchar), 6, '0')) as candidate_id,
  cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as seed, o_orderkey as row_id, o_orderpriority as kind, 0.2e0 as acc_before,
  0.2e0 + (case when o_orderstatus = 'F' then 1 else 0 end) * 0.01e0 as acc_after, 1.5e0 as nll_before,
  1.5e0 - (o_totalprice / 100003.7e0 - 1.5e0) * 0.1e0 as nll_after, 0.0e0 as kl_before, c_acctbal / 1000000.0e0 as kl_after,
  case when o_orderkey % 17 = 0 then null else c_acctbal / 1000.0e0 end as x1, cast(o_orderkey % 97 as double) / 97.0e0 as x2,
  o_totalprice / 100000.0e0 + cast(o_orderkey % 13 as double) / 13.0e0 as x3 from orders join customer on o_custkey = c_custkey""",
    "v_order_rollouts": """select l_orderkey as row_id, concat(cast(l_orderkey as varchar), '-', cast(l_linenumber % 2 as varchar)) as group_id, case when l_returnflag = 'R' then 1.0e0 else 0.0e0 end as reward,
  cast(l_quantity as double) as completion_tokens, -l_extendedprice / 19997.3e0 as mean_logprob, -l_discount * 10.0e0 as early_logprob,
  -l_tax * 10.0e0 as late_logprob, -l_extendedprice / 9998.65e0 as min_logprob, md5(cast(l_partkey as varchar)) as comp_hash from lineitem""",
    "v_items": r"""select concat('doc-', lpad(cast(d.doc_id as varchar), 5, '0'), '-', substr(sha1(text), 1, 12)) as id, d.doc_id as source_index, lang as level,
  source as subject, text as question, concat('Reasoning \boxed{', cast(n_chars % 7 as varchar), '}') as solution, l.quality as quality, l.toxic as toxic
  from documents d left join labels l on d.doc_id = l.doc_id""",
    "v_pass_rates": """select cast(l_orderkey as varchar) as prompt_id, avg(case when l_returnflag = 'R' then 1.0e0 else 0.0e0 end) as pass_rate
  from lineitem group by l_orderkey""",
    "v_predictions": "select row_id as id, candidate_id as grp, x3 as pred, nll_before - nll_after as truth from v_labels",
    "v_progress": """select event_type as domain, ts, event_id, count(*) over (partition by event_type order by ts, event_id
  rows between unbounded preceding and current row) as labels from events where value > 5""",
}
_NEEDS = {"v_predictions": ("v_labels",)}


class Tables:
    """The tables of a directory and the stand-ins over them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def rollouts(self) -> DataFrame:
        price = F.col("l_extendedprice")
        return self["lineitem"].select(
            F.concat(F.lit("cand-"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0")).alias("candidate_id"),
            (F.col("l_linenumber") % 3).cast("int").alias("seed"),
            F.concat(F.col("l_suppkey").cast("string"), F.lit("-"), (F.col("l_partkey") % 64).cast("string")).alias("group_id"),
            F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"),
            F.col("l_quantity").cast("double").alias("completion_tokens"),
            (-price / 19997.3).alias("mean_logprob"),
            (-F.col("l_discount") * 10.0).alias("early_logprob"),
            (-F.col("l_tax") * 10.0).alias("late_logprob"),
            (-price / 9998.65).alias("min_logprob"),
            F.md5(F.col("l_partkey").cast("string")).alias("comp_hash"),
        )

    @cached_property
    def labels(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self["orders"].join(self["customer"], F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_mktsegment").alias("domain"),
            (F.col("c_nationkey") % 3).cast("int").alias("chain_id"),
            (F.col("c_nationkey") % 4).cast("int").alias("anchor_index"),
            F.concat(F.lit("cust-"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("candidate_id"),
            (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int").alias("seed"),
            key.alias("row_id"),
            F.col("o_orderpriority").alias("kind"),
            F.lit(0.2).alias("acc_before"),
            (F.lit(0.2) + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0) * F.lit(0.01)).alias("acc_after"),
            F.lit(1.5).alias("nll_before"),
            (F.lit(1.5) - (F.col("o_totalprice") / 100003.7 - 1.5) * 0.1).alias("nll_after"),
            F.lit(0.0).alias("kl_before"),
            (F.col("c_acctbal") / 1000000.0).alias("kl_after"),
            F.when(key % 17 == 0, None).otherwise(F.col("c_acctbal") / 1000.0).alias("x1"),
            ((key % 97).cast("double") / 97.0).alias("x2"),
            (F.col("o_totalprice") / 100000.0 + (key % 13).cast("double") / 13.0).alias("x3"),
        )

    @cached_property
    def order_rollouts(self) -> DataFrame:
        """The lines of each order as the rollouts of its label row, in two groups."""
        row = F.col("l_orderkey")
        own = F.concat(row.cast("string"), F.lit("-"), (F.col("l_linenumber") % 2).cast("string"))
        price = F.col("l_extendedprice")
        return self["lineitem"].select(
            row.alias("row_id"), own.alias("group_id"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"), F.col("l_quantity").cast("double").alias("completion_tokens"),
            (-price / 19997.3).alias("mean_logprob"), (-F.col("l_discount") * 10.0).alias("early_logprob"), (-F.col("l_tax") * 10.0).alias("late_logprob"), (-price / 9998.65).alias("min_logprob"),
            F.md5(F.col("l_partkey").cast("string")).alias("comp_hash"),
        )

    @cached_property
    def items(self) -> DataFrame:
        marks = self["labels"].select("doc_id", "quality", "toxic")
        return self["documents"].join(marks, "doc_id", "left").select(
            F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit("-"), F.substring(F.sha1("text"), 1, 12)).alias("id"),
            F.col("doc_id").alias("source_index"), F.col("lang").alias("level"), F.col("source").alias("subject"), F.col("text").alias("question"),
            F.concat(F.lit("Reasoning \\boxed{"), (F.col("n_chars") % 7).cast("string"), F.lit("}")).alias("solution"), "quality", "toxic",
        )

    @cached_property
    def pass_rates(self) -> DataFrame:
        hit = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
        return self["lineitem"].groupBy(F.col("l_orderkey").cast("string").alias("prompt_id")).agg(F.avg(hit).alias("pass_rate"))

    @cached_property
    def predictions(self) -> DataFrame:
        return self.labels.select(F.col("row_id").alias("id"), F.col("candidate_id").alias("grp"), F.col("x3").alias("pred"), (F.col("nll_before") - F.col("nll_after")).alias("truth"))

    @cached_property
    def progress(self) -> DataFrame:
        w = W.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
        return self["events"].filter("value > 5").select(F.col("event_type").alias("domain"), "ts", "event_id", F.count(F.lit(1)).over(w).alias("labels"))


def with_views(body: str, *views: str) -> str:
    """SQL with the views it names; `body` is a select, or further common tables after a comma."""
    names = list(dict.fromkeys([n for v in views for n in (*_NEEDS.get(v, ()), v)]))
    if not names:
        return f"with {body.strip()[1:]}" if body.strip().startswith(",") else body
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names) + " " + body


def query(name: str, sql: str | None = None, views: tuple[str, ...] | None = None):
    """Registers a function of Tables; views are found in the SQL's text."""

    def register(f):
        QUERIES[name] = lambda spark, path: f(Tables(spark, path))
        if sql is not None:
            SQL[name] = with_views(sql, *(views if views is not None else [v for v in VIEWS if v in sql]))
        return f

    return register
