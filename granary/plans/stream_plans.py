"""Streaming queries: each drains what is there and returns its sink; SQL gives the batch result."""

from pyspark.sql import functions as F

from granary.functions.exprs import r9
from granary.sources.scratch import scratch
from granary.streaming import jobs as J

from .base import query


def stream(t, rows, order="ts", parts=4, end=False):
    """Rows as a stream of about `parts` micro-batches in the order of a column, each of two files; event times in UTC.

    end: a last file of one row, with nulls but for a time far ahead, lets the watermark pass all that came before.
    """
    rows = t[rows] if isinstance(rows, str) else rows
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind.startswith("timestamp")})
    path, as_number = scratch(t.spark, "stream"), F.col(order).cast("double")
    bounds = rows.select(as_number.alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.01)
    part = sum(((as_number > x).cast("int") for x in bounds), F.lit(0))
    for i in range(parts):  # files are taken in the order in which they were written
        rows.filter(part == i).repartition(2).write.mode("append").parquet(path)
    if end:
        last = rows.agg(F.max("ts").alias("ts")).select(*((F.col("ts") + F.expr("interval 3650 days")) if c == "ts" else F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns))
        last.toDF(*rows.columns).write.mode("append").parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def drained(t, df, name):
    out = scratch(t.spark, name)
    J.run_available(df, f"{out}/log", f"{out}/rows")
    return t.spark.read.schema(df.schema).parquet(f"{out}/rows")


@query("k1_ingest_labels", " select event_id, event_type from events")
def k1(t):
    """Every fifth event is sent again within the lateness; each comes out once, through a sink that a replayed batch leaves as it is."""
    e = t["events"].withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "event_type", "ts")
    again = e.filter("event_id % 5 = 0").withColumn("ts", F.col("ts") + F.expr("interval 10 minutes"))
    once, out = J.ingest(stream(t, e.unionByName(again)), ["event_id"], "ts", "2 hours"), scratch(t.spark, "k1")
    J.run_available(once, f"{out}/log", each=J.append_once(f"{out}/rows"))
    return t.spark.read.parquet(f"{out}/rows").select("event_id", "event_type")


@query("k2_progress_counts", " select event_type, count(*) as labels_done, arg_max(event_id, row(ts, event_id)) as latest_id from events group by 1")
def k2(t):
    out = scratch(t.spark, "k2")
    J.run_available(J.progress(stream(t, "events"), "event_type", "ts", "event_id"), f"{out}/log", each=J.keep_state(f"{out}/state"), mode="complete")
    return J.latest_state(t.spark, f"{out}/state").select("event_type", "labels_done", F.col("latest.event_id").alias("latest_id"))


# pods' reports: five pods a domain, each shows its labels so far; who is down or starting follows from the value
REPORTS = """, e as (select event_type, user_id % 5 as pod, ts, event_id, case when value < 1 then 'TERMINATED' when value < 6 then 'PROVISIONING' else 'ACTIVE' end as state,
  count(*) filter (value > 9) over (partition by event_type, user_id % 5 order by ts, event_id rows between unbounded preceding and current row) as labels from events),
r as (select *, case state when 'ACTIVE' then labels when 'PROVISIONING' then 0 else -1 end as n, state in ('ACTIVE', 'PROVISIONING') as up from e)"""
STATUS = """, b as (select *, coalesce(lag(n) over w, -1) as pl, lag(n) over w >= {done} as was from tk window w as (partition by event_type order by {by})),
i as (select *, sum((not alive or n > pl)::int) over (partition by event_type order by {by}) as island from b),
f as (select *, cast(row_number() over (partition by event_type, island order by {by}) - case when island > 0 then 1 else 0 end as bigint) as flat from i),
st as (select *, case when not alive then 'DOWN' when n > 0 and flat >= 4 then 'STALL' when n = 0 and active and flat >= 12 then 'STUCK' else 'OK' end as status, n >= {done} and not coalesce(was, false) as done from f),
ch as (select *, lag(status) over (partition by event_type order by {by}) as before from st)"""
#: Of the one-event ticks (every event is a tick of its domain) and of hourly ticks of all pods.
TICKS = REPORTS + ", tk as (select event_type, ts, event_id, n, up as alive, state = 'ACTIVE' as active from r)" + STATUS.format(by="ts, event_id", done=20)
HOURS = REPORTS + """, g as (select event_type, time_bucket(interval '1 hour', ts) as tick, pod, n, up, state, row_number() over (partition by event_type, time_bucket(interval '1 hour', ts) order by n desc, pod, event_id) as k from r),
tk as (select event_type, tick, any_value(pod) filter (k = 1) as pod, max(n) as n, bool_or(up) as alive, bool_or(state = 'ACTIVE') filter (k = 1) as active from g group by 1, 2)""" + STATUS.format(by="tick", done=20)


def reports(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("event_type", "pod").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    value = F.col("value")
    state = F.when(value < 1, "TERMINATED").when(value < 6, "PROVISIONING").otherwise("ACTIVE")
    return t["events"].select("event_type", (F.col("user_id") % 5).alias("pod"), "ts", "event_id", state.alias("state"), "value").withColumn("labels", F.count_if(value > 9).over(w)).drop("value")


def ticks(t):
    own = reports(t).withColumn("n", J.seen_labels(F.col("state"), F.col("labels")))
    return own.select("event_type", "ts", "event_id", "n", F.col("state").isin(*J.ALIVE).alias("alive"), (F.col("state") == "ACTIVE").alias("active"))


def _hourly(t, changes):
    found = J.stall_stream(stream(t, reports(t), end=True), "event_type", "pod", "state", "labels", "ts", "1 hour", "30 minutes", ("event_id",), done=20, changes=changes)
    return drained(t, found, "k3").filter("event_type is not null")


@query("k3_stall_detector", HOURS + " select event_type, tick, pod, n, flat, status, done from st")
def k3(t):
    return _hourly(t, False).select("event_type", "tick", "pod", "n", "flat", "status", "done")


@query("k3_stall_batch", TICKS + " select event_type, event_id, n, flat, status, done from st")
def k3b(t):
    return J.stall_status(ticks(t), "event_type", ["ts", "event_id"], done=20).select("event_type", "event_id", "n", "flat", "status", "done")


@query("k3_best_pod", HOURS + " select event_type, tick, pod, n, flat, status, done from st")
def k3p(t):
    best = J.best_of_tick(reports(t).withColumn("tick", F.date_trunc("hour", "ts")), ["event_type", "tick"], "pod", "state", "labels", ("event_id",))
    return J.stall_status(best, "event_type", ["tick"], done=20).select("event_type", "tick", "pod", "n", "flat", "status", "done")


@query("k4_transition_alerts", TICKS + " select event_type, event_id, before, status, done from ch where before is distinct from status or done")
def k4(t):
    s = J.stall_status(ticks(t), "event_type", ["ts", "event_id"], done=20)
    return J.transitions(s, "event_type", ["ts", "event_id"]).select("event_type", "event_id", "before", "status", "done")


@query("k4_transition_stream", HOURS + " select event_type, tick, n, before, status, done from ch where before is distinct from status or done")
def k4s(t):
    return _hourly(t, True).select("event_type", "tick", "n", "before", "status", "done")


@query("k5_online_predictor")
def k5(t):
    """The study's six features; missing ones are 0, and the first scores until there are four labels."""
    from .fit_plans import ONLINE, matrix

    rows = stream(t, matrix(t).select("candidate_id", "row_id", *ONLINE, "y"), "row_id")
    return drained(t, J.online_predictor(rows, "candidate_id", "row_id", ONLINE, "y"), "k5").select("row_id", (F.round("pred", 7) + 0.0).alias("pred"))


@query(
    "k6_age_alert",
    """, m as (select max(ts) as now from events) select event_id, cast(floor((epoch_us(now) - epoch_us(ts)) / 60e6) as bigint) as age_minutes,
  case when event_type = 'error' then 'DEAD' when event_type in ('click', 'view') and (epoch_us(now) - epoch_us(ts)) / 60e6 > 8 then 'STUCK' else 'OK' end as alert from events, m""",
)
def k6(t):
    e = t["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    state = F.when(F.col("event_type").isin("click", "view"), "PROVISIONING").when(F.col("event_type") == "error", "FAILED").otherwise("ACTIVE")
    out = J.age_alert(e.crossJoin(F.broadcast(now)).withColumn("state", state), "state", "ts", F.col("now"))
    return out.select("event_id", F.floor("age_minutes").alias("age_minutes"), "alert")


@query(
    "k6_age_stream",
    """, e as (select user_id, event_id, ts, case when event_type in ('click', 'view') then 'PROVISIONING' when event_type = 'error' then 'FAILED' else 'ACTIVE' end as state from events),
b as (select *, lag(state) over w as before, count(*) filter (state <> 'PROVISIONING') over (w rows between unbounded preceding and current row) as island from e window w as (partition by user_id order by ts, event_id)),
i as (select user_id, island, min(ts) as since from b where state = 'PROVISIONING' group by 1, 2),
o as (select user_id, island, ts as ended from b where state <> 'PROVISIONING'),
s as (select i.user_id, since from i left join o on o.user_id = i.user_id and o.island = i.island + 1, (select max(ts) as now from events) where coalesce(ended, now) > since + interval '8 minutes')
select user_id, since, 'STUCK' as alert from s union all select user_id, ts as since, 'DEAD' as alert from b where state = 'FAILED' and before is distinct from 'FAILED'""",
)
def k6s(t):
    state = F.when(F.col("event_type").isin("click", "view"), "PROVISIONING").when(F.col("event_type") == "error", "FAILED").otherwise("ACTIVE")
    rows = stream(t, "events").select("user_id", "event_id", "ts", state.alias("state"))
    return drained(t, J.age_stream(rows, "user_id", "state", "ts", "event_id"), "k6")


@query(
    "k7_running_gate",
    """, p as (select user_id, avg(value) as m, var_samp(value) as s, count(*) as n from events group by 1), g as (select count(*) as n_cohorts, avg(s) filter (n >= 2) as w, var_samp(m) as b from p)
select n_cohorts, round(b / (b + w), 7) as icc, case when b / (b + w) >= 0.5 then 'strong_signal' when b / (b + w) >= 0.2 then 'usable_signal' else 'noise_dominated' end as verdict from g""",
)
def k7(t):
    out = scratch(t.spark, "k7")
    merge = lambda old, batch: J.merge_cohort_sums(old if old is not None else batch.sparkSession.createDataFrame([], "user_id long, n long, s double, q double"), batch, "user_id", "value")
    J.run_available(stream(t, "events"), f"{out}/log", each=J.keep_state(f"{out}/state", merge))
    return J.gate_from_sums(J.latest_state(t.spark, f"{out}/state")).select("n_cohorts", F.round("icc", 7).alias("icc"), "verdict")


RATE = """, e as (select *, (event_id * 7919) % 97 as delay from events)
select time_bucket(interval '1 hour', ts) as start, count(*) as n, round(sum(value), 6) as total, quantile_disc(delay::double, 0.5) as p50, quantile_disc(delay::double, 0.95) as p95, round(avg((delay > 60)::int), 9) as late_share from e group by 1"""


def _arrivals(t):
    """Events with the time at which they came, up to 96 seconds after they happened."""
    e = t["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("arrival", F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") * 7919 % 97) * 1_000_000))


def _rates(found):
    return found.select("start", "n", F.round("total", 6).alias("total"), "p50", "p95", r9("late_share").alias("late_share"))


@query("k8_windowed_label_rate", RATE, ())
def k8(t):
    return _rates(J.label_rate(_arrivals(t), "ts", "1 hour", arrival="arrival"))


@query("k8_label_rate_stream", RATE, ())
def k8s(t):
    """In the order of arrival; the row that closes the stream has no arrival."""
    rows = stream(t, _arrivals(t), "arrival", end=True)
    return _rates(drained(t, J.label_rate(rows, "ts", "1 hour", "10 minutes", "arrival"), "k8").filter("late_share is not null"))
