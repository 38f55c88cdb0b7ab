"""Stall rules against the state machine they describe, streams of late and shuffled files, timers, and running values over split keys."""

import random
import tempfile
import time
from datetime import datetime, timedelta, timezone

import pytest
from granary.functions.scans import in_ranges, running
from granary.streaming import jobs as J
from pyspark.sql import Window as W, functions as F

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def machine(ticks, done=240):
    """(n, alive, active) for each tick: flat, status and done."""
    last, flat, out = -1, 0, []
    for n, alive, active in ticks:
        flat = 0 if not alive or n > last else flat + 1
        status = "DOWN" if not alive else "STALL" if n > 0 and flat >= 4 else "STUCK" if n == 0 and active and flat >= 12 else "OK"
        out.append((flat, status, n >= done > last))
        last = n
    return out


def batch(spark, ticks, **options):
    df = spark.createDataFrame([("d", i, *t) for i, t in enumerate(ticks)], "domain string, i long, n long, alive boolean, active boolean")
    return [(r.flat, r.status, r.done) for r in J.stall_status(df, "domain", ["i"], **options).orderBy("i").collect()]


SEQUENCES = {
    "down resets": [(0, True, True)] * 10 + [(-1, False, False)] * 3 + [(0, True, True)] * 16,
    "first zero is growth": [(0, True, True)] * 14,
    "one tick down": [(5, True, True)] * 3 + [(-1, False, False)] + [(5, True, True)] * 6,
    "starting is not stuck": [(0, True, False)] * 15,
    "done beside stall": [(239, True, True)] + [(240, True, True)] * 7,
    "unknown from the start": [(-1, True, True)] * 6 + [(3, True, True)] * 5,
}


@pytest.mark.parametrize("name", SEQUENCES)
def test_stall_rules(spark, name):
    ticks = SEQUENCES[name]
    assert batch(spark, ticks) == machine(ticks)
    if name == "down resets":
        assert machine(ticks)[9][1] == "OK" and machine(ticks)[10][:2] == (0, "DOWN") and machine(ticks)[13:25] == [(i, "OK", False) for i in range(12)] and machine(ticks)[25][1] == "STUCK"
    if name == "done beside stall":
        assert [x[1] for x in machine(ticks)] == ["OK"] * 5 + ["STALL"] * 3 and [x[2] for x in machine(ticks)] == [False, True] + [False] * 6


def test_ticks_of_one_domain_in_many_tasks(spark):
    rng = random.Random(4)
    n, ticks = 0, []
    for _ in range(1500):
        n += rng.random() < 0.2
        alive = rng.random() > 0.02
        ticks.append((n if alive else -1, alive, rng.random() > 0.1))
    assert batch(spark, ticks, block=100) == batch(spark, ticks) == machine(ticks)


@pytest.mark.parametrize("block", [50, 100_000])
def test_running_values(spark, block):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i, rng.choice([None, rng.randrange(100)]), rng.choice(["x", None, "y"])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i long, v long, s string")
    assert (in_ranges(df, ["k"], ["i"], block) is None) == (block > 900)
    got = {r.i: r for r in running(df, ["k"], ["i"], {"total": ("sum", "v"), "top": ("max", "v"), "low": ("min", "v"), "t": ("count", None), "seen": ("count", "v"), "was": ("lag", "s")}, block).collect()}
    upto = W.partitionBy("k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    for r in df.select("*", F.sum("v").over(upto).alias("total"), F.max("v").over(upto).alias("top"), F.min("v").over(upto).alias("low"), F.count(F.lit(1)).over(upto).alias("t"), F.count("v").over(upto).alias("seen"), F.lag("s").over(W.partitionBy("k").orderBy("i")).alias("was")).collect():
        assert got[r.i] == r


def reports(spark, seed=6):
    rng = random.Random(seed)
    rows, labels = [], {}
    for minute in range(0, 3000, 3):
        d, p = rng.choice("ab"), f"p{rng.randrange(3)}"
        labels[d, p] = labels.get((d, p), 0) + (rng.random() < 0.15)
        rows.append((d, p, START + timedelta(minutes=minute), len(rows), rng.choice(["ACTIVE"] * 8 + ["PROVISIONING", "FAILED"]), labels[d, p]))
    return rows, "domain string, pod string, ts timestamp, id long, state string, labels long"


@pytest.mark.parametrize("changes", [False, True])
def test_late_and_shuffled_files_give_the_batch_result(spark, changes):
    rows, schema = reports(spark)
    rng = random.Random(7)
    arrived = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rng.uniform(0, 100)))  # up to 100 minutes late, in no order
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i in range(0, len(arrived), 200):
        spark.createDataFrame(arrived[i : i + 200], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    spark.createDataFrame([(None, None, START + timedelta(days=90), None, None, None)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = J.stall_stream(stream, "domain", "pod", "state", "labels", "ts", "30 minutes", "2 hours", ("id",), done=20, changes=changes)
    totals = J.run_available(found, f"{folder}/log", f"{folder}/out")
    assert totals.late == 0 and totals.rows == len(rows) + 1
    best = J.best_of_tick(spark.createDataFrame(rows, schema).withColumn("tick", F.window("ts", "30 minutes")["start"]), ["domain", "tick"], "pod", "state", "labels", ("id",))
    want = J.stall_status(best, "domain", ["tick"], done=20)
    want = J.transitions(want, "domain", ["tick"]) if changes else want
    columns = ["domain", "tick", "pod", "n", "flat", "status", "done"] + ["before"] * changes
    got = spark.read.parquet(f"{folder}/out").filter("domain is not null").select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(columns).collect())) and (changes or got.count() > 150)


def test_rows_beyond_the_lateness_are_counted_and_a_replayed_batch_adds_nothing(spark):
    folder, schema = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "key long, ts timestamp"
    files = [[(1, 0), (2, 1), (1, 5)], [(3, 300), (2, 20)], [(4, 600)], [(5, 10), (6, 2)], [(7, 1200)]]
    for rows in files:
        spark.createDataFrame([(k, START + timedelta(minutes=m)) for k, m in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    sink = J.append_once(f"{folder}/out")
    totals = J.run_available(J.ingest(stream, ["key"], "ts", "1 hour"), f"{folder}/log", each=sink)
    assert totals.rows == 9 and totals.late == 2  # 5 and 6, behind the watermark of 300 - 60 minutes
    out = spark.read.parquet(f"{folder}/out")
    assert sorted(r.key for r in out.collect()) == [1, 2, 3, 4, 7]
    last = out.agg(F.max("batch")).first()[0]
    again = out.filter(F.col("batch") == last).drop("batch").toPandas()
    sink(spark.createDataFrame(again), last)
    assert spark.read.parquet(f"{folder}/out").count() == 5


def test_state_is_dropped_after_the_lateness(spark):
    folder, schema = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "key long, ts timestamp"
    for m in range(6):
        spark.createDataFrame([(10 * m + i, START + timedelta(hours=m)) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with J.own_state_store(spark):
        q = J.ingest(stream, ["key"], "ts", "1 hour").writeStream.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).format("noop").start()
        q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 20


def test_a_silent_key_is_told_by_the_clock(spark):
    folder, schema = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "pod string, state string, ts timestamp, id long"
    now = datetime.now(timezone.utc)
    rows = [("old", "PROVISIONING", now - timedelta(hours=1), 1), ("new", "PROVISIONING", now, 2), ("up", "ACTIVE", now, 3), ("gone", "CANCELLED", now, 4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    with J.own_state_store(spark):
        found = J.age_stream(stream, "pod", "state", "ts", "id", minutes=0.25, clock=True)
        q = found.writeStream.option("checkpointLocation", f"{folder}/log").trigger(processingTime="1 second").format("parquet").option("path", f"{folder}/out").start()
    try:
        alerts, end = set(), time.monotonic() + 90
        while len(alerts) < 3 and time.monotonic() < end and not q.exception():
            time.sleep(1)
            if q.lastProgress:
                alerts = {(r.pod, r.alert) for r in spark.read.schema("pod string, since timestamp, alert string").parquet(f"{folder}/out").collect()}
        assert alerts == {("old", "STUCK"), ("new", "STUCK"), ("gone", "DEAD")}
    finally:
        q.stop()


def test_watching_ends_when_all_are_active(spark):
    folder, schema = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "pod string, state string, ts timestamp, id long"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    write([("a", "PROVISIONING", START, 1), ("b", "ACTIVE", START, 2)])
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    assert not J.watch_until_active(stream, "pod", "state", "ts", "id", f"{folder}/log", seconds=8, every="200 milliseconds")
    write([("a", "ACTIVE", START + timedelta(minutes=1), 3)])
    assert J.watch_until_active(stream, "pod", "state", "ts", "id", f"{folder}/log", seconds=60, every="200 milliseconds")


def test_online_predictor_keeps_keys_together(spark, tmp_path):
    rows = spark.range(900).selectExpr("concat('k', id % 300) as k", "id as i", "cast(id % 7 as double) as a", "cast(id % 11 as double) as y")
    rows.filter("i < 500").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.filter("i >= 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with J.own_state_store(spark):
        q = J.online_predictor(stream, "k", "i", ["a"], "y", 1, groups=8).writeStream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        q.awaitTermination()
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 8
    got = {r.i: r.pred for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 900 and all(got[i] == i % 7 for i in range(300))
    # the second row of a key: one row before it, whose y is its mean and which has no slope
    assert all(abs(got[i] - (i - 300) % 11) < 1e-9 for i in range(300, 600))


def test_age_alerts_keep_keys_together(spark, tmp_path):
    schema = "pod string, state string, ts timestamp, id long"
    first = [(f"p{i}", "PROVISIONING", START + timedelta(seconds=i), i) for i in range(40)]
    later = [(f"p{i}", "ACTIVE" if i % 2 else "FAILED", START + timedelta(minutes=5, seconds=i), 100 + i) for i in range(20)] + [("end", "ACTIVE", START + timedelta(hours=1), 999)]
    for rows in (first, later):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with J.own_state_store(spark):
        q = J.age_stream(stream, "pod", "state", "ts", "id", groups=4).writeStream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        q.awaitTermination()
    got = sorted((r.pod, r.alert) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([(f"p{i}", "STUCK") for i in range(20, 40)] + [(f"p{i}", "DEAD") for i in range(0, 20, 2)])
