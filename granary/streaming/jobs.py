"""Structured Streaming jobs over growing logs, and the batch twins that check them."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from granary.functions.exprs import LARGE_GROUP, clean
from granary.functions.scans import running


class Totals(StreamingQueryListener):
    """What one query has read and what its watermark has dropped, from its progress reports."""

    def __init__(self):
        self.rows = self.late = 0
        self.query, self.ended = None, threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        if self.query in (None, str(event.progress.id)):
            self.rows += event.progress.numInputRows
            self.late += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryTerminated(self, event):
        if self.query in (None, str(event.id)):
            self.ended.set()


@contextmanager
def own_state_store(spark):
    """Queries that start inside keep their state in RocksDB, which timers and typed state need; the session's setting comes back."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, own)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_available(stream: DataFrame, checkpoint: str, sink: str | None = None, each: Callable | None = None, mode: str = "append") -> Totals:
    """Processes all that is there now, into a Parquet sink or a function of (batch, number), and ends: rows read and rows dropped as late."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(each) if each else w.format("parquet").option("path", sink)
    streams, totals = stream.sparkSession.streams, Totals()
    streams.addListener(totals)
    try:
        with own_state_store(stream.sparkSession):
            q = w.start()
        totals.query = str(q.id)
        q.awaitTermination()
        totals.ended.wait(60)
    finally:
        streams.removeListener(totals)
    return totals


def ingest(stream: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """Exactly one row for each key among rows within the lateness of each other; a key's state goes when the watermark has passed it."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def append_once(path: str) -> Callable:
    """A foreachBatch function whose rows lie under their batch's number: a batch that is replayed after a failure replaces itself."""
    return keep_state(path)


def progress(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Rows so far and the latest state of each key; the same for a stream and a table."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("labels_done"), F.max(F.struct(ts, tie)).alias("latest"))


ALIVE, TERMINAL = ("ACTIVE", "PROVISIONING"), ("TERMINATED", "ERROR", "FAILED", "CANCELLED")
#: Ticks without growth until a count stalls, until none at all is stuck, and labels of a finished domain.
FLAT, STUCK, DONE = 4, 12, 240


def seen_labels(state: Column, count: Column) -> Column:
    """Labels that a pod shows: its count while ACTIVE, none yet while PROVISIONING; -1 where it can't be asked."""
    return F.when(state == "ACTIVE", F.coalesce(count.cast("long"), F.lit(-1))).when(state == "PROVISIONING", 0).otherwise(-1)


def best_of_tick(rows: DataFrame, keys: list[str | Column], pod: str, state: str, count: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """keys, pod, n, alive and active: the pod that shows the most labels at each tick of a domain, ties to the smaller name.

    alive: any pod of the tick is ACTIVE or PROVISIONING; active: the best one is ACTIVE. The same for a stream and a table.
    """
    own = rows.withColumn("_n", seen_labels(F.col(state), F.col(count)))
    best = F.min_by(F.struct(F.col(pod).alias("pod"), F.col("_n").alias("n"), (F.col(state) == "ACTIVE").alias("active")), F.struct((-F.col("_n")).alias("most"), *(F.col(c) for c in (pod, *tie))))
    out = own.groupBy(*keys).agg(best.alias("_best"), F.coalesce(F.bool_or(F.col(state).isin(*ALIVE)), F.lit(False)).alias("alive"))
    kept = [c for c in out.columns if c not in ("_best", "alive")]
    return out.select(*kept, F.col("_best.pod").alias("pod"), F.col("_best.n").alias("n"), "alive", F.coalesce("_best.active", F.lit(False)).alias("active"))


def stall_status(ticks: DataFrame, key: str, order: list[str], flat_limit: int = FLAT, stuck_limit: int = STUCK, done: int = DONE, block: int = LARGE_GROUP) -> DataFrame:
    """Batch twin of the stall detector, on rows of key, order, n, alive and active: `flat`, `status` and `done`.

    flat: ticks since the labels last grew or the domain was down, from a count of -1 before the first tick. DOWN while
    nothing is alive; STALL with some labels and flat_limit flat ticks; STUCK if ACTIVE without a label for
    stuck_limit flat ticks. done marks the ticks at which the labels reach the target, whatever the status. Ticks of one
    domain spread over tasks in runs of `block`.
    """
    rows = running(ticks, [key], order, {"_before": ("lag", "n"), "_tick": ("count", None)}, block)
    reset = ~F.col("alive") | (F.col("n") > F.coalesce("_before", F.lit(-1)))
    rows = rows.withColumns({"_reset": F.when(reset, F.col("_tick")), "_done": F.col("n") >= done, "_was": F.coalesce(F.col("_before") >= done, F.lit(False))})
    rows = running(rows, [key], order, {"_last": ("max", "_reset")}, block)
    flat = F.col("_tick") - F.coalesce("_last", F.lit(0))
    status = F.when(~F.col("alive"), "DOWN").when((F.col("n") > 0) & (flat >= flat_limit), "STALL").when((F.col("n") == 0) & F.col("active") & (flat >= stuck_limit), "STUCK").otherwise("OK")
    return rows.withColumns({"flat": flat, "status": status, "done": F.col("_done") & ~F.col("_was")}).drop("_before", "_tick", "_reset", "_done", "_was", "_last")


def transitions(status: DataFrame, key: str, order: list[str], block: int = LARGE_GROUP) -> DataFrame:
    """The ticks at which the status changes or the target is reached, with the status before."""
    before = running(status, [key], order, {"before": ("lag", "status")}, block)
    return before.filter(~F.col("before").eqNullSafe(F.col("status")) | F.col("done"))


class _Stalls(StatefulProcessor):
    """State of a domain: labels, flat ticks, last status."""

    def __init__(self, key: str, tick: str, limits: tuple[int, int, int], changes: bool):
        self.key, self.tick, self.limits, self.changes = key, tick, limits, changes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("domain", "n long, flat long, status string")

    def handleInputRows(self, key, rows, timerValues):
        last, flat, status = self.kept.get() if self.kept.exists() else (-1, 0, None)
        flat_limit, stuck_limit, done = self.limits
        out = []
        for r in pd.concat(list(rows)).sort_values(self.tick).itertuples(index=False):
            flat = 0 if not r.alive or r.n > last else flat + 1
            now = "DOWN" if not r.alive else "STALL" if r.n > 0 and flat >= flat_limit else "STUCK" if r.n == 0 and r.active and flat >= stuck_limit else "OK"
            reached = bool(r.n >= done > last)
            if not self.changes or now != status or reached:
                out.append((key[0], getattr(r, self.tick), r.pod, r.n, flat, status, now, reached))
            last, status = int(r.n), now
        self.kept.update((last, int(flat), status))
        if out:
            yield pd.DataFrame(out, columns=[self.key, self.tick, "pod", "n", "flat", "before", "status", "done"])

    def close(self) -> None:
        pass


def stall_stream(
    stream: DataFrame, key: str, pod: str, state: str, count: str, ts: str, width: str, lateness: str, tie: tuple[str, ...] = (), flat_limit: int = FLAT, stuck_limit: int = STUCK, done: int = DONE, changes: bool = False
) -> DataFrame:
    """The stall detector on a stream of pods' reports, in two keyed levels.

    Reports meet by domain and tick, a window of `width`, whose best pod is known once the watermark has passed it, so rows
    that come late (up to `lateness`) or out of order change nothing. The domains' state then takes the finished ticks in their order, which
    are one row each. changes: only ticks at which the status changes or the target is reached.
    """
    window = F.window(ts, width).alias("_window")
    ticks = best_of_tick(stream.withWatermark(ts, lateness), [F.col(key), window], pod, state, count, tie)
    ticks = ticks.select(key, F.col("_window.start").alias("tick"), "pod", "n", "alive", "active")
    kind = dict(stream.dtypes)
    schema = f"{key} {kind[key]}, tick timestamp, pod {kind[pod]}, n long, flat long, before string, status string, done boolean"
    return ticks.groupBy(key).transformWithStateInPandas(_Stalls(key, "tick", (flat_limit, stuck_limit, done), changes), schema, "append", "None")


def latest_state(spark, path: str) -> DataFrame:
    """The table that the last micro-batch wrote under path/batch=<number>."""
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row


def keep_state(path: str, merge: Callable | None = None) -> Callable:
    """A foreachBatch function that writes each micro-batch's state under its number: a restart repeats or goes on from there.

    merge(old, batch): the state after a batch; old is None for the first. Without it the batch is the state.
    """

    def each(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.parquet(f"{path}/batch={number - 1}") if merge and number else None
        (merge(old, batch) if merge else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


#: Groups in which the states of keys lie together, so that a call of a micro-batch takes many keys at once.
KEY_GROUPS = 4096


def online_predictor(stream: DataFrame, key: str, order: str, features: list[str], y: str, warm: int = 4, lam: float = 1.0, groups: int = KEY_GROUPS) -> DataFrame:
    """Predict each row from the rows before it, then learn from it; the first `warm` of a key score as their first feature.

    State of a key: the additive statistics and the row they are centred on, O(p^2) numbers; keys are hashed into `groups`, each one
    state, and a micro-batch's rows of a group take their keys' prefix sums and are solved as one stack of p x p systems. (A kept
    factor can't be updated by rank one instead: the penalty is on standardised features, so every row changes the whole diagonal.)
    """
    from granary.operators.fits import HELD, applied, solve, terms, width

    p = len(features)
    # no feature is missing, so these statistics give all others: n, sums of y and yy, of x, of xy, and of pairs
    own = np.r_[0:3, 3 + p : 3 + 3 * p, 3 + 4 * p : 3 + 4 * p + p * p]

    def whole(kept: np.ndarray) -> np.ndarray:
        g = np.zeros((len(kept), width(p)))
        g[:, own] = kept
        g[:, 3 : 3 + p], g[:, 3 + 3 * p : 3 + 4 * p] = kept[:, :1], kept[:, 1:2]
        return g

    def step(_, frames, state):
        rows = pd.concat(list(frames)).sort_values([key, order], kind="stable")
        names = [None if pd.isna(k) else k for k in rows[key].tolist()]
        x, v = rows[features].fillna(0.0).to_numpy(float), rows[y].to_numpy(float)
        known, kept = state.get if state.exists else ([], b"")
        kept = np.frombuffer(kept).reshape(len(known), len(own) + p)
        place, known = {k: i for i, k in enumerate(known)}, list(known)
        first = [i for i, k in enumerate(names) if (i == 0 or k != names[i - 1]) and k not in place]
        for i in first:
            place[names[i]] = len(known)
            known.append(names[i])
        g = np.concatenate([whole(kept[:, : len(own)]), np.zeros((len(first), width(p)))])
        shift = np.concatenate([kept[:, len(own) :], x[first]])
        at = np.array([place[k] for k in names])
        some = max(1, HELD // width(p))
        for begin in range(0, len(rows), some):
            k, now = at[begin : begin + some], slice(begin, begin + some)
            z = x[now] - shift[k]
            upto = terms(z, v[now])
            before = np.empty_like(upto)
            edges = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
            for a, e in zip(edges, edges[1:]):
                before[a] = g[k[a]]
                upto[a:e] = g[k[a]] + np.cumsum(upto[a:e], axis=0)
                before[a + 1 : e] = upto[a : e - 1]
                g[k[a]] = upto[e - 1]
            pred = np.where(before[:, 0] < warm, x[now, 0], applied(solve(before, p, lam), z))
            yield pd.DataFrame({key: rows[key].to_numpy()[now], order: rows[order].to_numpy()[now], "pred": pred})
        state.update((known, np.concatenate([g[:, own], shift], axis=1).tobytes()))

    kind = dict(stream.dtypes)
    dealt = stream.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandasWithState(step, f"{key} {kind[key]}, {order} {kind[order]}, pred double", f"keys array<{kind[key]}>, kept binary", "append", "NoTimeout")


def age_alert(rows: DataFrame, state: str, ts: str, now: Column, minutes: int = 8, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """STUCK when provisioning for longer than the limit; terminal states are DEAD."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(ts))) / 60e6
    status = F.when(F.col(state).isin(*terminal), "DEAD").when((F.col(state) == "PROVISIONING") & (age > minutes), "STUCK").otherwise("OK")
    return rows.withColumns({"age_minutes": age, "alert": status})


class _Ages(StatefulProcessor):
    """State of a group of pods: their names and, for each, since when it has been provisioning (-1: it is not), whether that was told, whether it is dead.

    A call takes the rows of all pods of a group at once, and a group has one timer, for the first of its pods that is due.
    """

    def __init__(self, key: str, kind: str, state: str, tie: str, limit: int, terminal: tuple[str, ...], clock: bool):
        self.key, self.kind, self.state, self.tie, self.limit, self.terminal, self.clock = key, kind, state, tie, limit, terminal, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("pods", f"keys array<{self.kind}>, since binary, flags binary")

    def _now(self, timers) -> int:
        """Milliseconds of the clock, or of the watermark."""
        return timers.getCurrentProcessingTimeInMs() if self.clock else timers.getCurrentWatermarkInMs()

    def _read(self):
        if not self.kept.exists():
            return [], np.zeros(0, np.int64), np.zeros((0, 2), bool)
        keys, since, flags = self.kept.get()
        return list(keys), np.frombuffer(since, np.int64).copy(), np.frombuffer(flags, bool).reshape(-1, 2).copy()

    def _keep(self, keys, since, flags, timers) -> list[int]:
        """Writes the state and sets the timer; by the clock, the places of the pods that are due already, which count as told."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        passed, due, late = self._now(timers), (since + self.limit) // 1000 + 1, []
        waits = (since >= 0) & ~flags[:, 0]
        if self.clock:
            late = np.flatnonzero(waits & (due <= passed)).tolist()
            flags[late, 0], waits[late] = True, False
        if waits.any():
            self.handle.registerTimer(max(int(due[waits].min()), passed + 1))
        self.kept.update((keys, since.tobytes(), flags.tobytes()))
        return late

    def _frame(self, keys, out) -> pd.DataFrame:
        return pd.DataFrame({self.key: [keys[i] for i, _, _ in out], "since": [int(a) for _, a, _ in out], "alert": [b for _, _, b in out]})

    def handleInputRows(self, key, rows, timerValues):
        keys, since, flags = self._read()
        place = {k: i for i, k in enumerate(keys)}
        frame = pd.concat(list(rows)).sort_values(["at_micros", self.tie], kind="stable")
        names = [None if pd.isna(k) else k for k in frame[self.key].tolist()]
        for k in names:
            if k not in place:
                place[k] = len(keys)
                keys.append(k)
        more = len(keys) - len(since)
        begun, marks = [*since.tolist(), *[-1] * more], [*flags.tolist(), *([False, False] for _ in range(more))]
        out = []
        for k, at, now in zip(names, frame["at_micros"].tolist(), frame[self.state].tolist()):
            i = place[k]
            mark, first = marks[i], begun[i]
            if first >= 0 and not mark[0] and at > first + self.limit:
                out.append((i, first, "STUCK"))
                mark[0] = True
            if now == "PROVISIONING":
                if first < 0:
                    begun[i], mark[0] = at, False
            else:
                begun[i], mark[0] = -1, False
            ended = now in self.terminal
            if ended and not mark[1]:
                out.append((i, at, "DEAD"))
            mark[1] = ended
        since = np.array(begun, np.int64)
        out += [(i, since[i], "STUCK") for i in self._keep(keys, since, np.array(marks, bool).reshape(-1, 2), timerValues)]
        if out:  # an empty frame of texts can't be sent on
            yield self._frame(keys, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        keys, since, flags = self._read()
        due = (since >= 0) & ~flags[:, 0] & ((since + self.limit) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs())
        due |= (since >= 0) & ~flags[:, 0] & ((since + self.limit) // 1000 + 1 <= self._now(timerValues))
        out = [(i, since[i], "STUCK") for i in np.flatnonzero(due)]
        flags[due, 0] = True
        out += [(i, since[i], "STUCK") for i in self._keep(keys, since, flags, timerValues)]
        if out:  # an empty frame of texts can't be sent on
            yield self._frame(keys, out)

    def close(self) -> None:
        pass


def age_stream(
    stream: DataFrame, key: str, state: str, ts: str, tie: str, minutes: float = 8, lateness: str = "0 seconds", terminal: tuple[str, ...] = TERMINAL, clock: bool = False, groups: int = KEY_GROUPS
) -> DataFrame:
    """The age alert on a stream: key, since (when its state began) and alert, each told once.

    STUCK comes when a key has been provisioning for longer than the limit, by its own next row or by a timer if it
    falls silent: on the watermark, so that a restart tells the same alerts, or with clock=True on the wall clock, which needs
    no other key's rows. DEAD comes when it enters a terminal state. Keys are hashed into `groups`, each one state and one timer.
    """
    kind = dict(stream.dtypes)[key]
    dealt = F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group")
    rows = stream.withWatermark(ts, lateness).select(dealt, key, state, tie, ts, F.unix_micros(ts).alias("at_micros"))
    schema = f"{key} {kind}, since long, alert string"
    found = rows.groupBy("_group").transformWithStateInPandas(_Ages(key, kind, state, tie, int(minutes * 60_000_000), terminal, clock), schema, "append", "ProcessingTime" if clock else "EventTime")
    return found.withColumn("since", F.timestamp_micros("since"))


def watch_until_active(stream: DataFrame, key: str, state: str, ts: str, tie: str, checkpoint: str, seconds: float, every: str = "1 second") -> bool:
    """Follows the latest state of every key and ends by itself once all are ACTIVE (true), or after so many seconds."""
    done = threading.Event()

    def look(batch: DataFrame, number: int) -> None:
        one = batch.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "ACTIVE").alias("active")).first()
        if one.n and one.n == one.active:
            done.set()

    latest = stream.groupBy(key).agg(F.max_by(state, F.struct(ts, tie)).alias("state"))
    with own_state_store(stream.sparkSession):
        q = latest.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(look).start()
    try:
        end = time.monotonic() + seconds
        while not done.wait(0.1) and q.isActive and time.monotonic() < end:
            pass
        if q.exception():
            raise q.exception()
        return done.is_set()
    finally:
        q.stop()


def merge_cohort_sums(table: DataFrame, batch: DataFrame, cohort: str, value: str) -> DataFrame:
    """n, sum and sum of squares of each cohort, old and new together."""
    new = batch.groupBy(cohort).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    return table.unionByName(new).groupBy(cohort).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def gate_from_sums(sums: DataFrame, min_seeds: int = 2) -> DataFrame:
    from granary.operators.signal import gate_columns

    v = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    per = sums.filter("n > 0").select("n", (F.col("s") / F.col("n")).alias("m"), F.when(F.col("n") >= min_seeds, F.greatest(v, F.lit(0.0))).alias("v"))
    return gate_columns(per.agg(F.count(F.lit(1)).alias("n_cohorts"), F.avg("v").alias("within"), F.var_samp("m").alias("between")))


def label_rate(rows: DataFrame, ts: str, width: str, lateness: str | None = None, arrival: str | None = None, late: str = "1 minute") -> DataFrame:
    """Rows and their total in tumbling windows of event time; with a lateness it may be a stream in append mode.

    arrival: a column of when a row came; then also the median and the 95th percentile of its delay in seconds, and the
    share of rows that came later than `late`, from a sketch that merges across tasks and micro-batches.
    """
    source = rows.withWatermark(ts, lateness) if lateness else rows
    values = [F.count(F.lit(1)).alias("n"), F.sum(clean("value")).alias("total")]
    if arrival:
        delay = (F.unix_micros(F.col(arrival).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
        values += [F.percentile_approx(delay, F.lit(p), F.lit(10_000)).alias(f"p{int(100 * p)}") for p in (0.5, 0.95)]
        values.append(F.avg((F.col(arrival) > F.col(ts) + F.expr(f"interval {late}")).cast("double")).alias("late_share"))
    out = source.groupBy(F.window(ts, width).alias("w")).agg(*values)
    return out.select(F.col("w.start").alias("start"), *out.columns[1:])
