"""Bootstrap intervals from replicate weights: no row is made for a draw.

Every row weighs Poisson(1) in each replicate, which is resampling with replacement with a number of draws that is
itself Poisson around n. The weight is a mix of the row's own number (MD5 of seed, keys and id) and the
replicate's, so it is the same in any engine and partitioning. A task makes the weights of all replicates
for a block of rows and keeps their weighted sums; what is shuffled is one row for each task, key and replicate,
however many rows there are.

With exact=True every replicate is n draws with replacement from the key's n rows instead, in two levels: blocks of 65,536
numbered rows share out a replicate's draws, then each block draws its share among its own rows, so again no row is made for a
draw, no task holds a key, and one row for each block and replicate is shuffled.

Quantiles need an order: weights below a window around the quantile are summed in the same way, and only the rows of the
window, whose share shrinks as one over the root of n, meet in a task. A replicate whose quantile lies outside the window widens it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from granary.functions.exprs import clean, ratio, row_numbers
from granary.sources.scratch import stored

REPLICATES, ALPHA = 2000, 0.05
#: Weights that are made at once, rows of a key whose window is the whole key, points of the grid that bounds larger windows.
WEIGHTS, WHOLE, GRID = 1 << 18, 1 << 14, 4096
#: Rows that draw among themselves, and draws under one pair of seeds.
BLOCK = 1 << 16
# The odd constants of the mix, and of the Weyl sequence that separates replicates.
MIX, WEYL = 0x45D9F3B, 0x9E3779B9
#: From which of 65,536 equal steps on a weight is 1, 2, ...: cumulative probabilities of a Poisson variable of mean 1.
STEPS = [round(65536 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(8)]
_WEIGHT = np.searchsorted(STEPS, np.arange(65536), "right").astype(np.uint8)


def weights(rows: np.ndarray, first: int, end: int) -> np.ndarray:
    """[row, replicate]: the weights of rows of these numbers in replicates first to end - 1."""
    x = rows.astype(np.uint32)[:, None] + (np.arange(first, end, dtype=np.uint64) * np.uint64(WEYL)).astype(np.uint32)[None, :]
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(MIX)
    return _WEIGHT[x >> np.uint32(16)]


def row_number_of(seed: int, *parts: str) -> Column:
    """32 bits of the MD5 of seed, keys and id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def _div(a: Column, b: Column) -> Column:
    return ratio(a, b)


def _pearson(w: Column, s: list[Column]) -> Column:
    x, y, xx, yy, xy = s
    vx, vy = xx - _div(x * x, w), yy - _div(y * y, w)
    ok = (vx > 1e-12) & (vy > 1e-12)
    return F.when(w > 0, F.when(ok, _div(xy - _div(x * y, w), F.sqrt(F.when(ok, vx * vy)))).otherwise(0.0))


#: Statistics of weighted sums: the summed columns of the inputs, and the value from the weight and the sums.
ADDITIVE: dict[str, tuple[Callable, Callable]] = {
    "mean": (lambda x: [x], lambda w, s: _div(s[0], w)),
    "sum": (lambda x: [x], lambda w, s: s[0]),
    "std": (lambda x: [x, x * x], lambda w, s: F.sqrt(F.greatest(_div(s[1], w) - _div(s[0], w) * _div(s[0], w), F.lit(0.0)))),
    "ratio": (lambda x, y: [x, y], lambda w, s: _div(s[0], s[1])),
    "pearson": (lambda x, y: [x, y, x * x, y * y, x * y], _pearson),
}


def _few_tasks(df: DataFrame) -> DataFrame:
    """A task's sums are as many however many rows it has read: few tasks with many rows shuffle less."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def _runs(batch: pa.RecordBatch, keys: list[str]):
    """Each key of a batch, as a slice of one, and the places of its rows."""
    if not keys:
        yield [], np.arange(batch.num_rows)
        return
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        entries = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode")
        code = code * (len(entries.dictionary) + 1) + entries.indices.to_numpy()
        code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        yield [batch.column(batch.schema.get_field_index(k)).slice(int(rows[0]), 1) for k in keys], rows


def replicate_sums(df: DataFrame, keys: list[str], number: str, values: list[str], replicates: int) -> DataFrame:
    """keys, rep, w and s0, s1, ...: the weight and the weighted sums of every replicate; rep -1 counts each row once."""
    columns = ["rep", "w", *(f"s{i}" for i in range(len(values)))]
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("rep", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in columns[1:])])

    def work(batches):
        held: dict[tuple, tuple[list, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (number, *values)]
            for key, rows in _runs(batch, keys):
                found = held.setdefault(tuple(k[0].as_py() for k in key), (key, np.zeros((1 + len(values), replicates + 1))))[1]
                sums = np.stack([np.ones(len(rows)), *(v[rows] for v in at[1:])])
                found[:, 0] += sums.sum(axis=1)
                step = max(1, WEIGHTS // replicates)
                for a in range(0, len(rows), step):
                    found[:, 1:] += sums[:, a : a + step] @ weights(at[0][rows[a : a + step]], 0, replicates).astype(np.float64)
        for key, found in held.values():
            repeated = [pa.concat_arrays([k] * (replicates + 1)) for k in key]
            yield pa.RecordBatch.from_arrays([*repeated, pa.array(np.arange(-1, replicates, dtype=np.int32)), *(pa.array(x) for x in found)], names=[*keys, *columns])

    found = _few_tasks(df.select(*keys, number, *values)).mapInArrow(work, schema)
    return found.groupBy(*keys, "rep").agg(*(F.sum(c).alias(c) for c in columns[1:]))


def drawn(text: str, n: int) -> np.ndarray:
    """n numbers of 32 bits under the two seeds that a text's MD5 begins with."""
    seeds = hashlib.md5(text.encode()).hexdigest()
    x = np.arange(n, dtype=np.uint32) * np.uint32(WEYL) + np.uint32(int(seeds[:8], 16))
    x ^= x >> np.uint32(16)
    x *= np.uint32(MIX)
    x ^= np.uint32(int(seeds[8:16], 16))
    x ^= x >> np.uint32(16)
    x *= np.uint32(MIX)
    return x


def _places(x: np.ndarray, n: int) -> np.ndarray:
    """Numbers of 32 bits as places 0 to n - 1."""
    return (x * 2.0**-32 * n).astype(np.int64)


def shares(text: str, rep: int, n: int, block: int = BLOCK) -> np.ndarray:
    """How many of a replicate's n draws fall into each block of n numbered rows."""
    blocks = -(-n // block)
    if blocks < 2:
        return np.full(blocks, n)
    found = np.zeros(blocks, np.int64)
    for i in range(blocks):
        x = drawn(f"{text}:{rep}:draws:{i}", min(block, n - i * block))
        found += np.bincount(_places(x, n) // block, minlength=blocks)
    return found


def drawn_sums(df: DataFrame, keys: list[str], number: str, values: list[str], replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """As replicate_sums, of as many draws with replacement as a key has rows; number: 0, 1, ... within keys."""
    columns = ["w", *(f"s{i}" for i in range(len(values)))]
    group = [*keys, "_block"]
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    turns = sizes.withColumns({"_text": text, "_rep": F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))})

    def deal(batches):
        for rows in batches:
            found = [shares(t, r, n, block) for t, r, n in zip(rows["_text"], rows["_rep"], rows["_n"])]
            many = np.array([len(f) for f in found], np.int64)
            if many.sum():
                out = rows.loc[rows.index.repeat(many)].drop(columns="_n")
                yield out.assign(_block=np.concatenate([np.arange(m) for m in many]), _share=np.concatenate(found))

    own = [df.schema[k] for k in keys]
    dealt = T.StructType([*own, T.StructField("_text", T.StringType()), T.StructField("_rep", T.IntegerType()), T.StructField("_block", T.LongType()), T.StructField("_share", T.LongType())])
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    dealt = turns.select(*keys, "_text", "_rep", "_n").repartition(parts, *keys, "_rep").mapInPandas(deal, dealt)
    placed = df.select(*keys, F.floor(F.col(number) / block).cast("long").alias("_block"), (F.col(number) % block).alias("_place"), *(F.col(v).cast("double").alias(f"_s{i}") for i, v in enumerate(values)))
    schema = T.StructType([*own, T.StructField("rep", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in columns)])

    def draw(rows: pd.DataFrame, turns: pd.DataFrame) -> pd.DataFrame:
        m, at = len(rows), int(rows["_block"].iloc[0])
        sums = np.ones((len(columns), m))
        for i in range(len(values)):
            sums[i + 1, rows["_place"].to_numpy()] = rows[f"_s{i}"].to_numpy()
        out = np.zeros((len(columns), len(turns) + 1))
        out[:, -1] = sums.sum(axis=1)
        for j, (t, r, n) in enumerate(zip(turns["_text"], turns["_rep"], turns["_share"])):
            times = np.bincount(_places(drawn(f"{t}:{r}:rows:{at}", n), m), minlength=m)
            out[:, j] = sums @ times.astype(np.float64)
        got = pd.DataFrame({"rep": np.append(turns["_rep"].to_numpy(), -1).astype(np.int32), **dict(zip(columns, out))})
        for i, k in enumerate(keys):
            got.insert(i, k, [rows[k].iloc[0]] * len(got))
        return got

    # parts by number: few rows stand for many draws, and would be put into few tasks
    found = placed.repartition(parts, *group).groupBy(*group).cogroup(dealt.repartition(parts, *group).groupBy(*group)).applyInPandas(draw, schema)
    return found.groupBy(*keys, "rep").agg(*(F.sum(c).alias(c) for c in columns))


def _quantiles(df: DataFrame, keys: list[str], number: str, value: str, p: float, replicates: int) -> DataFrame:
    """keys, rep and stat: the linear quantile of every replicate, exactly."""
    width = 6.0
    plain = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    grid = F.percentile_approx(value, F.array(*(F.lit(i / GRID) for i in range(GRID + 1))), F.lit(20 * GRID))
    bounds = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), grid.alias("_grid")).select(*plain, "_n", "_grid"), "bootstrap-bounds")
    while True:
        far = F.lit(width * math.sqrt(p * (1 - p)) + 1e-9) / F.sqrt(F.greatest("_n", F.lit(1)))
        whole = (F.col("_n") <= WHOLE) | F.lit(width > 1e4)
        low, high = F.floor((F.lit(p) - far) * GRID) - 1, F.ceil((F.lit(p) + far) * GRID) + 1
        # bounds beyond the grid are open
        cut = bounds.select(
            *(f"_k{i}" for i in range(len(keys))),
            F.when(whole | (low < 0), float("-inf")).otherwise(F.get("_grid", F.greatest(low, F.lit(0)).cast("int"))).alias("_low"),
            F.when(whole | (high > GRID), float("inf")).otherwise(F.get("_grid", F.least(high, F.lit(GRID)).cast("int"))).alias("_high"),
        )
        placed = df.join(cut, same) if keys else df.crossJoin(F.broadcast(cut))  # one row
        placed = placed.withColumn("_below", (F.col(value) < F.col("_low")).cast("double"))
        outside = replicate_sums(placed.filter((F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high"))), keys, number, ["_below"], replicates)
        window = placed.filter(F.col(value).between(F.col("_low"), F.col("_high"))).select(*keys, F.col(number).alias("_number"), F.col(value).cast("double").alias("_value"))
        names = ("rep", "stat")
        schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("rep", T.IntegerType()), T.StructField("stat", T.DoubleType()), T.StructField("_out", T.BooleanType())])

        def settle(rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_value", kind="stable")
            v, own = rows["_value"].to_numpy(), rows["_number"].to_numpy()
            below, beside = np.zeros(replicates + 1), np.zeros(replicates + 1)
            below[sums["rep"].to_numpy() + 1], beside[sums["rep"].to_numpy() + 1] = sums["s0"], sums["w"]
            stat, out = np.full(replicates + 1, np.nan), np.zeros(replicates + 1, bool)
            step = max(1, 8 * WEIGHTS // max(len(v), 1))
            for first in range(-1, replicates, step):
                end = min(first + step, replicates)
                w = weights(own, max(first, 0), end) if end > 0 else np.zeros((len(v), 0), np.uint8)
                if first < 0:
                    w = np.concatenate([np.ones((len(v), 1), np.uint8), w], axis=1)
                upto = np.cumsum(w, axis=0, dtype=np.int64)
                for j in range(w.shape[1]):
                    r = first + 1 + j
                    inside = int(upto[-1, j]) if len(v) else 0
                    total = inside + beside[r]
                    if total > 0:
                        at = p * (total - 1)
                        a, b = math.floor(at) - below[r], math.ceil(at) - below[r]
                        if a < 0 or b >= inside:
                            out[r] = True
                        else:
                            x, y = (v[np.searchsorted(upto[:, j], k, "right")] for k in (a, b))
                            stat[r] = x + (y - x) * (at - math.floor(at))
            got = pd.DataFrame({"rep": np.arange(-1, replicates, dtype=np.int32), "stat": stat, "_out": out})
            source = rows if len(rows) else sums
            for i, k in enumerate(keys):
                got.insert(i, k, [source[k].iloc[0]] * len(got))
            return got

        one = [F.lit(1).alias("_one")] if not keys else []
        group = keys or ["_one"]
        if not keys:
            window, outside = window.select("*", *one), outside.select("*", *one)
        found = stored(window.groupBy(*group).cogroup(outside.groupBy(*group)).applyInPandas(settle, schema), "bootstrap-quantiles")
        if found.filter("_out").isEmpty():
            return found.select(*keys, *names)
        width *= 8


def bootstrap_ci(
    df: DataFrame, keys: list[str], columns: list[str], stat: str | float = "mean", replicates: int = REPLICATES, seed: int = 0, tie: str = "id", alpha: float = ALPHA, exact: bool = False, block: int = BLOCK
) -> DataFrame:
    """keys, n, point, low, high and replicates: a statistic of each key's rows and its percentile interval.

    stat: mean, sum, std, ratio (of two columns' sums), pearson (of two columns), median, or a number p for
    the linear p-quantile. Rows that lack a number in any column are left out. Rows of one key and id weigh
    alike. exact: n draws with replacement of a key's n rows, numbered by id, in each replicate, for statistics of sums; blocks of
    `block` rows. Replicates in which nothing weighs are not counted. Without keys an empty input gives one row of
    NaN; with keys it gives no rows.
    """
    p = 0.5 if stat == "median" else stat if isinstance(stat, float) else None
    if exact and p is not None:
        raise ValueError("exact draws are for statistics of sums")
    rows = df.select(*keys, F.col(tie).alias("_id") if exact else row_number_of(seed, *keys, tie).alias("_row"), *(clean(c).alias(f"_v{i}") for i, c in enumerate(columns)))
    for i in range(len(columns)):
        rows = rows.filter(F.col(f"_v{i}").isNotNull())
    if p is None:
        made, value = ADDITIVE[str(stat)]
        parts = made(*(F.col(f"_v{i}") for i in range(len(columns))))
        if exact:
            rows = stored(rows, "bootstrap-rows")  # sizes and numbers read it
            numbered = row_numbers(rows, keys, {"_row": ("_id", False)}, "_v0").withColumn("_row", F.col("_row") - 1)
            rows = stored(numbered, "bootstrap-numbers")
        rows, names = rows.select(*keys, "_row", *(x.alias(f"_s{i}") for i, x in enumerate(parts))), [f"_s{i}" for i in range(len(parts))]
        sums = drawn_sums(rows, keys, "_row", names, replicates, seed, block) if exact else replicate_sums(rows, keys, "_row", names, replicates)
        if exact:
            sums = stored(sums, "bootstrap-sums")  # the replicates and the count read it
        found = sums.select(*keys, "rep", F.when(F.col("w") > 0, value(F.col("w"), [F.col(f"s{i}") for i in range(len(parts))])).alias("stat"))
        found = found.join(sums.filter("rep = -1").select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("w").alias("_n")), _same(keys)) if keys else found.crossJoin(F.broadcast(sums.filter("rep = -1").select(F.col("w").alias("_n"))))
    else:
        rows = stored(rows, "bootstrap-rows")  # bounds, sums and windows read it
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n")
        found = _quantiles(rows, keys, "_row", "_v0", p, replicates)
        found = found.join(sizes, _same(keys)) if keys else found.crossJoin(F.broadcast(sizes))
    good = F.when((F.col("rep") >= 0) & ~F.isnan("stat"), F.col("stat"))
    out = found.groupBy(*keys).agg(
        F.coalesce(F.max("_n"), F.lit(0)).cast("long").alias("n"), F.max(F.when(F.col("rep") < 0, F.col("stat"))).alias("point"),
        F.percentile(good, F.lit(alpha / 2)).alias("low"), F.percentile(good, F.lit(1 - alpha / 2)).alias("high"), F.count(good).alias("replicates"),
    )
    return out.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("point", "low", "high")})


def _same(keys: list[str]) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return same


def paired_bootstrap_ci(a: DataFrame, b: DataFrame, keys: list[str], group: str, value: str, stat: str | float = "mean", **options) -> DataFrame:
    """The interval of a statistic of a's value less b's, over the groups that both arms have: one row of each arm a group."""
    names = [*keys, group]
    other = b.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), F.col(value).alias("_other"))
    both = a.join(other, _same(names)).select(*names, (clean(value) - clean("_other")).alias("difference"))
    return bootstrap_ci(both, keys, ["difference"], stat, tie=group, **options)
