"""Rank correlations of many columns with one other, by group and over all rows, without a window over a group.

Ranks are ordinal, ties in the order of an id, so both sides of n rows are permutations of 1 to n and their correlation follows
from the sum of products. Rows are dealt in ranges of (y, id), where counts of the ranges before give the ranks of y among the
rows that have a column; then, once, in ranges of (column, id), as arrays of one task's rows for a range. There the ranks
of the column start at 1: their offset, the same for a whole range, multiplies the range's sum of the other ranks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from granary.functions.exprs import LARGE_GROUP

#: Groups that have offsets of their own in every range, and rows of a range's size that its bounds are taken from.
FEW, DRAWN = 100, 128
_IDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _places(values: np.ndarray, ids: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many edges (value, id) lie at or before each row."""
    low, high = np.searchsorted(edges[0], values, "left"), np.searchsorted(edges[0], values, "right")
    out, tied = low.copy(), low < high
    for a in np.unique(low[tied]):
        of = tied & (low == a)
        out[of] = a + np.searchsorted(edges[1][a : high[of][0]], ids[of], "right")
    return out


def _edges(values: np.ndarray, ids: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, values))
    at = order[(np.arange(1, ranges) * len(order)) // ranges] if len(order) else order
    return values[at], ids[at]


def _within(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal codes together, where they begin, and each row's number, from 1, among the rows of its code."""
    order = np.argsort(codes, kind="stable")
    begin = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0)) if len(codes) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(codes)))
    number = np.empty(len(codes), np.int64)
    number[order] = np.arange(len(codes)) - np.repeat(begin, size) + 1
    return order, begin, number


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _flat(t: pa.Table, name: str) -> np.ndarray:
    column = t.column(name).combine_chunks()
    return (column if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks)).flatten().to_numpy(zero_copy_only=False)


def rank_correlations(df: DataFrame, group: str, columns: list[str], y: str, tie: str = "id", pool: str | None = None, block: int = LARGE_GROUP) -> DataFrame | None:
    """feature, `group`, n and spearman of each column with y among the rows that have both; `pool` names a further group of all rows.

    `df` is read four times. None if there are more than FEW groups, or ids are neither whole numbers nor text. Bounds of ranges come from a few rows for each range and decide
    only which task does what.
    """
    p, kind = len(columns), df.schema[tie].dataType.simpleString()
    if kind not in _IDS:
        return None
    have = df.filter(F.col(y).isNotNull())
    kinds = have.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).limit(FEW + 1).collect()
    if len(kinds) > FEW:
        return None
    named = [r["_g"] for r in kinds if r["_g"] is not None]
    total, n_groups = sum(r["_n"] for r in kinds), len(named) + 1
    code = F.lit(len(named))
    if named:
        code = F.coalesce(F.try_element_at(F.create_map(*(e for i, v in enumerate(named) for e in (F.lit(v), F.lit(i)))), F.col(group)), code)
    rows = have.select(code.cast("tinyint").alias("_g"), F.col(tie).alias("_id"), F.col(y).cast("double").alias("_y"), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)))
    ranges = max(1, -(-total // block))
    none = (np.zeros(0), np.zeros(0))
    y_edges, edges = none, [none] * p
    if ranges > 1:
        drawn = rows.filter(F.pmod(F.xxhash64("_id"), F.lit(max(1, total // (DRAWN * ranges)))) == 0).drop("_g").toPandas()
        ids = drawn["_id"].to_numpy()
        y_edges = _edges(drawn["_y"].to_numpy(float), ids, ranges)
        edges = [_edges(v[~np.isnan(v)], ids[~np.isnan(v)], ranges) for v in (drawn[f"_x{i}"].to_numpy(float) for i in range(p))]

    @F.pandas_udf("int")
    def range_of(v: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(_places(v.to_numpy(float), i.to_numpy(), y_edges).astype(np.int32))

    rows = rows.withColumn("_range", range_of("_y", "_id") if ranges > 1 else F.lit(0))
    own = np.zeros((ranges, p, n_groups), np.int64)
    for r in rows.groupBy("_range", "_g").agg(*(F.count(f"_x{i}") for i in range(p))).collect():  # a row for each range and group
        own[r[0], :, r[1]] = r[2:]
    before, n = np.cumsum(own, axis=0) - own, own.sum(axis=0)
    numbers, np_number = ("int", np.int32) if total < 1 << 31 else ("long", np.int64)

    def deal(t: pa.Table) -> pa.Table:
        at = t.column("_range")[0].as_py()
        t = t.take(pa.array(np.argsort(_column(t, "_id"), kind="stable")))
        ids, codes, by_y = _column(t, "_id"), _column(t, "_g"), np.argsort(_column(t, "_y"), kind="stable")
        out: dict[str, list] = {c: [] for c in ("_f", "_xb", "_id", "_x", "_c", "_r", "_q")}
        ends = [np.zeros(1, np.int64)]
        for i in range(p):
            column = t.column(f"_x{i}").combine_chunks()
            has = column.is_valid().to_numpy(zero_copy_only=False)
            turn = by_y[has[by_y]]
            if not len(turn):
                continue
            x, rank, pooled = _column(t, f"_x{i}"), np.zeros(len(ids), np_number), np.zeros(len(ids), np_number)
            rank[turn] = _within(codes[turn])[2] + before[at, i][codes[turn]]
            pooled[turn] = np.arange(1, len(turn) + 1) + before[at, i].sum()
            order = np.argsort(x, kind="stable")
            order = order[has[order]]
            place = _places(x[order], ids[order], edges[i])
            begin = np.flatnonzero(np.append(True, np.diff(place) != 0))
            out["_f"].append(np.full(len(begin), i, np.int32))
            out["_xb"].append(place[begin].astype(np.int32))
            ends.append(ends[-1][-1] + np.append(begin[1:], len(order)))
            for c, v in (("_id", ids), ("_x", x), ("_c", codes), ("_r", rank), ("_q", pooled)):
                out[c].append(v[order])
        offsets = pa.array(np.concatenate(ends).astype(np.int32))
        wide = {c: np.concatenate(v) if v else np.zeros(0, np.int32) for c, v in out.items() if c != "_q" or pool is not None}
        made = [pa.array(v) if c in ("_f", "_xb") else pa.ListArray.from_arrays(offsets, pa.array(v).cast(types[c])) for c, v in wide.items()]
        return pa.Table.from_arrays(made, names=list(wide))

    types = {"_id": _IDS[kind], "_x": pa.float64(), "_c": pa.int8()}
    types |= dict.fromkeys(("_r", "_q"), pa.int32() if numbers == "int" else pa.int64())
    schema = f"_f int, _xb int, _id array<{kind}>, _x array<double>, _c array<tinyint>, _r array<{numbers}>" + (f", _q array<{numbers}>" if pool is not None else "")
    dealt = rows.groupBy("_range").applyInArrow(deal, schema)

    def add(t: pa.Table) -> pa.Table:
        i, place, x, ids, codes, rank = t.column("_f")[0].as_py(), t.column("_xb")[0].as_py(), *(_flat(t, c) for c in ("_x", "_id", "_c", "_r"))
        order = np.lexsort((ids, x))
        codes, rank = codes[order], rank[order] - (n[i][codes[order]] + 1) / 2
        by, begin, number = _within(codes)
        found = [(int(codes[by[a]]), int(m), float(s), float(b)) for a, m, s, b in zip(begin, np.diff(np.append(begin, len(by))), np.add.reduceat((number * rank)[by], begin), np.add.reduceat(rank[by], begin))]
        if pool is not None:
            q = _flat(t, "_q")[order] - (n[i].sum() + 1) / 2
            found.append((-1, len(q), float(np.arange(1, len(q) + 1) @ q), float(q.sum())))
        g, m, s, b = zip(*found)
        return pa.table({"_f": pa.array([i] * len(g), pa.int32()), "_xb": pa.array([place] * len(g), pa.int32()), "_g": pa.array(g, pa.int32()), "_n": pa.array(m, pa.int64()), "_s": pa.array(s, pa.float64()), "_b": pa.array(b, pa.float64())})

    sums = dealt.groupBy("_f", "_xb").applyInArrow(add, "_f int, _xb int, _g int, _n long, _s double, _b double")
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy("_f", "_g").orderBy("_xb").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    size = F.sum("_n").cast("double")
    out = sums.withColumn("_before", earlier).groupBy("_f", "_g").agg(F.sum("_n").alias("n"), (F.sum(F.col("_s") + F.col("_before") * F.col("_b")) - (size + 1) / 2 * F.sum("_b")).alias("_s"))
    n_ = F.col("n").cast("double")
    value = F.when(F.col("n") >= 2, F.try_divide(F.col("_s"), n_ * (n_ * n_ - 1) / 12)).otherwise(0.0)
    label = F.get(F.array(*map(F.lit, named), F.lit(None)), F.col("_g")).cast("string" if pool is not None else df.schema[group].dataType)
    return out.select(
        F.get(F.array(*map(F.lit, columns)), F.col("_f")).alias("feature"), (label if pool is None else F.when(F.col("_g") < 0, F.lit(pool)).otherwise(label)).alias(group), "n", value.alias("spearman")
    )
