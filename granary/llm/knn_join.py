"""Exact top-k search by inner product: a Voronoi kNN join.

Largest inner products are nearest neighbours once data carry one more coordinate, sqrt(M - |x|^2) with
M the largest squared length, and queries, whose scale changes no order, are brought to length sqrt(M):
all points then lie on one sphere. Pivots, a bounded sample of the data that grows with its square root,
cut it into cells. A cell's summary is its number of rows and its k + 1 least distances to the pivot.
From the summaries follows, for each query, an upper bound of the distance to its k-th neighbour, and so
for each group of queries and each cell of data the interval of distances to the pivot that a neighbour
can have. A vector goes only to the groups whose interval holds it. Groups are merged where the bounds
say that this costs less, a copy of a row counting as COPY scores: where they prune nothing one group is
left for each block of queries, as in a blocked join. Each group is dealt into blocks of bounded size,
and every block is solved on its own.

Defined results: rows with a null id, or whose vector is null or holds null or non-finite components,
take no part. Shorter vectors count as padded with zeros. Rows that share an id are rows of their own:
each is a candidate for all but itself, and each query row has its own ranks. Components beyond 2**53
count as 2**53 and scores beyond a long as the long's ends. Ties go to the smaller id; with fewer
candidates than k all are returned. A zero query scores 0 with every row. An empty table, or one without queries,
gives no rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ._shared import stored

#: Pivots grow as the square root of the rows between these; groups have about GROUP_QUERIES queries.
LEAST_PIVOTS, MAX_PIVOTS, MAX_GROUPS, GROUP_QUERIES, BLOCK_ROWS = 16, 1024, 256, 64, 8192
#: Queries that meet a block of rows at once, and queries or rows whose distances are held at once.
BLOCK_QUERIES, HELD = 4096, 256
#: Scores that cost as much as one more copy of a row.
COPY = 128
LARGEST = float(1 << 53)
_SLACK = 1e-6


def _matrix(column, width: int) -> np.ndarray:
    """Rows of integers from a list column, padded to `width`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)] = values[ends[0] : ends[-1]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows, as longs: in doubles where those hold every sum exactly."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2.0**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of a row whose columns are in the order of ids; ties to the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def quantised(vectors: DataFrame, key: str, vector: str, scale: float = 1024.0) -> DataFrame:
    """id and v (integers floor(scale * x)) of the rows that take part."""
    x = F.col(vector)
    good = x.isNotNull() & F.col(key).isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(F.greatest(F.least(e.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long"))
    return vectors.filter(good).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b."""
    return (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)


class _Space:
    """The sphere that data and queries lie on, and distances to the pivots there."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots.astype(np.float64), most
        self.up = self.lift(self.pivots)

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (v**2).sum(axis=1), 0))

    def _to_pivots(self, v: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(_squares(v, self.pivots) + (extra[:, None] - self.up[None, :]) ** 2, 0))

    def data(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return self._to_pivots(v, self.lift(v))

    def queries(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        size = np.sqrt((v**2).sum(axis=1))
        return self._to_pivots(v * np.divide(math.sqrt(self.most), size, out=np.zeros_like(size), where=size > 0)[:, None], np.zeros(len(v)))


def _merged(low: np.ndarray, high: np.ndarray, ask: np.ndarray, pivots: np.ndarray, rows: np.ndarray, near: np.ndarray, far: np.ndarray):
    """The merge of groups (by nearest of their first pivots) that costs least: group of each, low, high, ask."""
    found, cheapest, many = None, math.inf, len(ask)
    while True:
        to = _squares(pivots[:many], pivots[: len(ask)]).argmin(axis=0)
        lows, highs, asks = np.full((many, low.shape[1]), np.inf), np.full((many, low.shape[1]), -np.inf), np.zeros(many, np.int64)
        np.minimum.at(lows, to, low)
        np.maximum.at(highs, to, high)
        np.add.at(asks, to, ask)
        may = ((lows <= far) & (highs >= near)) @ rows
        cost = (may * (COPY * -(-asks // BLOCK_QUERIES) + asks)).sum()
        if cost < cheapest:
            found, cheapest = (to, lows, highs, asks, may), cost
        if many == 1:
            return found
        many = max(1, many // 2)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", pivots: int | None = None, group_queries: int = GROUP_QUERIES, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of every query (id divisible by `every`).

    report: gets the number of groups and an upper bound of the copies of rows that are dealt to them.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = quantised(vectors, key, vector)
    stats = rows.agg(
        F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))),
        F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, e: F.greatest(a, F.abs(e)))),
        F.count(F.lit(1)), F.sum((F.col("id") % every == 0).cast("long")),
    ).first()
    most, width, largest, total, queries = stats
    if not queries:
        return spark.createDataFrame([], schema)
    width = max(width, 1)
    cells = pivots or min(MAX_PIVOTS, max(LEAST_PIVOTS, math.isqrt(total)))
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").select("v").limit(cells).collect()  # at most MAX_PIVOTS rows
    pv = np.array([list(r[0]) + [0] * (width - len(r[0])) for r in sample], np.int64)
    pv = pv[np.sort(np.unique(pv, axis=0, return_index=True)[1])]
    space = _Space(pv, most)
    cells = len(pv)
    kind = "<i4" if largest < 1 << 31 else "<i8"
    count = min(MAX_GROUPS, max(1, -(-queries // group_queries)), cells)
    group_of = _squares(space.pivots, space.pivots[:count]).argmin(axis=1)

    def open_(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype(np.int64)

    def place(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 8 * HELD):
                batch = whole.slice(at, 8 * HELD)
                ids, v = batch.column(1).to_numpy(), _matrix(batch.column(2), width)
                near = space.data(v)
                group, asks = np.full(len(ids), -1, np.int32), ids % every == 0
                if asks.any():
                    group[asks] = group_of[space.queries(v[asks]).argmin(axis=1)]
                packed = [r.tobytes() for r in v.astype(kind)]
                columns = [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(near.argmin(axis=1).astype(np.int32)), pa.array(near.min(axis=1)), pa.array(group)]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "id", "v", "cell", "near", "g"])

    placed = stored(rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "id", "v").mapInArrow(place, "rid long, id long, v binary, cell int, near double, g int"), "knn-placed")
    # summaries of the cells: k + 1 rows for each pivot at most
    held, near_least, near_most = np.zeros(cells, np.int64), np.full(cells, np.inf), np.full(cells, -np.inf)
    for c, n, a, b in placed.groupBy("cell").agg(F.count(F.lit(1)), F.min("near"), F.max("near")).collect():
        held[c], near_least[c], near_most[c] = n, a, b
    closest = placed.select("cell", "near", F.row_number().over(W.partitionBy("cell").orderBy("near")).alias("i")).filter(F.col("i") <= k + 1).collect()
    least = np.full((cells, k + 1), np.inf)
    for c, d, i in closest:
        least[c, i - 1] = d
    slack = _SLACK * max(math.sqrt(most), 1.0)
    saturates = largest * math.sqrt(most) * math.sqrt(width) >= 2.0**62  # scores may be cut to a long: then distances do not decide

    def bounds(batches):
        low, high, ask = np.full((count, cells), np.inf), np.full((count, cells), -np.inf), np.zeros(count, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                some = batch.slice(at, HELD)
                g, d = some.column(0).to_numpy(), space.queries(open_(some.column(1)))
                ups = (d[:, :, None] + least[None, :, :]).reshape(len(g), -1)
                # one of k + 1 rows may be the query's own
                reach = np.partition(ups, k, axis=1)[:, k] if ups.shape[1] > k else np.full(len(g), np.inf)
                reach = np.full(len(g), np.inf) if saturates else reach * (1 + _SLACK) + slack
                np.minimum.at(low, g, d - reach[:, None])
                np.maximum.at(high, g, d + reach[:, None])
                np.add.at(ask, g, 1)
        some = np.flatnonzero(ask)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(low[some]), pa.list_(pa.float64())), pa.array(list(high[some]), pa.list_(pa.float64())), pa.array(ask[some])], names=["g", "low", "high", "ask"])

    # one row for each group and task, and then for each group
    told = placed.filter("g >= 0").select("g", "v").repartition(min(64, max(1, queries // BLOCK_QUERIES))).mapInArrow(bounds, "g int, low array<double>, high array<double>, ask long")
    joined = told.select("g", "ask", F.posexplode(F.arrays_zip("low", "high")).alias("j", "x")).groupBy("g", "j").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"), F.sum("ask").alias("ask"))
    low, high, ask = np.full((count, cells), np.inf), np.full((count, cells), -np.inf), np.zeros(count, np.int64)
    for g, edges, n in joined.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("j", "low", "high"))), F.max("ask")).collect():  # MAX_GROUPS rows of MAX_PIVOTS pairs at most
        low[g], high[g], ask[g] = [e[1] for e in edges], [e[2] for e in edges], n
    to, low, high, ask, may = _merged(low, high, ask, space.pivots[:count], held, near_least - slack, near_most + slack)
    if report is not None:
        report.update(rows=total, groups=int((ask > 0).sum()), copies=int((may * (ask > 0)).sum()))
    data_blocks, query_blocks = np.maximum(1, -(-may // BLOCK_ROWS)), np.maximum(1, -(-ask // BLOCK_QUERIES))

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rid, cell, near, group = (batch.column(i).to_numpy() for i in (0, 3, 4, 5))
            out: list[list] = [[], [], [], [], []]  # row, group, query block, data block, is query
            spread = (rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            mine_to = np.where(group >= 0, to[group], -1)
            for g in np.flatnonzero(ask):
                for own in (False, True):
                    at = np.flatnonzero(mine_to == g) if own else np.flatnonzero((near >= low[g, cell] - slack) & (near <= high[g, cell] + slack))
                    copies = data_blocks[g] if own else query_blocks[g]
                    row, other = np.repeat(at, copies), np.tile(np.arange(copies), len(at))
                    mine = spread[row] % (query_blocks[g] if own else data_blocks[g])
                    for c, x in zip(out, (row, np.full(len(row), g), mine if own else other, other if own else mine, np.full(len(row), own))):
                        c.append(x)
            row, g, q, d, own = (np.concatenate(c) for c in out)
            for i in range(0, len(row), 1 << 14):
                part = slice(i, i + (1 << 14))
                take = pa.array(row[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[part].astype(np.int32)), pa.array(q[part].astype(np.int32)), pa.array(d[part].astype(np.int32)), pa.array(own[part].astype(bool)), *(batch.column(c).take(take) for c in range(3))],
                    names=["g", "qb", "db", "is_query", "rid", "id", "v"],
                )

    def solve(table: pa.Table) -> pa.Table:
        rid, ids, own, v = table.column("rid").to_numpy(), table.column("id").to_numpy(), table.column("is_query").to_numpy(), open_(table.column("v"))
        qi, order = np.flatnonzero(own), np.flatnonzero(~own)
        order = order[np.lexsort((rid[order], ids[order]))]
        rows_here, data = v[order], rid[order]
        out: list[list] = [[], [], []]
        for begin in range(0, len(qi), HELD):
            some = qi[begin : begin + HELD]
            for q, own_scores in zip(some.tolist(), products(v[some], rows_here)):
                other = np.flatnonzero(data != rid[q])
                at = other[best(own_scores[other], k)]
                for c, x in zip(out, (np.full(len(at), q), order[at], own_scores[at])):
                    c.append(x)
        q, at, score = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        return pa.table([pa.array(c, pa.int64()) for c in (rid[q], ids[q], rid[at], ids[at], score)], names=["qrid", "query_id", "rid", "vec_id", "score"])

    dealt = placed.mapInArrow(deal, "g int, qb int, db int, is_query boolean, rid long, id long, v binary")
    found = dealt.groupBy("g", "qb", "db").applyInArrow(solve, "qrid long, query_id long, rid long, vec_id long, score long")
    order = W.partitionBy("qrid").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
