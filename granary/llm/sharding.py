"""Sharding by balanced label propagation.

Documents are linked when their texts are equal. They start in shards of row counts at most one
apart, in hash order. Each round counts the members of every group of linked documents by shard; the
shard with most of them is the group's target, and members elsewhere ask to move there. A quota for
each pair of shards, from a matrix of shards x shards, accepts as many moves as the target can make
room for; documents without links fill the places that movers leave, so every shard keeps its count
exactly. Groups larger than LINK_ROWS, or than a part of a shard, are salted into parts that fit. Rounds
end when no move is accepted: each accepted move adds to the most members that a group has in one shard,
so they do end. The law that holds is `rows`.

Numbers within shards are given in two steps, counts of hash buckets first, so no window holds a
whole shard. Rows of frequent texts, at most FREQUENT of them, learn their group's size by a broadcast,
all others by a join. All tables that are used again are written to the shared folder.

Defined results: a null text counts as empty, with 16 bytes; a text of any length counts whole. Repeated rows are rows of their own,
linked like all equal texts, as are rows with a null key. Fewer rows than shards leave shards empty. Columns of the input
beside key and text take no part, whatever their names. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ._shared import release, stored, with_value

SHARDS, PARTS = 40, 4
#: Most rows of a part of a group that moves as one.
LINK_ROWS = 10_000
#: Rows of a bucket that is numbered in one sort; the buckets grow with the rows.
BUCKET_ROWS, LEAST_BUCKETS = 200_000, 64


def buckets_for(rows: int, groups: int = 1) -> int:
    """Buckets of each of `groups` groups of all the rows, so that a bucket keeps to BUCKET_ROWS."""
    return max(LEAST_BUCKETS, -(-rows // (BUCKET_ROWS * groups)))


def gapless(df: DataFrame, keys: list[str], into: str, buckets: int, by: str = "_h", order: tuple[str, ...] = ()) -> DataFrame:
    """`into`: numbers from 0 without gaps within `keys`, in the order of buckets of `by`, then (order, by, _rid)."""
    dealt = df.withColumn("_b", F.pmod(F.col(by), F.lit(buckets)))
    counts = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_b").orderBy(*order, by, "_rid")
    return dealt.withColumn("_i", F.row_number().over(inside)).join(offsets, [*keys, "_b"]).withColumn(into, F.col("_before") + F.col("_i") - 1).drop("_b", "_i", "_before")


def quotas(wish: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Moves to accept for each pair of shards: none may gain more rows than it has free documents to send away."""
    take = wish.copy()
    while True:
        excess = take.sum(axis=0) - take.sum(axis=1) - free
        j = int(excess.argmax())
        if excess[j] <= 0:
            return take
        cut = int(excess[j])
        for i in np.argsort(-take[:, j], kind="stable"):
            less = min(cut, int(take[i, j]))
            take[i, j] -= less
            cut -= less
            if not cut:
                break


def propagate(rows: DataFrame, shards: int, buckets: int = LEAST_BUCKETS) -> DataFrame:
    """rows (_rid, _h, _lh, _link, shard) with links moved together; every shard keeps its count."""
    spark = rows.sparkSession
    while True:
        counts = rows.filter("_link is not null").groupBy("_link", "shard").agg(F.count(F.lit(1)).alias("n"))
        target = counts.groupBy("_link").agg(F.max(F.struct("n", F.pmod(F.xxhash64("_link", "shard"), F.lit(1 << 20)).alias("r"), "shard")).alias("t"))
        moving = counts.alias("c").join(target, "_link").filter(F.col("c.shard") != F.col("t.shard")).select("_link", "c.shard", F.col("t.shard").alias("to"), (F.col("t.n") - F.col("c.n")).alias("gain"), "n")
        moving = stored(moving, "sharding-wishes")
        wish = np.zeros((shards, shards), np.int64)
        for i, j, n in moving.groupBy("shard", "to").agg(F.sum("n")).collect():  # at most shards x shards rows
            wish[i, j] = n
        free = np.zeros(shards, np.int64)
        for i, n in rows.filter("_link is null").groupBy("shard").count().collect():
            free[i] = n
        take = quotas(wish, free)
        if not take.sum():
            release(moving)
            return rows
        net = take.sum(axis=0) - take.sum(axis=1)
        cells = [(int(i), int(j), int(take[i, j])) for i, j in zip(*np.nonzero(take))]
        quota = spark.createDataFrame(cells, "shard int, to int, quota long")
        # documents without links take no part in the join: they have no key to be dealt by
        linked = rows.filter("_link is not null").join(moving.drop("n"), ["_link", "shard"], "left")
        asks = gapless(linked.filter("to is not null"), ["shard", "to"], "_turn", buckets, "_lh").join(F.broadcast(quota), ["shard", "to"], "left")
        moved = asks.select("_rid", "_h", "_lh", "_link", F.when(F.col("_turn") < F.coalesce("quota", F.lit(0)), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        # free documents leave shards that gained and fill those that lost, in the order of their numbers
        gains = [(int(j), int(net[j])) for j in np.flatnonzero(net > 0)]
        starts = np.cumsum([0] + [n for _, n in gains])
        leave = spark.createDataFrame([(j, n, int(s)) for (j, n), s in zip(gains, starts)] or [(-1, 0, 0)], "shard int, leave long, begin long")
        fills, at = [], 0
        for j in np.flatnonzero(net < 0):
            fills.append((int(j), at, at - int(net[j])))
            at -= int(net[j])
        lost = spark.createDataFrame(fills or [(-1, 0, 0)], "fill int, low long, high long")
        single = gapless(rows.filter("_link is null"), ["shard"], "_turn", buckets).join(F.broadcast(leave), "shard", "left")
        single = single.withColumn("_place", F.when(F.col("_turn") < F.coalesce("leave", F.lit(0)), F.col("begin") + F.col("_turn")))
        single = single.join(F.broadcast(lost), (F.col("_place") >= F.col("low")) & (F.col("_place") < F.col("high")), "left")
        single = single.select("_rid", "_h", "_lh", "_link", F.coalesce("fill", "shard").alias("shard"))
        stay = linked.filter("to is null").select("_rid", "_h", "_lh", "_link", "shard")
        after = stored(moved.unionByName(single).unionByName(stay), "sharding-rows")
        for old in (rows, moving):  # a round leaves one table behind, however many there are
            release(old)
        rows = after


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard (null under the law `rows`)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("_key"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.sha2(raw, 256).alias("_text"))
    base = stored(base.withColumn("_rid", F.monotonically_increasing_id()).withColumn("_h", F.xxhash64("_key", "_rid")), "sharding-base")
    sizes = base.groupBy("_text").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1")
    many = base.count()
    most, buckets = max(1, min(many // shards // PARTS, LINK_ROWS)), buckets_for(many, shards)
    salt = F.pmod(F.col("_h"), F.ceil(F.col("_many") / most))
    rows = with_value(base.select("_rid", "_h", "_text"), sizes, "_text", "_many", many)
    link = F.when(F.col("_many").isNotNull(), F.concat_ws(":", "_text", salt.cast("string")))
    rows = rows.select("_rid", "_h", link.alias("_link"), F.xxhash64("_text").alias("_lh"))
    start = gapless(rows, [], "_number", buckets_for(many)).select("_rid", "_h", "_lh", "_link", (F.col("_number") % shards).cast("int").alias("shard"))
    placed = propagate(stored(start, "sharding-rows"), shards, buckets)
    slots = gapless(placed, ["shard"], "slot", buckets).select("_rid", "shard", F.col("slot").cast("long").alias("slot"))
    return base.join(slots, "_rid").select(F.col("_key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
