"""Cohort construction: tables of items and pass rates in, tables of cohort members out.

Members: name, kind, pos, prompt_id, is_noisy. Shuffles are orders by md5 of seed and id, numbered in
buckets (functions.exprs.ordinal), so a cohort does not depend on partitioning and no task holds a pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from granary.functions.exprs import leading, ordinal, shuffle_key
from granary.sources.scratch import stored

MEMBERS = ["name", "kind", "pos", "prompt_id", "is_noisy"]


def _members(df: DataFrame, name: Column, kind: str, pos: Column, noisy: Column | None = None) -> DataFrame:
    return df.select(name.alias("name"), F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), "prompt_id", (F.lit(False) if noisy is None else noisy).alias("is_noisy"))


def shuffled(pool: DataFrame, seed, keys: list[str] = [], most: int | None = None) -> DataFrame:
    """The pool with rn = 1, 2, ... in the seed's order, within keys; only the first `most` of each, whose rows alone are sorted."""
    keyed = pool.withColumn("_key", shuffle_key(seed, *keys, "prompt_id"))
    if most is None:
        return ordinal(keyed, keys, "_key", tie=("prompt_id",)).drop("_key")
    return ordinal(leading(keyed, keys, "_key", most), keys, "_key", tie=("prompt_id",)).drop("_key").filter(F.col("rn") <= most)


def random_cohorts(pool: DataFrame, n: int, size: int, seed=0) -> DataFrame:
    """n full cohorts of `size`; fewer rows than n * size is an error."""
    if pool.limit(n * size).count() < n * size:
        raise ValueError(f"{n} cohorts of {size} need {n * size} rows")
    rn = F.col("rn") - 1
    return _members(shuffled(pool, seed, most=n * size), F.format_string("random-%03d", F.floor(rn / size)), "random", rn % size)


def chunk(df: DataFrame, size: int, keys: list[str] = []) -> DataFrame:
    """Chunk numbers for rows numbered by rn within keys; a partial last chunk is dropped."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    joined = df.join(sizes, keys) if keys else df.crossJoin(F.broadcast(sizes))  # without keys: one row
    return joined.withColumn("chunk", F.floor((F.col("rn") - 1) / size).cast("int")).filter((F.col("chunk") + 1) * size <= F.col("_size")).drop("_size")


def grouped_cohorts(pool: DataFrame, key: str, size: int, limit: int, seed=0) -> DataFrame:
    rows = chunk(shuffled(pool.filter(F.col(key).isNotNull()), seed, [key], limit * size), size, [key])
    label = F.regexp_replace(F.replace(F.col(key).cast("string"), F.lit(" "), F.lit("_")), "/", "-")
    return _members(rows, F.concat(F.lit(f"by_{key}-"), label, F.format_string("-%03d", "chunk")), f"by_{key}", (F.col("rn") - 1) % size)


#: Bands of pass rates, shares of corrupted answers and numbers of distinct prompts that the study compares.
BANDS, NOISE, DISTINCT = ((0.0, 0.2), (0.2, 0.5), (0.5, 0.8), (0.8, 1.0)), (0.0, 0.25, 0.5, 1.0), (1, 2, 4, 8)


def passband_cohorts(pool: DataFrame, size: int, bands=BANDS, limit: int | None = None, seed=0) -> DataFrame:
    """lo <= rate < hi, and a rate of 1 in any band with hi >= 1; `limit` cohorts of a band. The bands are a short parameter: a broadcast range join."""
    spark = pool.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(bands)], "band int, lo double, hi double"))
    r = F.col("pass_rate")
    inside = pool.join(table, (r >= F.col("lo")) & ((r < F.col("hi")) | ((r == 1.0) & (F.col("hi") >= 1.0))))
    rows = chunk(shuffled(inside, seed, ["band"], None if limit is None else limit * size), size, ["band"])
    return _members(rows, F.format_string("passband-%.1f_%.1f-%03d", "lo", "hi", "chunk"), "passband", (F.col("rn") - 1) % size)


def variance_decoupled(pool: DataFrame, size: int, seed=0, middle: float = 0.15, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """One cohort of rates near a half, and one of half low and half high rates; an error when the pool is short."""
    r, half = F.col("pass_rate"), size // 2
    part = F.when(F.abs(r - 0.5) <= middle, 0).when(r <= low, 1).when(r >= high, 2)
    rows = shuffled(pool.withColumn("part", part).filter("part is not null"), seed, ["part"], size).filter(F.col("rn") <= F.when(F.col("part") == 0, size).otherwise(half))
    have = {p: n for p, n in rows.groupBy("part").count().collect()}  # three rows at most
    if size % 2 or have.get(0, 0) < size or min(have.get(1, 0), have.get(2, 0)) < half:
        raise ValueError("too few rows of a kind, or an odd size")
    name = F.when(F.col("part") == 0, "vardecouple-highvar").otherwise("vardecouple-lowvar")
    pos = F.col("rn") - 1 + F.when(F.col("part") == 2, half).otherwise(0)
    return _members(rows, name, "variance_decoupled", pos)


def with_pass_stats(members: DataFrame, rates: DataFrame) -> DataFrame:
    """Members with their cohort's statistics of pass rates; null where no member has a rate."""
    return members.join(pass_stats(members, rates), "name", "left")


def label_noise_cohorts(pool: DataFrame, fracs: list[float], size: int, limit: int, seed=0) -> DataFrame:
    """Chunks dealt round-robin over the fractions; the first round-half-even(frac * size) members are noisy."""
    n = len(fracs)
    rows = chunk(shuffled(pool, seed, most=n * limit * size), size)
    frac = F.element_at(F.array(*map(F.lit, fracs)), (F.col("chunk") % n + 1).cast("int"))
    pos = (F.col("rn") - 1) % size
    name = F.format_string("labelnoise-%03d-%03d", (frac * 100).cast("int"), (F.col("chunk") + 1).cast("int"))
    return _members(rows, name, "label_noise", pos, pos < F.bround(frac * size))


def duplication_cohorts(pool: DataFrame, ks: list[int], size: int, limit: int, seed=0) -> DataFrame:
    """k distinct prompts cycled over `size` slots, `limit` times for each k; a k that the pool can't fill is skipped.

    Every cohort has its own order of the whole pool, so a pool of k prompts is enough for all of them.
    """
    spark, most = pool.sparkSession, max(ks)
    table = F.broadcast(spark.createDataFrame([(k, rep) for k in ks for rep in range(limit)], "k int, rep int"))
    orders = pool.select("prompt_id").crossJoin(table)  # ks x limit is a parameter
    picked = shuffled(orders, seed, ["k", "rep"], most).filter(F.col("rn") <= F.col("k"))
    full = picked.groupBy("k", "rep").agg(F.count(F.lit(1)).alias("n")).filter("n = k").select("k", "rep")  # one row for each cohort
    cycled = picked.join(F.broadcast(full), ["k", "rep"]).filter(F.col("rn") <= size)
    slots = cycled.withColumn("slot", F.explode(F.sequence(F.col("rn") - 1, F.lit(size - 1), F.col("k"))))
    return _members(slots, F.format_string("dup-k%02d-%03d", "k", "rep"), "duplication", F.col("slot"))


def build_all(
    pool: DataFrame, size: int, seed=0, random: int = 8, per_group: int = 3, per_band: int = 3, per_noise: int = 2, per_k: int = 2, fracs=NOISE, ks=DISTINCT, bands=BANDS, keys: tuple[str, ...] = ("level", "subject")
) -> DataFrame:
    """All families in build order, with `ord` numbering the cohorts and the statistics of their pass rates. Families that the pool can't fill are left out.

    pool: prompt_id and, for their families, pass_rate and the columns `keys`. Within families: noise by chunk,
    duplicates by k and repetition, bands and groups by value and chunk, high variance before low.
    """
    pool = stored(pool.select("prompt_id", *(c for c in ("pass_rate", *keys) if c in pool.columns)), "cohort-pool")  # every family reads it
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    first = F.regexp_extract("name", r"-(?:k)?([0-9.]+)[-_]", 1)
    families = [(lambda: label_noise_cohorts(pool, list(fracs), size, per_noise, seed), (F.lit(""), number)), (lambda: duplication_cohorts(pool, list(ks), size, per_k, seed), (first, number))]
    if "pass_rate" in pool.columns:
        families.append((lambda: passband_cohorts(pool, size, bands, per_band, seed), (first, number)))
        families.append((lambda: variance_decoupled(pool, size, seed), (F.lit(""), F.when(F.col("name") == "vardecouple-highvar", 0).otherwise(1))))
    for key in keys:
        if key in pool.columns:
            families.append((lambda key=key: grouped_cohorts(pool, key, size, per_group, seed), (F.col("name"), number)))
    families.append((lambda: random_cohorts(pool, random, size, seed), (F.lit(""), number)))
    out = None
    for i, (make, turn) in enumerate(families):
        try:
            part = make().withColumns({"_family": F.lit(i), "_turn": F.struct(turn[0].alias("a"), turn[1].alias("b"))})
        except ValueError:
            continue
        out = part if out is None else out.unionByName(part)
    out = stored(out, "cohort-members")  # the order of the cohorts, their members and their statistics read it
    order = out.select("_family", "_turn", "name").distinct().withColumn("ord", (F.row_number().over(W.orderBy("_family", "_turn", "name")) - 1).cast("int"))  # one row for each cohort
    out = out.join(order.select("_family", "name", "ord"), ["_family", "name"]).select(*MEMBERS, "ord")
    return with_pass_stats(out, pool.select("prompt_id", "pass_rate")) if "pass_rate" in pool.columns else out


def pass_stats(members: DataFrame, rates: DataFrame) -> DataFrame:
    """Mean and population variance of pass rates, mean r(1 - r) and count; ids without a rate are ignored, duplicates count."""
    r = F.col("pass_rate")
    return members.join(rates, "prompt_id").groupBy("name").agg(
        F.avg(r).alias("passrate_mean"), F.var_pop(r).alias("passrate_var"), F.avg(r * (1 - r)).alias("within_group_var_mean"), F.count(F.lit(1)).alias("n_with_rate")
    )


def candidate_schedule(pool: DataFrame, states: int, candidates: int, batch: int, seed=0) -> DataFrame:
    """For every state and candidate `batch` distinct items: the first of a row of hash draws over item numbers.

    Draws join the numbered pool, so work grows with the pool plus the draws, not with their product.
    Should a pair draw too few different numbers, the rows of draws are doubled.
    """
    spark = pool.sparkSession
    n, draws = pool.count(), 4 * batch
    if n < batch:
        raise ValueError("the pool is smaller than a batch")
    while True:
        slots = spark.range(states * candidates * draws).select(
            F.floor(F.col("id") / (candidates * draws)).cast("int").alias("state"), (F.floor(F.col("id") / draws) % candidates).cast("int").alias("candidate"), (F.col("id") % draws).alias("draw")
        )
        pick = F.conv(F.substring(shuffle_key(seed, "state", "candidate", "draw"), 1, 8), 16, 10).cast("long") % n
        fresh = slots.withColumn("_i", pick).groupBy("state", "candidate", "_i").agg(F.min("draw").alias("draw"))
        if fresh.groupBy("state", "candidate").count().agg(F.min("count")).first()[0] >= batch:
            break
        draws *= 2
    chosen = fresh.withColumn("pos", (F.row_number().over(W.partitionBy("state", "candidate").orderBy("draw")) - 1).cast("int")).filter(F.col("pos") < batch)
    numbers = shuffled(pool.select("prompt_id"), seed).select("prompt_id", (F.col("rn") - 1).alias("_i"))
    return chosen.join(numbers, "_i").select("state", "candidate", "pos", "prompt_id")


def limit_cohorts(members: DataFrame, most: int) -> DataFrame:
    return members.filter(F.col("ord") < most)


def shard_cohorts(members: DataFrame, i: int, n: int) -> DataFrame:
    return members.filter(F.pmod("ord", F.lit(n)) == i)


def cohort_rows(members: DataFrame, items: DataFrame, strict: bool = False) -> DataFrame:
    """Members with their item; unknown ids are dropped, or in strict mode an error that names some."""
    if strict:
        missing = [r[0] for r in members.join(items, "prompt_id", "left_anti").select("prompt_id").distinct().limit(5).collect()]
        if missing:
            raise KeyError(f"unknown prompts, such as {missing}")
    return members.join(items, "prompt_id")


def pass_rates(rollouts: DataFrame, prompt: str, reward: str = "reward") -> DataFrame:
    return rollouts.groupBy(prompt).agg(F.avg((F.col(reward) > 0.5).cast("double")).alias("pass_rate"))


def split_by_cohort(df: DataFrame, key: str, share: float, seed=0) -> DataFrame:
    """Whole cohorts on one side: the first max(1, floor(n * share)) of them in the seed's order are the test."""
    cohorts = df.select(F.col(key).alias("prompt_id")).distinct()
    numbered = shuffled(cohorts, seed)
    size = cohorts.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(share))).alias("_test"))
    marked = numbered.crossJoin(F.broadcast(size)).select(F.col("prompt_id").alias(key), (F.col("rn") <= F.col("_test")).alias("is_test"))  # one row
    return df.join(marked, key)
