"""Column expressions that keep both engines and any partitioning to one result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from granary.sources.scratch import stored

#: Deviations below this count as zero: sums in another order leave rests of about 1e-15.
FLAT = 1e-9


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r9(c) -> Column:
    """Nine decimals; never negative zero."""
    return F.round(col(c), 9) + F.lit(0.0)


def ratio(a, b) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def shuffle_key(seed, *parts) -> Column:
    """A fixed pseudo-random order: md5 of seed and ids, the same wherever it runs."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(col(p).cast("string") for p in parts)))


def clean(c) -> Column:
    """Numbers and booleans as doubles; null for NaN, infinities and all else, text that holds a number too."""
    x = F.when(F.typeof(col(c)).isin("string", "binary"), None).otherwise(col(c).try_cast("double"))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


# The characters that count as white space in Unicode.
WHITE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c) -> Column:
    """Without white space, of any kind, at either end."""
    return F.trim(col(c), F.lit(WHITE))


def blank_to_null(c) -> Column:
    return F.nullif(col(c), F.lit(""))


def pearson(x, y) -> Column:
    """Aggregate: correlation of the rows that have both; 0 for fewer than two rows or a constant side."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(a), F.stddev_pop(b)
    ok = (F.count(a) >= 2) & (sx > FLAT) & (sy > FLAT)
    return F.when(ok, F.try_divide(F.covar_pop(a, b), F.when(ok, sx * sy))).otherwise(F.lit(0.0))


def ordinal(df: DataFrame, keys: list[str], key: str, into: str = "rn", tie: tuple[str, ...] = ()) -> DataFrame:
    """`into`: 1, 2, ... within `keys` by the hex key, without one task for a whole group.

    The first three hex digits are ordered buckets; counts of buckets before give each row its offset.
    """
    dealt = df.withColumn("_b", F.substring(key, 1, 3))
    counts = dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_ob"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_b").orderBy(key, *tie)
    same = F.col("_b") == F.col("_ob")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = dealt.withColumn("_i", F.row_number().over(inside)).join(offsets, same).withColumn(into, (F.col("_before") + F.col("_i")).cast("long"))
    return out.drop("_b", "_ob", "_before", "_i", *(f"_k{i}" for i in range(len(keys))))


def leading(df: DataFrame, keys: list[str], key: str, most: int) -> DataFrame:
    """Rows within `keys` that may be among the first `most` by the hex key: whole buckets of its first three digits, found by their counts.

    What is exchanged is counts, and of the rows some n / 4,096 + `most` of a group are left.
    """
    counts = df.groupBy(*keys, F.substring(key, 1, 3).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    needed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < most)
    needed = stored(needed.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_b"), "leading-buckets")
    same = F.substring(key, 1, 3) == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(needed, same, "left_semi")


#: Rows of a group that one task may sort for its ranks.
LARGE_GROUP = 200_000


def row_numbers(df: DataFrame, keys: list[str], orders: dict[str, tuple[str, bool]], tie: str, large: int = LARGE_GROUP) -> DataFrame:
    """Columns into -> (value, descending): 1, 2, ... within keys by value, then tie, both reversed if descending.

    Groups of up to `large` rows are sorted whole. If one is larger, rows are dealt in sorted ranges of keys, value and tie, each
    written once with the row's place in its range; where a key begins in a range and the counts of its ranges before turn places
    into numbers, so they are exact, rows tied in value, as many as there may be, are cut by their ties, numbers or texts, and
    each order costs one exchange.
    """

    def by(down: bool, *columns: str) -> list[Column]:
        return [F.desc(c) if down else F.asc(c) for c in columns]

    whole = W.partitionBy(*(keys or [F.lit(0)]))
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    if not largest[0] or largest[0] <= large:
        return df.withColumns({into: F.row_number().over(whole.orderBy(*by(down, value, tie))) for into, (value, down) in orders.items()})
    for into, (value, down) in orders.items():
        columns, order = df.columns, [*keys, *by(down, value, tie)]
        ranges = df.repartitionByRange(-(-largest[1] // large) + 1, *order).sortWithinPartitions(*order)
        df = stored(ranges.withColumn("_range_place", F.monotonically_increasing_id()), "rank-ranges")  # the range's number in the bits above 33
        df = df.withColumn("_range", F.shiftright("_range_place", 33))
        counts = df.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_range_place").alias("_first"))
        before = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
        offsets = stored(counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_range_of"), shift.alias("_shift")), "rank-offsets")
        same = F.col("_range") == F.col("_range_of")
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        df = df.join(offsets, same).select(*columns, (F.col("_range_place") + F.col("_shift")).alias(into))
    return df


def with_group_size(df: DataFrame, keys: list[str], into: str) -> DataFrame:
    """`into`: rows of each key, counted before they are joined so that no task holds a whole group."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(into)).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), into)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(counts, same).drop(*(f"_k{i}" for i in range(len(keys))))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 by a rational approximation (absolute error below 1.5e-7)."""
    # Coefficients of Abramowitz and Stegun 7.1.26.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1.0 / (1.0 + p * x)
    poly = F.lit(a[4])
    for c in reversed(a[:4]):
        poly = poly * t + c
    return poly * t * F.exp(-x * x)


def moments(c: str) -> list[Column]:
    """Aggregates n, sum and sum of squares of a column."""
    return [F.count(c).alias(f"{c}_n"), F.sum(c).alias(f"{c}_s"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_q")]
