"""Running values in an order within keys, without one task for a whole key.

Rows are dealt in ranges of key and order. Each range gives its totals; what lies before a range in its
key follows from a window over the ranges, which are few; rows then add what lies before their range to what lies
before them inside it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from granary.functions.exprs import LARGE_GROUP
from granary.sources.scratch import stored


def in_ranges(df: DataFrame, keys: list[str], order: list[str], block: int = LARGE_GROUP) -> DataFrame | None:
    """`df` with _part, the number of its range of keys and order, of about `block` rows; None if no key has more rows than that.

    It is written once, so all that reads it sees the same ranges.
    """
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    if not largest[0] or largest[0] <= block:
        return None
    ranges = df.repartitionByRange(math.ceil(largest[1] / block) + 1, *keys, *order)
    return stored(ranges.withColumn("_part", F.spark_partition_id()), "ranges")


def _value(kind: str, c: str | None, w) -> Column:
    if kind == "lag":
        return F.lag(c).over(w)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}[kind](F.lit(1) if c is None else c).over(upto)


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str | None]], block: int = LARGE_GROUP) -> DataFrame:
    """`df` with columns into -> (kind, column): sum, max, min or count up to and with each row, or lag, the value of the row before.

    The order must tell all rows of a key apart.
    """
    ranges = in_ranges(df, keys, order, block)
    if ranges is None:
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
        return df.withColumns({into: _value(kind, c, w) for into, (kind, c) in values.items()})
    total = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    last = F.struct(*order)
    own = ranges.groupBy(*keys, "_part").agg(*(F.max_by(c, last).alias(f"_t{i}") if kind == "lag" else total[kind](F.lit(1) if c is None else c).alias(f"_t{i}") for i, (kind, c) in enumerate(values.values())))
    parts = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part")
    before = parts.rowsBetween(W.unboundedPreceding, -1)
    merge = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}
    carried = stored(own.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_range_of"), *((F.lag(f"_t{i}").over(parts) if kind == "lag" else merge[kind](f"_t{i}").over(before)).alias(f"_c{i}") for i, (kind, _) in enumerate(values.values()))
    ), "range-sums")
    same = F.col("_part") == F.col("_range_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = W.partitionBy(*keys, "_part").orderBy(*order)
    first = F.row_number().over(inside) == 1
    out = ranges.withColumns({f"_v{i}": _value(kind, c, inside) for i, (kind, c) in enumerate(values.values())}).withColumn("_first", first).join(carried, same)
    join = {"sum": lambda a, b: F.when(a.isNull(), b).otherwise(F.coalesce(b, F.lit(0)) + a), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "max": F.greatest, "min": F.least}
    found = {}
    for i, (into, (kind, _)) in enumerate(values.items()):
        a, b = F.col(f"_c{i}"), F.col(f"_v{i}")
        found[into] = F.when(F.col("_first"), a).otherwise(b) if kind == "lag" else join[kind](a, b)
    return out.withColumns(found).select(*df.columns, *values)
