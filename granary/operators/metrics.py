"""Metrics of predictions: tables of id, group, prediction and truth, one result row for each key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from granary.functions.exprs import FLAT, LARGE_GROUP, erfc, pearson, ratio, row_numbers, with_group_size
from granary.functions.scans import running
from granary.operators.rank_sums import rank_correlations
from granary.sources.scratch import stored


def ranked(df: DataFrame, keys: list[str], columns: list[str], tie: str = "id", ties: str = "order", large: int = LARGE_GROUP) -> DataFrame:
    """rk_<column> within keys: ordinal from 0 with ties in id order, or averaged (ties="average")."""
    out = row_numbers(df, keys, {f"rk_{c}": (c, False) for c in columns}, tie, large)
    for c in columns:
        if ties == "average":
            own = out.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(((F.min(f"rk_{c}") + F.max(f"rk_{c}")) / 2.0 - 1).alias("_rank"))
            names = [*keys, c]
            own = own.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)), "_rank")
            same = F.lit(True)
            for i, k in enumerate(names):
                same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
            out = out.drop(f"rk_{c}").join(own, same, "left").withColumnRenamed("_rank", f"rk_{c}").drop(*(f"_k{i}" for i in range(len(names))))
        else:
            out = out.withColumn(f"rk_{c}", (F.col(f"rk_{c}") - 1).cast("double"))
    return out


def spearman(df: DataFrame, keys: list[str], x: str = "pred", y: str = "truth", tie: str = "id", ties: str = "order") -> DataFrame:
    """keys, n, spearman: correlation of ranks within keys; rows that lack a side are left out first."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*dict.fromkeys([*keys, tie, x, y]))  # large groups are written for each rank
    out = ranked(both, keys, [x, y], tie, ties)
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(f"rk_{x}", f"rk_{y}").alias("spearman"))


def screened(df: DataFrame, group: str, columns: list[str], y: str, tie: str = "id", pool: str | None = None, block: int = LARGE_GROUP) -> DataFrame:
    """feature, `group`, n, spearman: of each column with y, within groups and, if it has a name, over the pool of all rows. `df` is read several times."""
    found = rank_correlations(df, group, columns, y, tie, pool, block)
    if found is not None:
        return found
    long = df.unpivot([tie, group, y], columns, "feature", "x").filter(F.col("x").isNotNull() & F.col(y).isNotNull())
    if pool is not None:
        long = long.withColumn(group, F.explode(F.array(F.col(group).cast("string"), F.lit(pool))))
    return spearman(long, ["feature", group], "x", y, tie)


def error_columns(p: str = "pred", y: str = "truth") -> list[Column]:
    e = F.col(p) - F.col(y)
    return [
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y) + 1e-12)).alias("r2_oos"),
    ]


def sign3(x: Column, deadband: float = 0.0) -> Column:
    return F.when(x > deadband, 1).when(x < -deadband, -1).otherwise(0)


def within_group_spearman(df: DataFrame, group: str = "grp") -> DataFrame:
    own = spearman(df, [group]).filter("n >= 2")
    return own.agg(F.coalesce(F.avg("spearman"), F.lit(0.0)).alias("within_spearman"), F.count(F.lit(1)).alias("n_groups"))


#: Rows of a group that one task compares, and buckets of ranks that a larger group is cut into at most.
PAIR_BUCKET, PAIR_GRID = 1 << 16, 2048


def _inversions(order: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """For each part of a sequence (parts lie one after another) its pairs in the wrong order, by splitting ranks bit by bit, the highest first."""
    n = len(order)
    values = np.empty(n, np.int64)
    values[np.lexsort((order, part))] = np.arange(n)
    total, place = np.zeros(parts, np.int64), np.arange(n)
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        one = (values >> bit) & 1
        seen = np.append(0, np.cumsum(one))
        begin = (values >> (bit + 1)) << (bit + 1)  # ranks that agree in all higher bits lie together, in the order of the sequence
        ones = seen[:-1] - seen[begin]
        zero = one == 0
        total += np.bincount(part[values[zero]], ones[zero], parts).astype(np.int64)  # a part's ranks are its places
        split = np.empty(n, np.int64)
        split[np.where(zero, place - ones, begin + (1 << bit) + ones)] = values
        values = split
    return total


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _tied(part: np.ndarray, parts: int, *columns: np.ndarray) -> np.ndarray:
    """For each part its pairs of rows that agree in all columns, by which the rows are sorted."""
    first = np.flatnonzero(_starts(part, *columns))
    n = np.diff(np.append(first, len(part)))
    return np.bincount(part[first], n * (n - 1) // 2, parts).astype(np.int64)


def _whole_runs(frames, columns: list[str]):
    """Frames of whole runs of equal columns, from frames in the order of these, and where runs begin."""
    held = None
    for f in frames:
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        if len(f):
            new = _starts(*(pd.factorize(f[c], use_na_sentinel=False)[0] for c in columns))
            cut = int(np.flatnonzero(new)[-1])  # the last run may go on
            if cut:
                yield f.iloc[:cut], new[:cut]
            held = f.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held, np.append(True, np.zeros(len(held) - 1, bool))


_COUNTED = ("right", "wrong", "discordant", "pairs", "all_pairs")


def _columns(all_pairs, tied_y, tied_p, tied_both, discordant) -> dict:
    right = all_pairs - tied_y - tied_p + tied_both - discordant
    return dict(zip(_COUNTED, (right, all_pairs - tied_y - right, discordant, all_pairs - tied_y, all_pairs)))


def _ddl(df: DataFrame, keys: list[str]) -> list[str]:
    return [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]


def _small_concordance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of groups that fit a task: dealt by group once, sorted by (_p, _y), where discordant pairs are the inversions of _y."""

    def work(frames):
        for f, new in _whole_runs(frames, keys):
            part, p, y = np.cumsum(new) - 1, f["_p"].to_numpy(), f["_y"].to_numpy()
            parts, n = int(part[-1]) + 1, np.bincount(part)
            by_y = np.lexsort((y, part))
            counts = _columns(n * (n - 1) // 2, _tied(part[by_y], parts, y[by_y]), _tied(part, parts, p), _tied(part, parts, p, y), _inversions(y, part, parts))
            yield f[keys][new].assign(**counts)

    dealt = rows.select(*keys, "_p", "_y").repartition(*keys).sortWithinPartitions(*keys, "_p", "_y")
    return dealt.mapInPandas(work, ", ".join([*_ddl(rows, keys), *(f"{c} long" for c in _COUNTED)]))


def _large_concordance(rows: DataFrame, keys: list[str], bucket: int, block: int) -> DataFrame:
    """Of larger groups: pairs in opposite orders by (_p, _y) and by (_y, _p), from ranks cut into buckets.

    Pairs of one bucket of the first order are counted there, pairs of one bucket of the second in that, and all
    others from the counts of cells, of which a group has PAIR_GRID ** 2 at most: buckets grow with larger groups.
    """
    ranked_ = running(running(rows, keys, ["_p", "_y", "_id"], {"_a": ("count", None)}, block), keys, ["_y", "_p", "_id"], {"_b": ("count", None)}, block)
    wide = F.greatest(F.lit(bucket), F.ceil(F.col("_rows") / PAIR_GRID))
    cells = ranked_.select(*keys, "_a", "_b", F.floor((F.col("_a") - 1) / wide).alias("_ba"), F.floor((F.col("_b") - 1) / wide).alias("_bb"))
    cells = stored(cells, "pair-ranks")
    schema = ", ".join([*_ddl(rows, keys), "_inv long"])

    def counted(own: str, other: str | None):
        def work(frames):
            for f, new in _whole_runs(frames, [*keys, own]):
                part, q = np.cumsum(new) - 1, f["_b"].to_numpy()
                total = _inversions(q, part, int(part[-1]) + 1)
                if other:  # without the pairs that were counted in the other order's buckets
                    o = np.lexsort((f[other].to_numpy(), part))
                    begins = _starts(part[o], f[other].to_numpy()[o])
                    fine = np.cumsum(begins) - 1
                    total -= np.bincount(part[o][begins], _inversions(q[o], fine, int(fine[-1]) + 1), len(total)).astype(np.int64)
                yield f[keys][new].assign(_inv=total)

        return cells.repartition(*keys, own).sortWithinPartitions(*keys, own, "_a").mapInPandas(work, schema)

    def far(frames):
        for f in frames:
            out = []
            for row in f["_cells"]:
                a, b, n = (np.array([c[i] for c in row], np.int64) for i in ("_ba", "_bb", "_n"))
                grid = np.zeros((a.max() + 1, b.max() + 1), np.int64)
                grid[a, b] = n
                earlier = np.cumsum(grid, axis=0) - grid  # buckets before in the first order
                later = earlier[:, ::-1].cumsum(axis=1)[:, ::-1] - earlier  # and behind in the second
                out.append(int((grid * later).sum()))
            yield f[keys].assign(_inv=out)

    counts = cells.groupBy(*keys, "_ba", "_bb").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.collect_list(F.struct("_ba", "_bb", "_n")).alias("_cells"))
    both = counted("_ba", None).unionByName(counted("_bb", "_ba")).unionByName(counts.mapInPandas(far, schema))
    names = {"_all": [], "_ty": ["_y"], "_tp": ["_p"], "_tpy": ["_p", "_y"]}
    out = both.groupBy(*keys).agg(F.sum("_inv").alias("_inv"))
    for name, columns in names.items():
        own = rows.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("_n")).groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.sum(F.col("_n") * (F.col("_n") - 1) / 2).cast("long").alias(name))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = out.join(own, same).drop(*(f"_k{i}" for i in range(len(keys))))
    counts = _columns(F.col("_all"), F.col("_ty"), F.col("_tp"), F.col("_tpy"), F.col("_inv"))
    return out.select(*keys, *(c.cast("long").alias(name) for name, c in counts.items()))


def concordance(df: DataFrame, group: list[str], p: str = "pred", y: str = "truth", tie: str = "id", bucket: int = PAIR_BUCKET, block: int = LARGE_GROUP) -> DataFrame:
    """Pairs within groups: right, wrong (or tied in prediction), discordant, untied in truth, and all; no pair is formed.

    Rows that lack a side are left out. Groups of up to `bucket` rows are counted in one sorted pass, larger ones from ranks.
    """
    keys = [f"_g{i}" for i in range(max(1, len(group)))]
    rows = df.select(*(F.col(g).alias(k) for g, k in zip(group or [], keys)), *([] if group else [F.lit(0).alias("_g0")]), F.col(tie).alias("_id"), F.col(p).cast("double").alias("_p"), F.col(y).cast("double").alias("_y"))
    rows = stored(rows.filter(F.col("_p").isNotNull() & F.col("_y").isNotNull()), "pairs")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = sizes.filter(F.col("_rows") > bucket)
    if large.isEmpty():
        out = _small_concordance(rows, keys)
    else:
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        sized = rows.join(sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_rows"), same).drop(*(f"_k{i}" for i in range(len(keys))))
        out = _small_concordance(sized.filter(F.col("_rows") <= bucket), keys).unionByName(_large_concordance(sized.filter(F.col("_rows") > bucket), keys, bucket, block))
    return out.select(*(F.col(k).alias(g) for g, k in zip(group, keys)), *_COUNTED)


def top_picks(df: DataFrame, group: list[str], share: float | Column, p: str = "pred", y: str = "truth", tie: str = "id", large: int = LARGE_GROUP) -> DataFrame:
    """Each group's best max(1, round-half-even(n * share)) rows by prediction, later rows first on ties."""
    count = F.col("_rows")
    k = F.greatest(F.lit(1), F.bround(count * (F.lit(share) if isinstance(share, float) else share)).cast("int"))
    placed = row_numbers(df, group, {"_rn": (p, True)}, tie, large)
    return with_group_size(placed, group, "_rows").filter(F.col("_rn") <= k).drop("_rn", "_rows")


def selection_lift(df: DataFrame, group: str = "grp", share: float = 0.25) -> DataFrame:
    """Mean truth of the model's pooled picks, of random picks and of an oracle's (means of group means)."""
    model = top_picks(df, [group], share).agg(F.avg("truth").alias("model"))
    best = top_picks(df, [group], share, p="truth").groupBy(group).agg(F.avg("truth").alias("o"))
    chance = df.groupBy(group).agg(F.avg("truth").alias("r"))
    both = best.join(chance, group).agg(F.avg("o").alias("oracle"), F.avg("r").alias("random"))
    gap = F.col("oracle") - F.col("random")
    return model.crossJoin(both).select(  # one row each
        "model", "random", "oracle", (F.col("model") - F.col("random")).alias("lift"), F.when(gap != 0, (F.col("model") - F.col("random")) / gap).otherwise(F.lit(float("nan"))).alias("frac_of_oracle")
    )


def top1_regret(df: DataFrame, group: str = "grp") -> DataFrame:
    """Mean over groups of the best truth less the truth of the best prediction (the first of ties)."""
    own = df.groupBy(group).agg((F.max("truth") - F.min(F.struct((-F.col("pred")).alias("p"), "id", "truth"))["truth"]).alias("regret"))
    return own.agg(F.avg("regret").alias("top1_regret"), F.count(F.lit(1)).alias("n_groups"))


def direction_columns(eps: float = 0.0, p: str = "pred", y: str = "truth") -> list[Column]:
    up, said = F.col(y) > eps, F.col(p) > eps
    rate = lambda a, b: ratio(F.count_if(a), F.count_if(b))
    return [
        F.count(F.lit(1)).alias("n"), F.avg((up == said).cast("double")).alias("accuracy"), rate(up & said, up).alias("sensitivity"), rate(~up & ~said, ~up).alias("specificity"),
        F.avg(up.cast("double")).alias("base_rate"), F.greatest(F.avg(up.cast("double")), 1 - F.avg(up.cast("double"))).alias("majority"),
    ]


def spearman_p(rho: Column, n: Column) -> Column:
    """Two-sided p by the normal tail of t; NaN for n < 4 or a perfect correlation."""
    perfect = F.abs(rho) >= 1 - FLAT
    t = F.abs(rho) * F.sqrt(F.try_divide((n - 2).cast("double"), F.when(~perfect, 1 - rho * rho)))
    return F.when((n < 4) | perfect, F.lit(float("nan"))).otherwise(erfc(t / F.sqrt(F.lit(2.0))))
