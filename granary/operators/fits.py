"""Ridge fits from additive statistics: one pass gives every fold, prefix or subset its own fit.

The statistics of a set of rows are one flat array that adds and subtracts: counts and sums of y and
of each feature where it is finite, cross sums of pairs, and sums and counts where one or both are
missing. With them the mean-imputed, standardised normal equations follow for any imputation mean, so
leave-one-group-out is total minus fold. Features are centred on their means over all rows first, so
that no variance is lost in the subtraction. Tasks add up whole batches; what is shuffled is one array
for each task and set, summed in two steps. Only p x p systems are solved in Python, a batch at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from granary.functions.exprs import FLAT, LARGE_GROUP, clean, row_numbers, shuffle_key, with_group_size
from granary.functions.scans import in_ranges
from granary.sources.scratch import stored

#: Numbers that a task holds for sums or fits at once.
HELD = 1 << 21


def centred(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[float]]:
    """`df` with _x, its features less their means over all rows (null where missing), and those means."""
    means = list(df.agg(*(F.coalesce(F.avg(clean(f)), F.lit(0.0)).alias(f"_{i}") for i, f in enumerate(features))).first())
    return df.withColumn("_x", F.array(*(clean(f) - F.lit(m) for f, m in zip(features, means)))), means


def _matrix(column, p: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), p)


def _parts(x: np.ndarray):
    have = (~np.isnan(x)).astype(float)
    return have, np.where(have > 0, x, 0.0), 1 - have


def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The statistics of rows, in the order that `solve` expects; missing features (NaN) add nothing."""
    have, z, none = _parts(x)
    return np.concatenate([[len(y), y.sum(), (y * y).sum()], have.sum(0), z.sum(0), z.T @ y, have.T @ y, (z.T @ z).ravel(), (z.T @ none).ravel(), (none.T @ none).ravel()])


def terms(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The statistics of each row alone."""
    have, z, none = _parts(x)
    pairs = [np.einsum("ki,kj->kij", a, b).reshape(len(y), -1) for a, b in ((z, z), (z, none), (none, none))]
    return np.concatenate([np.stack([np.ones(len(y)), y, y * y], axis=1), have, z, z * y[:, None], have * y[:, None], *pairs], axis=1)


def width(p: int) -> int:
    return 3 + 4 * p + 3 * p * p


def _ddl(df: DataFrame, keys: list[str]) -> list[str]:
    return [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]


def _segments(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal codes begin."""
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def _codes(f: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Equal numbers for rows of equal keys, nulls included."""
    code = np.zeros(len(f), np.int64)
    for k in keys:
        own, values = pd.factorize(f[k], use_na_sentinel=False)
        code = pd.factorize(code * (len(values) + 1) + own)[0]
    return code


def statistics(df: DataFrame, keys: list[str], p: int, y: str) -> DataFrame:
    """keys and g, the sums over rows of `df` with an array _x of p features.

    Tasks add up keys of many rows. Rows of keys with so few in a batch that an array of sums would be larger go on as they are, so that
    what is shuffled never exceeds the rows by much, however many keys there are.
    """
    schema = ", ".join([*_ddl(df, keys), "_x array<double>", "_y double", "g array<double>"])
    few = width(p) // (p + 1)

    def frame(held):
        return pd.DataFrame({**{k: [h[i] for h in held] for i, k in enumerate(keys)}, "_x": None, "_y": np.nan, "g": [g.tolist() for g in held.values()]})

    def partial(frames):
        held: dict = {}
        for f in frames:
            if not len(f):
                continue
            code = _codes(f, keys)
            n = np.bincount(code)
            rare = (n < few)[code] if keys else np.zeros(len(f), bool)
            if rare.any():
                yield f[rare].assign(g=None)
            f, code = f[~rare], code[~rare]
            if len(f):
                order = np.argsort(code, kind="stable")
                f = f.iloc[order]
                x, v, at = _matrix(f["_x"], p), f["_y"].to_numpy(float), _segments(code[order])
                for a, z in zip(at, np.append(at[1:], len(f))):
                    k = tuple(f[c].iloc[a] for c in keys)
                    held[k] = held.get(k, 0) + sums(x[a:z], v[a:z])
            if len(held) * width(p) > HELD:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    rows = df.select(*keys, "_x", F.col(y).cast("double").alias("_y")).mapInPandas(partial, schema)
    return _added(rows, keys, p)


def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the sum of all arrays g, first within the partitions as they are."""
    return _added(rows, keys, None)


def _added(rows: DataFrame, keys: list[str], p: int | None) -> DataFrame:
    """`summed`, for rows that have an array g or, if p is given, their own _x and _y: sorted by key, then added run by run over whole batches."""
    schema = ", ".join([*_ddl(rows, keys), "g array<double>"])

    def arrays(f):
        if p is None:
            return np.array(f["g"].tolist(), dtype=float).reshape(len(f), -1)
        own = f["g"].isna().to_numpy()
        out = np.empty((len(f), width(p)))
        if own.any():
            out[own] = terms(_matrix(f["_x"][own], p), f["_y"][own].to_numpy(float))
        if not own.all():
            out[~own] = np.array(f["g"][~own].tolist(), dtype=float)
        return out

    def work(frames):
        last = total = None  # the key that the batch before ended with
        for whole in frames:
            step = max(1, HELD // (width(p) if p else max(1, len(whole["g"].iloc[0])))) if len(whole) else 1
            for begin in range(0, len(whole), step):
                f = whole.iloc[begin : begin + step]
                at = _segments(_codes(f, keys))
                g, heads = np.add.reduceat(arrays(f), at, axis=0), f[keys].iloc[at]
                if last is not None:
                    if all((a == b) or (pd.isna(a) and pd.isna(b)) for a, b in zip(last.iloc[0], heads.iloc[0])):
                        g[0] += total
                    else:
                        yield last.assign(g=[total.tolist()])
                last, total = heads.iloc[-1:], g[-1].copy()
                if len(at) > 1:
                    yield heads.iloc[:-1].assign(g=g[:-1].tolist())
        if last is not None:
            yield last.assign(g=[total.tolist()])

    if p is None:
        rows = (rows.sortWithinPartitions(*keys) if keys else rows).mapInPandas(work, schema)
    return (rows.repartition(*keys).sortWithinPartitions(*keys) if keys else rows.repartition(1)).mapInPandas(work, schema)


def minus(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def solve(g: np.ndarray, p: int, lam: float, flat: float = FLAT * FLAT) -> dict[str, np.ndarray]:
    """Fits for rows of statistics: base, impute, mu, sd, w and rss, the squared error on the rows. Without rows everything is 0.

    A feature whose variance on the rows is `flat` or less is constant: sd 1 and weight 0.
    """
    n = np.maximum(g[:, 0], 1e-300)
    sy = g[:, 1]
    c, s, u, v = (g[:, 3 + k * p : 3 + (k + 1) * p] for k in range(4))
    cross, part, none = (g[:, 3 + 4 * p + k * p * p : 3 + 4 * p + (k + 1) * p * p].reshape(-1, p, p) for k in range(3))
    m = np.where(c > 0, s / np.maximum(c, 1), 0.0)
    full = cross + m[:, None, :] * part + m[:, :, None] * part.transpose(0, 2, 1) + m[:, :, None] * m[:, None, :] * none
    mu = (s + (n[:, None] - c) * m) / n[:, None]
    cov = full - n[:, None, None] * mu[:, :, None] * mu[:, None, :]
    xy = u + m * (sy[:, None] - v) - mu * sy[:, None]
    var = np.maximum(np.einsum("kii->ki", cov), 0) / n[:, None]
    varies = var > flat
    sd = np.where(varies, np.sqrt(var), 1.0)
    a, b = np.where(varies[:, :, None] & varies[:, None, :], cov / (sd[:, :, None] * sd[:, None, :]), 0.0), np.where(varies, xy / sd, 0.0)
    w = np.linalg.solve(a + lam * np.eye(p), b[:, :, None])[:, :, 0] if len(g) else np.zeros((0, p))
    rss = g[:, 2] - sy * sy / n - 2 * (w * b).sum(axis=1) + np.einsum("ki,kij,kj->k", w, a, w)
    return {"base": sy / n, "impute": m, "mu": mu, "sd": sd, "w": w, "rss": np.maximum(rss, 0.0)}


def applied(fit: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Predictions of rows, each by its own fit."""
    z = (np.where(np.isnan(x), fit["impute"], x) - fit["mu"]) / fit["sd"]
    return fit["base"] + (fit["w"] * z).sum(axis=1)


_FIT = "n double, base double, impute array<double>, mu array<double>, sd array<double>, w array<double>"


def _frame(g: np.ndarray, fit: dict[str, np.ndarray]) -> dict:
    return {"n": g[:, 0], "base": fit["base"], **{c: list(fit[c]) for c in ("impute", "mu", "sd", "w")}}


def fits(stats: DataFrame, keys: list[str], p: int, lam: float = 1.0) -> DataFrame:
    """keys, n, base and the arrays impute, mu, sd, w of each row of statistics."""

    def work(frames):
        for f in frames:
            for at in range(0, len(f), max(1, HELD // width(p))):
                some = f.iloc[at : at + max(1, HELD // width(p))]
                g = np.array(some["g"].tolist(), dtype=float).reshape(len(some), -1)
                yield pd.DataFrame({**{k: some[k].to_numpy() for k in keys}, **_frame(g, solve(g, p, lam))})

    return stats.mapInPandas(work, ", ".join([*_ddl(stats, keys), _FIT]))


def _predicted(x: list[Column]) -> Column:
    total = F.col("base")
    for i, c in enumerate(x):
        total = total + F.col("w")[i] * (F.coalesce(c, F.col("impute")[i]) - F.col("mu")[i]) / F.col("sd")[i]
    return total


def predict(features: list[str]) -> Column:
    """The prediction of a row that a fit was joined to."""
    return _predicted([clean(f) for f in features])


def ridge(df: DataFrame, features: list[str], y: str, keys: list[str] = [], lam: float = 1.0) -> DataFrame:
    data, means = centred(df, features)
    shift = F.array(*map(F.lit, means))
    back = {c: F.zip_with(c, shift, lambda a, b: a + b) for c in ("impute", "mu")}
    return fits(statistics(data, keys, len(features), y), keys, len(features), lam).withColumns(back)


def oof_predict(df: DataFrame, fold: str, features: list[str], y: str, lam: float = 1.0, within: str | None = None) -> DataFrame:
    """`df` with pred, each row predicted by the fit of all other folds (of its own `within`, if given); a single fold predicts nothing."""
    data, _ = centred(df, features)
    keys = [within] if within else []
    own = stored(statistics(data, [*keys, fold], len(features), y), "fold-sums")
    total = summed(own, keys).withColumnRenamed("g", "all")
    both = own.join(total, keys) if within else own.crossJoin(F.broadcast(total))  # one row of totals
    rest = both.select(fold, minus("all", "g").alias("g")).filter(F.col("g")[0] > 0.5)
    fit = stored(fits(rest, [fold], len(features), lam), "fold-fits")  # of known size: few are broadcast and the rows stay where they are
    return data.join(fit, fold).withColumn("pred", _predicted([F.col("_x")[i] for i in range(len(features))])).select(*df.columns, "pred")


def loocv(df: DataFrame, key: str, features: list[str], y: str, lam: float = 1.0) -> DataFrame:
    """`df` with pred, each row predicted by the fit of all others. The totals are one array; nothing else is shuffled."""
    p = len(features)
    data, _ = centred(df, features)
    found = statistics(data, [], p, y).first()  # one row
    if found is None:
        return df.withColumn("pred", F.lit(None).cast("double"))
    total = np.array(found["g"])

    def work(frames):
        for f in frames:
            for at in range(0, len(f), max(1, HELD // width(p))):
                some = f.iloc[at : at + max(1, HELD // width(p))]
                x, v = _matrix(some["_x"], p), some["_y"].to_numpy(float)
                g = total[None, :] - terms(x, v)
                yield pd.DataFrame({key: some[key].to_numpy(), "pred": np.where(g[:, 0] > 0.5, applied(solve(g, p, lam), x), np.nan)})

    out = data.select(key, "_x", F.col(y).cast("double").alias("_y")).mapInPandas(work, ", ".join([*_ddl(df, [key]), "pred double"]))
    return df.join(out.withColumn("pred", clean("pred")), key).filter("pred is not null")


def hash_fold(key: str, k: int, seed=0) -> Column:
    """Whole keys in one of k folds."""
    return (F.conv(F.substring(shuffle_key(seed, key), 1, 8), 16, 10).cast("long") % k).cast("int")


def transfer(train: DataFrame, test: DataFrame, features: list[str], y: str, lam: float = 1.0) -> DataFrame:
    fit = ridge(train, features, y, [], lam)
    return test.crossJoin(F.broadcast(fit)).withColumn("pred", predict(features)).select(*test.columns, "pred")  # one fit


def few_shot(df: DataFrame, domain: str, key: str, ks: list[int], reps: int, features: list[str], y: str, seed=0, least: int = 8, lam: float = 1.0, keep: list[str] | None = None, few: int = 1000) -> DataFrame:
    """Fits on all other domains and k rows of the held-out one, first in the order of their hash; predictions of its other rows.

    Rows of `keep` (all columns of `df`), k, rep and pred. The rows chosen are max(ks) for each domain and repetition, found by a top-k
    of hashes of ids alone. The fits and the rows that they used are few for each domain: with up to `few` domains all tasks get
    them and a row's predictions are one product of matrices, without a shuffle; with more, rows are joined with them by domain.
    """
    spark, p, keep = df.sparkSession, len(features), keep or df.columns
    sizes = stored(df.groupBy(domain).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= least).select(domain), "domains")
    n_domains = sizes.count()
    sizes = F.broadcast(sizes) if n_domains <= few else sizes
    others, means = centred(df, features)
    dealt = df.select(domain, key).join(sizes, domain).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_h", shuffle_key(seed, "rep", key))
    turn = F.row_number().over(W.partitionBy(domain, "rep").orderBy("_h", key))
    first = stored(dealt.withColumn("rn", turn).filter(F.col("rn") <= max(ks)).select(domain, "rep", "rn", key), "few-shot-ids")
    rows_of = first.select(domain, key).distinct()
    chosen = stored(others.join(F.broadcast(rows_of) if n_domains <= few else rows_of, [domain, key]).select(domain, key, "_x", y), "few-shot")
    own = stored(statistics(others, [domain], p, y), "fold-sums")
    total = summed(own, []).select(F.col("g").alias("all"))
    config = F.broadcast(spark.createDataFrame([(k, r) for k in ks for r in range(reps)], "k int, rep int"))
    base = own.join(sizes, domain).crossJoin(F.broadcast(total)).crossJoin(config).select(domain, "k", "rep", minus("all", "g").alias("g"))
    used = first.join(config, "rep").filter("rn <= k").select(domain, "rep", "k", key)
    shots = statistics(chosen.join(used, [domain, key]), [domain, "k", "rep"], p, y)
    fit = fits(summed(base.unionByName(shots), [domain, "k", "rep"]), [domain, "k", "rep"], p, lam)
    if n_domains > few:
        all_x = others.join(fit, domain).withColumn("pred", _predicted([F.col("_x")[i] for i in range(p)])).select(*df.columns, "k", "rep", "pred")
        return all_x.join(used, [domain, "rep", "k", key], "left_anti").select(*keep, "k", "rep", "pred")
    held = fit.toPandas()  # len(ks) * reps fits for each of a few domains
    by_domain = {d: f.sort_values(["k", "rep"]) for d, f in held.groupby(domain)}
    settings = sorted((k, r) for k in ks for r in range(reps))
    spent: dict = {}
    for d, rep, k, own_key in used.select(domain, "rep", "k", key).toPandas().itertuples(index=False):
        spent.setdefault(d, {}).setdefault(own_key, []).append(settings.index((k, rep)))

    def work(frames):
        at = {d: tuple(np.stack(f[c].to_list()) for c in ("impute", "mu", "sd", "w")) + (f["base"].to_numpy(),) for d, f in by_domain.items()}
        ids = {d: pd.Index(list(own)) for d, own in spent.items()}
        for f in frames:
            f = f[f[domain].isin(list(at))].reset_index(drop=True)
            if not len(f):
                continue
            x, out, skip = _matrix(f["_x"], p), np.empty((len(f), len(settings))), [[] for _ in range(len(f))]
            for d, rows in f.groupby(domain).indices.items():
                impute, mu, sd, w, start = at[d]
                slope, none = w / sd, np.isnan(x[rows])
                out[rows] = start - (slope * mu).sum(axis=1) + np.where(none, 0.0, x[rows]) @ slope.T + none @ (slope * impute).T
                if d in ids:
                    found = ids[d].get_indexer(f[key].iloc[rows])
                    for i in np.flatnonzero(found >= 0):
                        skip[rows[i]] = spent[d][ids[d][found[i]]]
            yield f[keep].assign(_preds=out.tolist(), _skip=skip)

    schema = ", ".join([*_ddl(df, keep), "_preds array<double>", "_skip array<int>"])
    out = others.select(*dict.fromkeys([*keep, domain, key]), "_x").mapInPandas(work, schema)
    names = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(r).alias("rep")) for k, r in settings))
    out = out.select(*keep, "_skip", F.posexplode("_preds").alias("_i", "pred")).filter(~F.array_contains("_skip", F.col("_i")))
    return out.withColumn("_s", F.element_at(names, F.col("_i") + 1)).select(*keep, "_s.k", "_s.rep", "pred")


def _running(df: DataFrame, keys: list[str], order: list[str], p: int, extra: str, finish, block: int = LARGE_GROUP) -> DataFrame:
    """finish(frame, inclusive, exclusive): columns of `extra` for rows of `df` (_x, _y) in their order within keys.

    Rows are dealt by key and sorted; a task streams them some at a time, carrying the sums of the key it is in.
    Keys of more than `block` rows are dealt in ranges of the order: the sums of the ranges before (an
    array for each range, added up in a window of arrays) come first in each range, as a row of their own.
    """
    ranges = in_ranges(df, keys, order, block)
    ident = [*keys, *(c for c in order if c not in keys)]
    deal = [*keys, "_part"]
    if ranges is None:
        rows = df.withColumns({"_part": F.lit(0), "_g": F.lit(None).cast("array<double>")})
    else:

        def before(k, f):
            f = f.sort_values("_part")
            own = np.array(f["g"].tolist())
            upto = np.cumsum(own, axis=0) - own
            return pd.DataFrame({**{c: [v] * len(f) for c, v in zip(keys, k)}, "_part": f["_part"].to_numpy(), "_g": upto.tolist()})

        own = statistics(ranges, deal, p, "_y")
        carried = own.groupBy(*keys).applyInPandas(before, ", ".join([*_ddl(df, keys), "_part int, _g array<double>"]))
        rows = ranges.withColumn("_g", F.lit(None).cast("array<double>")).unionByName(carried, allowMissingColumns=True)

    def work(frames):
        last, carry, turn = None, np.zeros(width(p)), 0
        for whole in frames:
            for at in range(0, len(whole), max(1, HELD // width(p))):
                f = whole.iloc[at : at + max(1, HELD // width(p))]
                ids = list(zip(*(f[k].tolist() for k in deal)))
                heads = [i for i, g in enumerate(f["_g"]) if g is not None]
                starts = sorted({0, *heads, *(h + 1 for h in heads), *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)})
                x = np.array([[np.nan] * p if r is None else r for r in f["_x"]], dtype=float).reshape(len(f), p)
                own = terms(x, f["_y"].to_numpy(float))
                upto, before, t, kept = np.empty_like(own), np.empty_like(own), np.empty(len(ids), np.int64), np.ones(len(ids), bool)
                for a, z in zip(starts, starts[1:]):
                    g = f["_g"].iloc[a]
                    if g is not None:  # what lies before this range
                        last, carry, turn, kept[a] = ids[a], np.array(g), round(float(g[0])), False
                        upto[a], before[a], t[a] = carry, carry, turn
                        continue
                    first, n = (carry, turn) if ids[a] == last else (np.zeros(width(p)), 0)
                    upto[a:z] = first + np.cumsum(own[a:z], axis=0)
                    before[a], before[a + 1 : z], t[a:z] = first, upto[a : z - 1], np.arange(n + 1, n + 1 + z - a)
                    last, carry, turn = ids[a], upto[z - 1].copy(), int(t[z - 1])
                if kept.any():
                    f, upto, before, t = f[kept], upto[kept], before[kept], t[kept]
                    yield pd.DataFrame({**{c: f[c].to_numpy() for c in ident}, **finish(f.assign(_t=t), upto, before)})

    rows = rows.repartition(*deal).sortWithinPartitions(*deal, F.asc(F.col("_g").isNull()), *order)
    return rows.mapInPandas(work, ", ".join([*_ddl(df, ident), extra]))


def snapshots(df: DataFrame, keys: list[str], order: list[str], features: list[str], y: str, lam: float = 1.0, block: int = LARGE_GROUP, flat: float = FLAT * FLAT) -> DataFrame:
    """The fit on the first t rows of each key, for every t, with train_rmse, its error on those rows."""
    p = len(features)
    data, means = centred(df, features)
    shift = np.array(means, float)

    def finish(f, g, _):
        fit = solve(g, p, lam, flat)
        fit["impute"], fit["mu"] = fit["impute"] + shift, fit["mu"] + shift
        return {"t": f["_t"].to_numpy(np.int32), **_frame(g, fit), "train_rmse": np.sqrt(fit["rss"] / g[:, 0])}

    rows = data.select(*keys, *order, "_x", F.col(y).cast("double").alias("_y"))
    return _running(rows, keys, order, p, f"t int, {_FIT}, train_rmse double", finish, block).drop(*order)


def prequential(df: DataFrame, keys: list[str], order: list[str], features: list[str], y: str, warm: int = 4, fallback: str | None = None, lam: float = 1.0, block: int = LARGE_GROUP, flat: float = FLAT * FLAT) -> DataFrame:
    """Each row predicted by the fit of the rows before it; the first `warm` score as the fallback feature. Missing features are 0."""
    p, ident = len(features), [*keys, *order]
    data, _ = centred(df.withColumns({f: F.coalesce(clean(f), F.lit(0.0)) for f in features}), features)

    def finish(f, _, g):
        return {"pred": np.where(g[:, 0] < warm, f["_early"].to_numpy(float), applied(solve(g, p, lam, flat), _matrix(f["_x"], p)))}

    early = F.coalesce(clean(fallback), F.lit(0.0)) if fallback else F.lit(0.0)
    rows = data.select(*ident, "_x", F.col(y).cast("double").alias("_y"), early.alias("_early"))
    return df.join(_running(rows, keys, order, p, "pred double", finish, block), ident).select(*df.columns, "pred")


def conformal(df: DataFrame, keys: list[str], alpha: float, pred: str = "pred", y: str = "truth", tie: str = "id") -> DataFrame:
    """Half-width q, the k-th smallest |residual| with k = min(n, ceil((n + 1)(1 - alpha))), coverage and the share of |pred| below q."""
    r = row_numbers(df.withColumn("_r", F.abs(F.col(y) - F.col(pred))), keys, {"_rn": ("_r", False)}, tie)
    r = with_group_size(r, keys, "_n")
    k = F.least(F.col("_n"), F.ceil((F.col("_n") + 1) * F.lit(1 - alpha)))
    q = r.filter(F.col("_rn") == k).select(*keys, F.col("_r").alias("q"))
    return r.join(q, keys).groupBy(*keys).agg(F.max("q").alias("q"), F.avg((F.col("_r") <= F.col("q")).cast("double")).alias("coverage"), F.avg((F.abs(pred) < F.col("q")).cast("double")).alias("indeterminate"))


def predict_interval(df: DataFrame, half_width, pred: str = "pred") -> DataFrame:
    """`df` with low, high, and below_resolution where the interval holds 0: the sign of the lift can't be told."""
    q = F.lit(half_width) if isinstance(half_width, float) else F.col(half_width)
    low, high = F.col(pred) - q, F.col(pred) + q
    return df.withColumns({"low": low, "high": high, "below_resolution": (low < 0) & (high > 0)})


def mean_baseline(df: DataFrame, fold: str, y: str) -> DataFrame:
    """`df` with pred, the mean of all other folds."""
    own = df.groupBy(fold).agg(F.count(y).alias("_n"), F.sum(y).alias("_s"))
    total = own.agg(F.sum("_n").alias("_tn"), F.sum("_s").alias("_ts"))  # one row
    rest = own.crossJoin(F.broadcast(total)).filter("_tn > _n").select(fold, ((F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("_n"))).alias("pred"))
    return df.join(rest, fold).select(*df.columns, "pred")


def explain(fit: DataFrame, features: list[str], top: int | None = None) -> DataFrame:
    """feature, weight and rank by magnitude of a one-row fit."""
    rows = fit.select(F.posexplode("w").alias("i", "weight")).withColumn("feature", F.element_at(F.array(*map(F.lit, features)), F.col("i") + 1))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("weight")), "i"))).drop("i")  # one row for each feature
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def contributions(df: DataFrame, key: str, weights: dict[str, tuple[float, float, float]], base: float, top: int) -> DataFrame:
    """Waterfall: z * weight of each feature, the largest `top` and the rest as one, with running start and end."""
    parts = F.array(*(F.struct(F.lit(f).alias("feature"), (F.coalesce((clean(f) - m) / s, F.lit(0.0)) * w).alias("part")) for f, (w, m, s) in weights.items()))
    rows = df.select(key, F.explode(parts).alias("p")).select(key, "p.feature", "p.part")
    r = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.abs("part")), "feature"))
    rows = rows.withColumn("place", F.least(r, F.lit(top + 1)))
    rows = rows.groupBy(key, "place").agg(F.when(F.col("place") > top, F.lit("other features")).otherwise(F.min("feature")).alias("feature"), F.sum("part").alias("part"))
    end = F.lit(base) + F.sum("part").over(W.partitionBy(key).orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("part"))


def principal_axes(df: DataFrame, vector: str, k: int = 3) -> DataFrame:
    """Leading axes of vectors: component, explained share, loadings with the largest magnitude positive, and the mean.

    Tasks add up means and cross products of whole batches; p is the number of weights.
    """
    def partial(frames):
        held = None
        for f in frames:
            x = np.array(f["v"].tolist(), dtype=float)
            g = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
            held = g if held is None else held + g
        if held is not None:
            yield pd.DataFrame({"g": [held.tolist()]})

    middle = df.select(F.posexplode(vector).alias("i", "w")).groupBy("i").agg(F.avg("w").alias("m")).orderBy("i").collect()  # one row for each weight
    means = np.array([r.m for r in middle], dtype=float)
    p = len(means)
    near = F.zip_with(F.col(vector), F.array(*map(F.lit, means.tolist())), lambda a, b: a.cast("double") - b)
    rows = df.select(near.alias("v")).mapInPandas(partial, "g array<double>")
    g = np.array(summed(rows, []).first()["g"])
    n, s, q = g[0], g[1 : p + 1], g[p + 1 :].reshape(p, p)
    cov = (q - np.outer(s, s) / n) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    out = []
    for c in range(min(k, p)):
        v = vectors[:, p - 1 - c]
        v = v * np.sign(v[np.abs(v).argmax()] or 1)
        out.append((c + 1, float(values[p - 1 - c] / max(values.sum(), 1e-300)), [float(e) for e in v], (means + s / n).tolist()))
    return df.sparkSession.createDataFrame(out, "component int, explained double, loadings array<double>, mean array<double>")


def top_loadings(axes: DataFrame, names: list[str], top: int = 5) -> DataFrame:
    """component, rank, feature and loading of the largest loadings of each axis."""
    rows = axes.select("component", F.posexplode("loadings").alias("i", "loading")).withColumn("feature", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1))
    rank = F.row_number().over(W.partitionBy("component").orderBy(F.desc(F.abs("loading")), "i"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).select("component", "rank", "feature", "loading")


def projections(df: DataFrame, vector: str, axes: DataFrame) -> DataFrame:
    """`df` with point, its vector's coordinates on the axes (a bounded table: a few rows of p numbers)."""
    rows = axes.orderBy("component").collect()
    mean = F.array(*map(F.lit, rows[0]["mean"]))
    dot = lambda v: F.aggregate(F.zip_with(F.zip_with(F.col(vector), mean, lambda a, b: a - b), F.array(*map(F.lit, v)), lambda a, b: a * b), F.lit(0.0), lambda t, e: t + e)
    return df.withColumn("point", F.array(*(dot(r["loadings"]) for r in rows)))


def weight_deltas(rows: DataFrame, keys: list[str], step: str, feature: str, weight: str, top: int) -> DataFrame:
    """Each feature's change since the step before (the first: from 0), the step's norm, and the `top` by change."""
    w = W.partitionBy(*keys, feature).orderBy(step)
    d = rows.withColumn("delta", F.col(weight) - F.coalesce(F.lag(weight).over(w), F.lit(0.0)))
    by_step = W.partitionBy(*keys, step)
    d = d.withColumns({"norm": F.sqrt(F.sum(F.col("delta") * F.col("delta")).over(by_step)), "rank": F.row_number().over(by_step.orderBy(F.desc(F.abs("delta")), feature))})
    return d.filter(F.col("rank") <= top)


def loss_surface(stats: DataFrame, weights: DataFrame, p: int, lam: float = 1.0) -> DataFrame:
    """Loss and gradient of many weight vectors from one row of statistics, without touching the rows again."""
    g = np.array(stats.first()["g"], dtype=float)[None, :]
    fit = solve(g, p, lam)
    n, sd, mu, m = g[0, 0], fit["sd"][0], fit["mu"][0], fit["impute"][0]
    c, s, u, v = (g[0, 3 + k * p : 3 + (k + 1) * p] for k in range(4))
    cross, part, none = (g[0, 3 + 4 * p + k * p * p : 3 + 4 * p + (k + 1) * p * p].reshape(p, p) for k in range(3))
    full = cross + m[None, :] * part + m[:, None] * part.T + np.outer(m, m) * none
    a = (full - n * np.outer(mu, mu)) / np.outer(sd, sd)
    b = (u + m * (g[0, 1] - v) - mu * g[0, 1]) / sd
    yy = g[0, 2] - g[0, 1] ** 2 / n

    def work(frames):
        for f in frames:
            w = np.array(f["w"].tolist(), dtype=float).reshape(len(f), p)
            aw = w @ a
            yield f[["id"]].assign(loss=yy - 2 * w @ b + (w * aw).sum(1) + lam * (w**2).sum(1), gradient=list(2 * (aw - b + lam * w)))

    return weights.select("id", "w").mapInPandas(work, f"id {weights.schema['id'].dataType.simpleString()}, loss double, gradient array<double>")


# Steps of the grid along the three axes, and the padding of its bounds as a share of the longest side.
GRID, PADDING = ((0.0, 0.25, 0.5, 0.75, 1.0), (0.0, 0.25, 0.5, 0.75, 1.0), (0.15, 0.5, 0.85)), 0.28


def gradient_field(stats: DataFrame, fit_weights: DataFrame, p: int, lam: float = 1.0) -> DataFrame:
    """id, coords, loss, descent and norm on the 5 x 5 x 3 grid of the axes of many fits' weights (a column w)."""
    spark = fit_weights.sparkSession
    axes = principal_axes(fit_weights, "w", 3)
    few = axes.orderBy("component").collect()
    k = len(few)
    points = projections(fit_weights, "w", axes)
    edges = points.agg(*(f(F.col("point")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("low", F.min), ("high", F.max)))).first()
    low, high = (np.array([edges[f"{n}{i}"] for i in range(k)], dtype=float) for n in ("low", "high"))
    pad = PADDING * max(float((high - low).max()), 1e-4)
    low, high = low - pad, high + pad
    loadings, mean = np.array([r["loadings"] for r in few]), np.array(few[0]["mean"])
    cells = [(i, (low + np.array(at[:k]) * (high - low)).tolist()) for i, at in enumerate((x, y, z) for x in GRID[0] for y in GRID[1] for z in GRID[2])]
    grid = spark.createDataFrame([(i, c, (mean + np.array(c) @ loadings).tolist()) for i, c in cells], "id int, coords array<double>, w array<double>")
    down = [F.aggregate(F.zip_with("gradient", F.array(*map(F.lit, v)), lambda a, b: a * b), F.lit(0.0), lambda t, e: t - e) for v in loadings.tolist()]
    out = grid.select("id", "coords").join(loss_surface(stats, grid, p, lam), "id").withColumn("descent", F.array(*down))
    return out.select("id", "coords", "loss", "descent", F.sqrt(F.aggregate("descent", F.lit(0.0), lambda t, e: t + e * e)).alias("norm"))


def loo_linear(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Each row predicted by the line through its key's other rows: totals minus the row's own terms."""
    t = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(e).alias(a) for a, e in (("_x", F.col(x)), ("_y", F.col(y)), ("_xx", F.col(x) ** 2), ("_xy", F.col(x) * F.col(y)))))
    j = df.join(t, keys).filter("_n > 1")
    n = F.col("_n") - 1
    mx, my = (F.col("_x") - F.col(x)) / n, (F.col("_y") - F.col(y)) / n
    var = (F.col("_xx") - F.col(x) ** 2) / n - mx * mx
    cov = (F.col("_xy") - F.col(x) * F.col(y)) / n - mx * my
    return j.withColumn("pred", my + cov / (var + 1e-12) * (F.col(x) - mx)).select(*df.columns, "pred")


def zslope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.covar_pop(x, y) / (F.stddev_pop(x) + 1e-9)).alias("slope"))


def sign_audit(weights: DataFrame, prior: dict[str, int]) -> DataFrame:
    """Fitted signs against the prior: feature, weight, prior, agrees (null where there is none)."""
    known = F.create_map(*(x for f, s in prior.items() for x in (F.lit(f), F.lit(s))))
    p = F.coalesce(F.try_element_at(known, F.col("feature")), F.lit(0))
    return weights.withColumn("prior", p).withColumn("agrees", F.when(F.col("prior") != 0, F.signum("weight") == F.col("prior")))
