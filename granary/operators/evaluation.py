"""Evaluation of predictors out of fold: every metric of a model and of its baselines, ladders of settings, sweeps.

Predictions of an evaluation lie in columns of one table, so one pass of each metric serves the model and the
baselines together; beyond FEW groups in one long table (name, id, grp, pred, truth). Single-feature baselines follow from the additive statistics
of all features by fold, in one pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from granary.functions.exprs import FLAT, clean, pearson, r9, ratio
from granary.operators import fits as G, labels as L, metrics as M
from granary.operators.metrics import screened
from granary.operators.wide_metrics import Wide
from granary.sources.scratch import stored

# Baselines of one feature each, by name.
NAMED = {"difficulty_only": "pass_rate", "reward_only": "reward_mean", "redundancy_only": "redundancy_mean", "gradient_alignment": "grad_align"}
PICKS = 0.25


def _joined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "left")
    return out


def all_metrics(pred: DataFrame, keys: list[str], group: str = "grp", deadband: float = 0.0) -> DataFrame:
    """keys and every metric of predictions (id, group, pred, truth): errors, correlations, and choice within groups."""
    e = F.col("pred") - F.col("truth")
    plain = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), pearson("pred", "truth").alias("pearson"), F.avg((M.sign3(F.col("pred"), deadband) == M.sign3(F.col("truth"), deadband)).cast("double")).alias("sign_accuracy")
    )
    within = M.spearman(pred, [*keys, group]).filter("n >= 2").groupBy(*keys).agg(F.avg("spearman").alias("within_anchor_spearman"))
    pairs = M.concordance(pred, [*keys, group]).groupBy(*keys).agg(ratio(F.sum("right"), F.sum("pairs")).alias("pairwise_ranking_accuracy"))
    best = pred.groupBy(*keys, group).agg((F.max("truth") - F.min(F.struct((-F.col("pred")).alias("p"), "id", "truth"))["truth"]).alias("_regret"), F.avg("truth").alias("_random"))
    regret = best.groupBy(*keys).agg(F.avg("_regret").alias("top1_regret"), F.avg("_random").alias("selection_random"))
    model = M.top_picks(pred, [*keys, group], PICKS).groupBy(*keys).agg(F.avg("truth").alias("selection_model"))
    oracle = M.top_picks(pred, [*keys, group], PICKS, p="truth").groupBy(*keys, group).agg(F.avg("truth").alias("_o")).groupBy(*keys).agg(F.avg("_o").alias("selection_oracle"))
    out = _joined([plain, M.spearman(pred, keys).drop("n"), within, pairs, regret, model, oracle], keys)
    return _with_lift(out.withColumn("within_anchor_spearman", F.coalesce("within_anchor_spearman", F.lit(0.0))))


def _with_lift(out: DataFrame) -> DataFrame:
    gain, room = F.col("selection_model") - F.col("selection_random"), F.col("selection_oracle") - F.col("selection_random")
    return out.withColumns({"selection_lift": gain, "frac_of_oracle": F.coalesce(ratio(gain, F.when(F.abs(room) > 1e-15, room)), F.lit(float("nan")))})


def single_feature_columns(df: DataFrame, fold: str, ids: list[str], features: list[str], y: str, lam: float = 1.0, of: DataFrame | None = None) -> DataFrame:
    """ids and _p0, _p1, ...: each feature alone, every fold predicted from all others, in closed form from one pass of sums; last their mean.

    `of`: the rows to predict, if these aren't `df` itself.
    """
    p = len(features)
    data, means = G.centred(df, features)
    own = stored(G.statistics(data, [fold], p, y), "fold-sums")
    total = G.summed(own, []).withColumnRenamed("g", "all")
    rest = own.crossJoin(F.broadcast(total)).select(fold, G.minus("all", "g").alias("g")).filter(F.col("g")[0] > 0.5)  # one row of totals
    kind = df.schema[fold].dataType.simpleString()

    def fitted(frames):
        for f in frames:
            g = np.array(f["g"].tolist(), dtype=float).reshape(len(f), -1)
            n, sy = g[:, :1], g[:, 1:2]
            c, s, u, v = (g[:, 3 + k * p : 3 + (k + 1) * p] for k in range(4))
            q = g[:, 3 + 4 * p : 3 + 4 * p + p * p].reshape(-1, p, p).diagonal(axis1=1, axis2=2)
            m = np.where(c > 0, s / np.maximum(c, 1), 0.0)
            mu = (s + (n - c) * m) / n
            var = np.maximum(q + (n - c) * m * m - n * mu * mu, 0) / n
            slope = np.where(np.sqrt(var) > FLAT, (u + m * (sy - v) - mu * sy) / np.where(np.sqrt(var) > FLAT, var * (n + lam), 1), 0.0)
            yield pd.DataFrame({fold: f[fold].to_numpy(), "_base": (sy / n)[:, 0], "_m": m.tolist(), "_mu": mu.tolist(), "_slope": slope.tolist()})

    fit = stored(rest.mapInPandas(fitted, f"`{fold}` {kind}, _base double, _m array<double>, _mu array<double>, _slope array<double>"), "fold-fits")  # of known size: few are broadcast
    each = [F.col("_base") + F.col("_slope")[i] * (F.coalesce(F.col("_x")[i], F.col("_m")[i]) - F.col("_mu")[i]) for i in range(p)]
    if of is not None:
        data = of.withColumn("_x", F.array(*(clean(f) - F.lit(m) for f, m in zip(features, means))))
    return data.join(fit, fold).select(*ids, *(e.alias(f"_p{i}") for i, e in enumerate([*each, F.col("_base")])))


def single_feature_predictions(df: DataFrame, fold: str, ids: list[str], features: list[str], y: str, lam: float = 1.0) -> DataFrame:
    """ids, feature, pred: `single_feature_columns` without the mean, as one row for each feature."""
    wide = single_feature_columns(df, fold, ids, features, y, lam)
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"_p{i}").alias("pred")) for i, f in enumerate(features)))
    return wide.select(*ids, F.explode(each).alias("_each")).select(*ids, "_each.feature", "_each.pred")


def _varying(df: DataFrame, features: list[str]) -> list[str]:
    spread = df.agg(*(F.stddev_pop(clean(f)).alias(f"_{i}") for i, f in enumerate(features))).first()  # one row
    return [f for i, f in enumerate(features) if spread[i] is not None and spread[i] > FLAT]


def baseline_scores(df: DataFrame, fold: str, features: list[str], y: str = "y", key: str = "row_id", anchor: str = "anchor") -> DataFrame:
    """feature, n, rmse and within-anchor Spearman of each single feature and of the mean (predict_mean), under the same folds; constant features are left out."""
    named = df.select(fold, F.col(key).alias("id"), F.col(anchor).alias("grp"), F.col(y).cast("double").alias("truth"), *features)
    ids, varying = ["id", "grp", "truth"], _varying(df, features)
    names = [*varying, "predict_mean"]
    columns = [f"_p{i}" for i in range(len(names))]
    wide = single_feature_columns(named, fold, ids, varying, "truth").select(*ids, *columns)
    of = F.array(*(F.struct(F.lit(f).alias("feature"), F.count(c).alias("n"), F.sqrt(F.avg((F.col(c) - F.col("truth")) * (F.col(c) - F.col("truth")))).alias("rmse")) for f, c in zip(names, columns)))
    errors = wide.agg(of.alias("_of")).select(F.inline("_of")).filter("n > 0")
    rounded = wide.select(*ids, *(r9(c).alias(f) for f, c in zip(names, columns)))  # equal to nine decimals is a tie
    ranks = screened(rounded, "grp", names, "truth")
    return errors.join(ranks.filter("n >= 2").groupBy("feature").agg(F.avg("spearman").alias("within_anchor_spearman")), "feature", "left").withColumn("within_anchor_spearman", F.coalesce("within_anchor_spearman", F.lit(0.0)))


def evaluate(
    df: DataFrame, features: list[str], scheme: str = "logo", label: str = "y", alpha: float = 0.2, deadband: float = 0.0, lam: float = 1.0, key: str = "row_id", chain: str = "chain_id", anchor: str = "anchor", least: int = 3
) -> DataFrame:
    """One row for the model (ridge on all features, out of fold) and one for each baseline under the same folds.

    df: a matrix (see labels.build_xy) whose target column is `label`. scheme: logo folds by chain, and falls back to loocv, a fold
    for each row, where there are fewer than two chains. Beside all metrics the rows have scheme, label and n_features; the model's
    row has the conformal interval for `alpha`, the best single feature by within-anchor Spearman (constant ones are left out, the
    first of equals counts) and whether the model is at least as good as difficulty alone and as that feature. Fewer than `least` rows are an error.
    """
    if scheme not in ("logo", "loocv"):
        raise ValueError(f"unknown scheme {scheme!r}: logo or loocv")
    data = stored(df.filter(clean(label).isNotNull()).select(F.col(key).alias("id"), F.col(anchor).alias("grp"), F.col(chain).alias("_chain"), clean(label).alias("truth"), *features), "evaluation")
    n, chains = data.agg(F.count(F.lit(1)), F.count_distinct("_chain")).first()
    if n < least:
        raise ValueError(f"{n} labels, at least {least} are needed")
    scheme = "logo" if scheme == "logo" and chains >= 2 else "loocv"
    fold = "_chain" if scheme == "logo" else "id"
    model = G.oof_predict(data, fold, features, "truth", lam) if scheme == "logo" else G.loocv(data, "id", features, "truth", lam)
    varying = _varying(data, features)
    ids = ["id", "grp", "truth"]
    single = single_feature_columns(data, fold, [*ids, "pred"], varying, "truth", lam, of=model)
    of = {name: f"_p{varying.index(f)}" for name, f in NAMED.items() if f in varying}
    given = {"model": "pred", "predict_mean": f"_p{len(varying)}", **of}
    wide = stored(single.select(*ids, *(F.col(c).alias(name) for name, c in given.items())), "evaluation-predictions")
    names = list(given)
    few = Wide(wide, names)
    if few.fits:
        scores = stored(_with_lift(few.metrics(PICKS, deadband).withColumn("within_anchor_spearman", F.coalesce("within_anchor_spearman", F.lit(0.0)))), "evaluation-scores")
        half = few.conformal("model", alpha).select(F.lit("model").alias("name"), "q", "coverage", "indeterminate")
    else:
        long = wide.unpivot(["id", "grp", "truth"], names, "name", "pred").filter("pred is not null")
        scores = stored(all_metrics(long, ["name"], "grp", deadband), "evaluation-scores")
        half = G.conformal(wide.select("id", "truth", F.col("model").alias("pred"), F.lit(0).alias("_k")), ["_k"], alpha).select(F.lit("model").alias("name"), "q", "coverage", "indeterminate")
    order = F.element_at(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*map(F.lit, range(len(features))))), F.col("feature"))
    rounded = single.select(*ids, *(r9(f"_p{i}").alias(f) for i, f in enumerate(varying)))  # equal to nine decimals is a tie
    ranks = screened(rounded, "grp", varying, "truth").filter("n >= 2").groupBy("feature").agg(F.avg("spearman").alias("s"))
    best = ranks.agg(F.min(F.struct((-r9("s")).alias("s"), order.alias("i"), "feature")).alias("_b")).select(F.lit("model").alias("name"), F.col("_b.feature").alias("best_single_feature"), (-F.col("_b.s")).alias("best_single_spearman"))
    difficulty = scores.agg(F.max(F.when(F.col("name") == "difficulty_only", F.col("within_anchor_spearman"))).alias("_d")).select(F.lit("model").alias("name"), "_d")
    out = _joined([scores, half, best, difficulty], ["name"]).withColumns({"scheme": F.lit(scheme), "label": F.lit(label), "n_features": F.lit(len(features))})
    at_least = lambda c: F.when(F.col("name") == "model", r9("within_anchor_spearman") >= F.coalesce(r9(c), F.lit(-2.0)))
    return out.withColumns({"beats_difficulty": at_least("_d"), "beats_best_single_feature": at_least("best_single_spearman")}).drop("_d")


def evaluate_labels(labels: DataFrame, ids: list[str], label: str = "acc", context: bool = True, **options) -> DataFrame:
    """`evaluate` on label rows: the matrix of all features and the target `label` (acc, nll or utility) is built first."""
    names = [*L.FEATURE_KEYS, *(L.CONTEXT_KEYS if context else [])]
    return evaluate(L.build_xy(labels, ids, label, context=context), names, **options).withColumn("label", F.lit(label))


def spearman_with_overall(pred: DataFrame, key: str, id_: str = "row_id", y: str = "y") -> DataFrame:
    """Spearman by key, and a row ALL over every prediction, in one exchange."""
    pred = stored(pred.select(F.col(key), F.col(id_).alias("id"), "pred", F.col(y).alias("truth")), "predictions")
    return screened(pred, key, ["pred"], "truth", pool="ALL").drop("feature")


def leave_one_out_ladder(df: DataFrame, fold: str, settings: dict[str, list[str]], y: str = "y", key: str = "row_id") -> DataFrame:
    """setting, fold, n, spearman: each setting's features, every value of `fold` predicted from all others, and ALL of them together."""
    out = None
    for name, features in settings.items():
        part = spearman_with_overall(G.oof_predict(df, fold, features, y), fold, key, y).withColumn("setting", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def feature_sweep(labels: DataFrame, configs: dict[str, tuple[list[str], bool, str | None]], mode: str = "nll", domain: str = "domain", unit: str = "candidate_id", folds: int = 5, seed=1) -> DataFrame:
    """config, within, transfer: mean rank correlation over domains on seed means, within them (hash folds of units) and from all other domains.

    configs: name to (keys, with context, the column within which features are scaled). `labels` is written once for all of them.
    """
    out, labels = None, stored(labels, "sweep-labels")
    for name, (keys, context, scale) in configs.items():
        names = [*keys, *(L.CONTEXT_KEYS if context else [])]
        xy = L.build_xy(labels, [domain, unit], mode, keys, context, scale)
        mean = stored(L.denoise_seeds(xy, [domain, unit], names, "y"), "sweep").withColumn("fold", F.concat_ws(":", domain, G.hash_fold(unit, folds, seed).cast("string")))
        score = lambda p, c: M.spearman(p.select(domain, F.col(unit).alias("id"), "pred", F.col("y").alias("truth")), [domain]).agg(F.avg("spearman").alias(c))
        row = score(G.oof_predict(mean, "fold", names, "y", within=domain), "within").crossJoin(score(G.oof_predict(mean, domain, names, "y"), "transfer")).select(F.lit(name).alias("config"), "within", "transfer")  # one row each
        out = row if out is None else out.unionByName(row)
    return out
