"""Is a label signal or noise: variance components, reliability, dose response, screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from granary.functions.exprs import LARGE_GROUP, clean, pearson, ratio, row_numbers, with_group_size
from granary.operators.metrics import ranked, screened, spearman, top_picks
from granary.sources.scratch import stored


def gate(df: DataFrame, cohort: str, label: str, keys: list[str] = [], min_seeds: int = 2) -> DataFrame:
    """Variance within repeated cohorts against variance between cohort means, and a verdict."""
    per = df.filter(F.col(label).isNotNull()).groupBy(*keys, cohort).agg(F.avg(label).alias("m"), F.var_samp(label).alias("v"), F.count(label).alias("n"))
    out = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cohorts"), F.count_if(F.col("n") >= min_seeds).alias("n_with_repeats"), F.avg(F.when(F.col("n") >= min_seeds, F.col("v"))).alias("within"), F.var_samp("m").alias("between")
    )
    return gate_columns(out)


def gate_columns(df: DataFrame) -> DataFrame:
    """ICC, SNR and verdict from within and between variances."""
    b, w = F.col("between"), F.col("within")
    some = (b + w) > 1e-18
    icc = F.when(some, F.try_divide(b, F.when(some, b + w)))
    snr = F.when(some, F.sqrt(b) / (F.sqrt(w) + 1e-12))
    verdict = F.when(icc.isNull(), "insufficient_repeats").when(icc >= 0.5, "strong_signal").when(icc >= 0.2, "usable_signal").otherwise("noise_dominated")
    return df.withColumns({"icc": icc, "snr": snr, "within_std": F.sqrt(w), "between_std": F.sqrt(b), "verdict": verdict}).drop("within", "between")


def unpivoted(df: DataFrame, ids: list[str], columns: list[str], name: str = "label", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def seed_columns(df: DataFrame, keys: list[str], unit: str, value: str, pred: str | None = None, seed: str = "seed") -> DataFrame:
    """keys, unit, s0, s1, s2 (the value at a unit's first three seeds, in their order) and pred at the first, of units that have three."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, unit, seed, value, *([pred] if pred else []))
    rows = rows.withColumn("_turn", F.row_number().over(W.partitionBy(*keys, unit).orderBy(seed)) - 1).filter("_turn < 3")  # a unit's few seeds
    at = lambda i, c: F.max(F.when(F.col("_turn") == i, F.col(c)))
    out = rows.groupBy(*keys, unit).agg(*(at(i, value).alias(f"s{i}") for i in range(3)), *([at(0, pred).alias("pred")] if pred else []))
    return out.dropna(subset=["s0", "s1", "s2"])


def seed_pairs(df: DataFrame, keys: list[str], unit: str, value: str) -> DataFrame:
    """Mean of the Spearman correlations of the first three seeds, pair by pair."""
    wide = seed_columns(df, keys, unit, value)
    r = ranked(wide, keys, ["s0", "s1", "s2"], tie=unit)
    pairs = [pearson(f"rk_s{a}", f"rk_s{b}") for a, b in ((0, 1), (0, 2), (1, 2))]
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (sum(pairs[1:], pairs[0]) / 3).alias("r1"))


def spearman_brown(r: Column, k, clamp: float | None = None) -> Column:
    """Reliability of a mean of k seeds; a single-seed reliability of 0 or less gives 0, or is raised to `clamp`."""
    x = F.when(r > 0, r).otherwise(0.0) if clamp is None else F.greatest(r, F.lit(clamp))
    return k * x / (1 + (k - 1) * x)


def seed_projection(wide: DataFrame, keys: list[str], pred: str, unit: str, reliability: DataFrame, ks: list[int]) -> DataFrame:
    """Correlation of a prediction with means of 1, 2 and 3 seeds, and what k seeds should give.

    wide: keys, unit, pred, s0, s1, s2. The projection divides by the root of the reliability at 3 and
    multiplies by that at k, at most 1.
    """
    combos = [((0,), 1), ((1,), 1), ((2,), 1), ((0, 1), 2), ((0, 2), 2), ((1, 2), 2), ((0, 1, 2), 3)]
    means = {f"m{i}": sum((F.col(f"s{s}") for s in c[1:]), F.col(f"s{c[0]}")) / len(c) for i, (c, _) in enumerate(combos)}
    r = ranked(wide.withColumns(means), keys, [pred, *means], tie=unit)
    out = r.groupBy(*keys).agg(*(pearson(f"rk_{pred}", f"rk_m{i}").alias(f"c{i}") for i in range(len(combos))))
    mean = lambda k: sum((F.col(f"c{i}") for i, (_, n) in enumerate(combos) if n == k), F.lit(0.0)) / sum(n == k for _, n in combos)
    out = out.select(*keys, mean(1).alias("rho1"), mean(2).alias("rho2"), mean(3).alias("rho3")).join(reliability.select(*keys, "r1"), keys)
    true = F.least(F.lit(1.0), F.col("rho3") / F.sqrt(spearman_brown(F.col("r1"), 3, 1e-6)))
    return out.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("projected", true * F.sqrt(spearman_brown(F.col("r1"), F.col("k"), 1e-6)))


def topk_capture(df: DataFrame, keys: list[str], shares: list[float], large: int = LARGE_GROUP) -> DataFrame:
    """Mean truth of all rows, of the best by prediction and of the best by truth, and the captured share of the gap."""
    placed = with_group_size(row_numbers(df.select(*keys, "id", "pred", "truth"), keys, {"_p": ("pred", True), "_t": ("truth", True)}, "id", large), keys, "_n")
    rows = placed.withColumn("frac", F.explode(F.array(*map(F.lit, shares))))
    k = F.greatest(F.lit(1), F.bround(F.col("_n") * F.col("frac")).cast("int"))
    out = rows.groupBy(*keys, "frac").agg(F.avg("truth").alias("random"), F.avg(F.when(F.col("_p") <= k, F.col("truth"))).alias("pick"), F.avg(F.when(F.col("_t") <= k, F.col("truth"))).alias("oracle"))
    return out.withColumn("share", ratio(F.col("pick") - F.col("random"), F.col("oracle") - F.col("random")))


def crossfit_oracle(wide: DataFrame, keys: list[str], unit: str, share: float) -> DataFrame:
    """Select on the mean of two seeds and score on the third, in rotation; beside it the naive oracle on all three."""
    s = [F.col(f"s{i}") for i in range(3)]
    folds = F.array(*(F.struct(F.lit(h).alias("hold"), ((s[(h + 1) % 3] + s[(h + 2) % 3]) / 2).alias("pred"), s[h].alias("truth")) for h in range(3)))
    rows = wide.select(*keys, F.col(unit).alias("id"), F.explode(folds).alias("f"), ((s[0] + s[1] + s[2]) / 3).alias("all3")).select(*keys, "id", "f.hold", "f.pred", "f.truth", "all3")
    honest = top_picks(rows, [*keys, "hold"], share).groupBy(*keys).agg(F.avg("truth").alias("honest"))
    naive = top_picks(rows.filter("hold = 0"), keys, share, p="all3").groupBy(*keys).agg(F.avg("all3").alias("naive"))
    chance = rows.filter("hold = 0").groupBy(*keys).agg(F.avg("all3").alias("random"))
    out = honest.join(naive, keys).join(chance, keys)
    return out.withColumn("share_kept", ratio(F.col("honest") - F.col("random"), F.col("naive") - F.col("random")))


# Expected standard normal of the best 10, 20 and 30 percent.
TOP_MEAN = {0.1: 1.7550, 0.2: 1.3998, 0.3: 1.1590}


def parametric_oracle(mean: Column, sd: Column, r1: Column, share: float) -> Column:
    return mean + TOP_MEAN[share] * F.sqrt(spearman_brown(r1, 3, 1e-6)) * sd


def partial_rank_correlation(df: DataFrame, keys: list[str], x: str, y: str, z: str, tie: str = "id", large: int = LARGE_GROUP) -> DataFrame:
    """Rank correlation of x and y without what z explains; keys of fewer than 8 rows are left out."""
    rows = df.dropna(subset=[x, y, z]).select(*dict.fromkeys([*keys, tie, x, y, z]))  # large groups are written for each rank
    r = ranked(rows, keys, [x, y, z], tie, large=large).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), pearson(f"rk_{x}", f"rk_{y}").alias("xy"), pearson(f"rk_{x}", f"rk_{z}").alias("xz"), pearson(f"rk_{y}", f"rk_{z}").alias("yz")
    )
    rest = (1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)
    return r.filter("n >= 8").select(*keys, "n", F.coalesce(ratio(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt(F.when(rest > 1e-12, rest))), F.lit(0.0)).alias("partial"))


def feature_screen(df: DataFrame, features: list[str], y: str, domain: str, tie: str = "id", least: int = 6) -> DataFrame:
    """feature, domain, n, spearman and place: the rank correlation of each feature with y by domain, POOLED, and the AVERAGE over domains.

    Domains (and the pool) of fewer than `least` rows with the feature are left out. place orders the features by the magnitude
    of their average, to nine decimals and then by name. Domains and the pool are ranked in one pass; `df` is written once before.
    """
    data = stored(df.select(tie, F.col(domain).cast("string").alias(domain), y, *features), "screen-rows")
    own = stored(screened(data, domain, features, y, tie, "POOLED").filter(F.col("n") >= least), "screen")  # a row for each feature and domain
    mean = own.filter(F.col(domain) != "POOLED").groupBy("feature").agg(F.sum("n").alias("n"), F.avg("spearman").alias("spearman"))
    placed = mean.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.round(F.abs("spearman"), 9)), "feature")))  # one row for each feature
    out = own.unionByName(mean.select("feature", F.lit("AVERAGE").alias(domain), "n", "spearman"))
    return out.join(F.broadcast(placed.select("feature", "place")), "feature", "left").select("feature", domain, "n", "spearman", "place")


def dose_of(fraction: Column, name: Column) -> Column:
    """The share of corrupted answers: stated, or read from a cohort's name; null for other cohorts."""
    return F.coalesce(fraction, F.try_divide(F.nullif(F.regexp_extract(name, r"^labelnoise-(\d+)", 1), F.lit("")).try_cast("double"), F.lit(100.0)))


def dose_response(df: DataFrame, dose: str, lift: str, others: list[str] = [], tie: str = "id") -> DataFrame:
    """Per dose: n, mean and deviation of the lift and means of `others` (missing counts as 0); in every row the rank correlation of all
    rows, whether the means never rise with the dose, and the verdict: confirmed below -0.3. Rows without a dose are left out."""
    rows = df.filter(F.col(dose).isNotNull()).withColumn(lift, F.coalesce(clean(lift), F.lit(0.0)))
    per = rows.groupBy(dose).agg(F.count(F.lit(1)).alias("n"), F.avg(lift).alias("mean_lift"), F.coalesce(F.stddev_pop(lift), F.lit(0.0)).alias("sd_lift"), *(F.avg(F.coalesce(clean(c), F.lit(0.0))).alias(f"mean_{c}") for c in others))
    w = W.partitionBy(F.lit(0)).orderBy(dose)  # one row for each dose
    per = per.withColumn("rises", F.coalesce(F.col("mean_lift") > F.lag("mean_lift").over(w) + 1e-9, F.lit(False)))
    per = per.withColumn("non_increasing", ~F.bool_or("rises").over(W.partitionBy(F.lit(0))))
    rho = spearman(rows, [], dose, lift, tie).select("spearman")  # one row
    return per.crossJoin(F.broadcast(rho)).withColumn("verdict", F.when(F.col("spearman") < -0.3, "confirmed").otherwise("weak_or_absent"))


def within_percentile(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    placed = with_group_size(row_numbers(df, keys, {"_rn": (value, False)}, tie), keys, "_n")
    return placed.withColumn("pct", F.coalesce(F.try_divide((F.col("_rn") - 1).cast("double"), (F.col("_n") - 1).cast("double")), F.lit(0.0))).drop("_rn", "_n")


def tercile_effects(df: DataFrame, features: list[str], pct: str = "pct") -> DataFrame:
    """Cohen's d of every feature, top third against bottom third; at least 5 values on each side."""
    long = df.filter((F.col(pct) >= 2 / 3) | (F.col(pct) <= 1 / 3)).unpivot([pct], features, "feature", "x").filter("x is not null")
    hi = F.col(pct) >= 2 / 3
    a, b = F.when(hi, F.col("x")), F.when(~hi, F.col("x"))
    pooled = F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)
    return long.groupBy("feature").agg(((F.avg(a) - F.avg(b)) / F.when(pooled > 0, pooled).otherwise(1e-9)).alias("d"), F.count(a).alias("n_high"), F.count(b).alias("n_low")).filter("n_high >= 5 and n_low >= 5")
