"""Rollout and token analytics: advantages, per-candidate features, token statistics.

Tables are long: one row for a completion. Nothing is collected; group statistics are partial
aggregates, so a hot candidate only adds rows to the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from granary.functions.exprs import FLAT, LARGE_GROUP, clean, col, ratio
from granary.sources.scratch import stored


def group_advantages(rollouts: DataFrame, keys: list[str], reward: str = "reward", eps: float = 1e-8) -> DataFrame:
    """Rewards centred and scaled by population deviation within `keys`; 0 where all are equal.

    Group moments come from a partial aggregate joined back, not from a window: a group of any size
    is split over tasks.
    """
    stats = rollouts.groupBy(*keys).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_sd"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    joined = rollouts.alias("r").join(stats.alias("s"), same, "left")
    value = F.when(F.col("_sd") > FLAT, (F.col(f"r.{reward}") - F.col("_mean")) / (F.col("_sd") + eps)).otherwise(0.0)
    return joined.select("r.*", value.alias("advantage"))


_OPTIONAL = ("reward", "advantage", "completion_tokens", "mean_logprob", "mean_entropy", "early_logprob", "late_logprob", "min_logprob")
_SHARES = (0.1, 0.5, 0.9)
#: Rows of a key, on average, up to which one more sort for its quantiles costs less than percentile.
SMALL_KEY = 16


def _same(keys: list[str]) -> list[Column]:
    return [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]


def _row_statistics() -> dict[str, Column]:
    hit = (F.col("reward") > 0.5).cast("double")
    return {
        "n_rollouts": F.count(F.lit(1)),
        "reward_mean": F.coalesce(F.avg("reward"), F.lit(0.0)),
        "reward_std": F.coalesce(F.stddev_pop("reward"), F.lit(0.0)),
        "pass_rate": F.coalesce(F.avg(hit), F.lit(0.0)),
        "mean_logprob": F.avg("mean_logprob"),
        "surprisal_mean": (-F.avg("mean_logprob")),
        "entropy_mean": F.avg("mean_entropy"),
        "confidence_slope": F.when(F.count("early_logprob") == F.count("late_logprob"), F.avg("late_logprob") - F.avg("early_logprob")),
        "redundancy_mean": F.avg(F.exp("mean_logprob")),
        "min_logprob_mean": F.avg("min_logprob"),
        "len_mean": F.avg("completion_tokens"),
        "len_std": F.stddev_pop("completion_tokens"),
        "len_max": F.max("completion_tokens"),
        "len_cv": (F.stddev_pop("completion_tokens") / (F.avg("completion_tokens") + 1e-9)),
        "adv_std": F.stddev_pop("advantage"),
        "adv_absmean": F.avg(F.abs("advantage")),
        "reward_gap": (F.max("reward") - F.min("reward")),
    }


def _group_statistics(one: Column) -> dict[str, Column]:
    """Over rows with a group's _n, _pass, _sd, _all and _any, of which `one` picks one for each group."""
    multi = lambda c: F.avg(F.when(one & (F.col("_n") >= 2), c))
    return {
        "n_groups": F.count_if(one),
        "group_passrate_mean": multi(F.col("_pass")),
        "group_passrate_std": F.stddev_pop(F.when(one & (F.col("_n") >= 2), F.col("_pass"))),
        "frac_nondegenerate": multi((F.col("_sd") > FLAT).cast("double")),
        "frac_all_correct": multi((F.col("_all") == 1).cast("double")),
        "frac_all_wrong": multi((F.col("_any") == 0).cast("double")),
    }


def _quantiles(accuracy: int | None) -> Column:
    return F.percentile("mean_logprob", F.array(*map(F.lit, _SHARES))) if accuracy is None else F.percentile_approx("mean_logprob", list(_SHARES), accuracy)


def _between(low: Column, high: Column, at: Column) -> Column:
    """The value at a place between two neighbours, as percentile gives it."""
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


_ASKED = [f"logprob_p{round(100 * p)}" for p in _SHARES]


def summarize_rollouts(
    rollouts: DataFrame, keys: list[str], group: str = "group_id", accuracy: int | None = None, only: tuple[str, ...] | None = None, advantages: bool = False, large: int = LARGE_GROUP
) -> DataFrame:
    """26 statistics for each key: row moments, and statistics of groups with two or more rewards.

    Optional columns: reward, advantage, completion_tokens, mean_logprob, mean_entropy, early_logprob,
    late_logprob, min_logprob, comp_hash. No rows of a kind: reward_mean, reward_std and pass_rate 0,
    all others null. Quantiles are exact, holding a key's distinct values; `accuracy` asks for sketches
    of that size instead, for keys of very many rows. `only` names the statistics to compute. advantages: the advantage
    is computed here, within each key's groups.

    Rows are dealt by key once: groups, distinct completions and moments then need sorts inside
    tasks, no further exchange. Keys of more than `large` rows are aggregated in parts instead, which no task holds whole.
    """
    for c in _OPTIONAL:
        if c not in rollouts.columns:
            rollouts = rollouts.withColumn(c, F.lit(None).cast("double"))
    if "comp_hash" not in rollouts.columns:
        rollouts = rollouts.withColumn("comp_hash", F.lit(None).cast("string"))
    rollouts = rollouts.select(*keys, group, *_OPTIONAL, "comp_hash")
    sizes = rollouts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    largest, mean = sizes.agg(F.max("_rows"), F.avg("_rows")).first()
    few = (mean or 0) <= SMALL_KEY
    if not largest or largest <= large:
        return _in_tasks(rollouts, keys, group, accuracy, only, advantages, few)
    hot = stored(sizes.filter(F.col("_rows") > large).select(*keys), "hot-keys")  # at most one for every `large` rows
    split = lambda how: rollouts.alias("a").join(hot.alias("b"), _same(keys), how)
    return _in_tasks(split("left_anti"), keys, group, accuracy, only, advantages, few).unionByName(_in_parts(split("left_semi"), keys, group, accuracy, only, advantages))


def _in_tasks(rollouts: DataFrame, keys: list[str], group: str, accuracy: int | None, only: tuple[str, ...] | None, advantages: bool, few: bool) -> DataFrame:
    wanted = lambda c: only is None or c in only
    own = W.partitionBy(*keys, group)
    hit = (F.col("reward") > 0.5).cast("double")
    rows = rollouts.repartition(*keys)
    rows = rows.withColumns({"_n": F.count("reward").over(own), "_pass": F.avg(hit).over(own), "_sd": F.stddev_pop("reward").over(own), "_mean": F.avg("reward").over(own), "_all": F.min(hit).over(own), "_any": F.max(hit).over(own)})
    # one row with a reward stands for its group, one row for each distinct completion
    rows = rows.withColumn("_one", (F.row_number().over(own.orderBy(F.col("reward").isNull())) == 1) & F.col("reward").isNotNull() & F.col(group).isNotNull())
    if advantages:
        rows = rows.withColumn("advantage", F.when(F.col("_sd") > FLAT, (F.col("reward") - F.col("_mean")) / (F.col("_sd") + 1e-8)).otherwise(0.0))
    values = {c: e for c, e in {**_row_statistics(), **_group_statistics(F.col("_one"))}.items() if wanted(c)}
    if wanted("distinct_frac"):
        rows = rows.withColumn("_new", (F.row_number().over(W.partitionBy(*keys, "comp_hash").orderBy("comp_hash")) == 1) & F.col("comp_hash").isNotNull())
        values["distinct_frac"] = ratio(F.count_if("_new"), F.count("comp_hash"))
    asked = [c for c in _ASKED if wanted(c)]
    exact = bool(asked) and accuracy is None and few
    if exact:  # by places in the sorted key: with percentile, which is no plain aggregate, Spark would compile none of the others
        key = W.partitionBy(*keys)
        rows = rows.withColumns({"_turn": F.row_number().over(key.orderBy(F.asc_nulls_last("mean_logprob"))) - 1, "_values": F.count("mean_logprob").over(key)})
        for c, share in zip(_ASKED, _SHARES):
            at = (F.col("_values") - 1) * F.lit(share)
            values |= {f"_{part}_{c}": F.max(F.when((F.col("_turn") == place(at)) & (F.col("_values") > 0), F.col("mean_logprob"))) for part, place in (("low", F.floor), ("high", F.ceil))}
        values["_values"] = F.max("_values")
    out = rows.groupBy(*keys).agg(*(e.alias(c) for c, e in values.items()), *([_quantiles(accuracy).alias("_quantiles")] if asked and not exact else []))
    if exact:
        out = out.withColumn("_quantiles", F.array(*(_between(F.col(f"_low_{c}"), F.col(f"_high_{c}"), (F.col("_values") - 1) * F.lit(share)) for c, share in zip(_ASKED, _SHARES))))
    order = [*(c for c in _row_statistics() if c in values), *asked, *(c for c in ("distinct_frac",) if c in values), *(c for c in _group_statistics(F.lit(True)) if c in values)]
    return out.select(*keys, *(F.col("_quantiles")[_ASKED.index(c)].alias(c) if c in asked else c for c in order))


def _in_parts(rollouts: DataFrame, keys: list[str], group: str, accuracy: int | None, only: tuple[str, ...] | None, advantages: bool) -> DataFrame:
    wanted = lambda c: only is None or c in only
    if advantages:
        rollouts = group_advantages(rollouts.drop("advantage"), [*keys, group])
    hit = (F.col("reward") > 0.5).cast("double")
    grouped = (
        rollouts.filter(F.col("reward").isNotNull() & F.col(group).isNotNull())
        .groupBy(*keys, group)
        .agg(F.count("reward").alias("_n"), F.avg(hit).alias("_pass"), F.stddev_pop("reward").alias("_sd"), F.min(hit).alias("_all"), F.max(hit).alias("_any"))
    )
    of_rows = {c: e for c, e in _row_statistics().items() if wanted(c)}
    more = [_quantiles(accuracy).alias("_quantiles")] if any(map(wanted, _ASKED)) else []
    rows = rollouts.groupBy(*keys).agg(*(e.alias(c) for c, e in of_rows.items()), *(more or [F.count(F.lit(1)).alias("_rows")]))
    parts = [rows.select(*keys, *of_rows, *(F.col("_quantiles")[i].alias(c) for i, c in enumerate(_ASKED) if wanted(c)))]
    if wanted("distinct_frac"):  # distinct values apart from the rest, else all of it would be aggregated by value first
        kinds = rollouts.filter(F.col("comp_hash").isNotNull()).groupBy(*keys, "comp_hash").agg(F.count(F.lit(1)).alias("_n"))
        parts.append(kinds.groupBy(*keys).agg(ratio(F.count(F.lit(1)), F.sum("_n")).alias("distinct_frac")))
    own = {c: e for c, e in _group_statistics(F.lit(True)).items() if wanted(c)}
    if own:
        parts.append(grouped.groupBy(*keys).agg(*(e.alias(c) for c, e in own.items())))
    out = parts[0]
    for p in parts[1:]:
        out = out.alias("a").join(p.alias("b"), _same(keys), "left").select("a.*", *(F.col(f"b.{c}") for c in p.columns if c not in keys))
    return out.withColumn("n_groups", F.coalesce("n_groups", F.lit(0))) if "n_groups" in own else out


def token_stats(logp, empty_late: str = "zero") -> dict[str, Column]:
    """Statistics of an array of token log-probabilities; the first half has max(n // 2, 1) tokens.

    empty_late: a single token leaves no late half, which counts as 0 ("zero"), repeats the last token
    ("last"), or makes early and late null for fewer than four tokens ("four").
    """
    a = col(logp)
    n = F.size(a)
    half = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
    mean = lambda x: F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, e: s + e), F.size(x).cast("double"))
    early, late = mean(F.slice(a, F.lit(1), half)), mean(F.slice(a, half + 1, F.greatest(n - half, F.lit(0))))
    if empty_late == "zero":
        late = F.coalesce(late, F.lit(0.0))
    elif empty_late == "last":
        late = F.coalesce(late, F.try_element_at(a, F.lit(-1)))
    else:
        early, late = F.when(n >= 4, early), F.when(n >= 4, late)
    some = n > 0
    return {"mean_logprob": F.when(some, mean(a)), "early_logprob": F.when(some, early), "late_logprob": F.when(some, late), "min_logprob": F.array_min(a)}


def distinct_fraction(rollouts: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rollouts.groupBy(*keys).agg(ratio(F.count_distinct(value), F.count(value)).alias("distinct_frac"))


def engineered_features(rollouts: DataFrame, keys: list[str], row: str, tokens: str, logp: str, long: int = 230) -> DataFrame:
    """Pooled token statistics and the share of each completion's most frequent token.

    Arrays are summed where they lie, so one scan gives one narrow row for each completion; equal completions are merged
    first, then keys.
    """
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    # the longest run of the sorted tokens
    run = F.aggregate(
        F.array_sort(tokens),
        F.struct(F.lit(None).cast(rollouts.schema[tokens].dataType.elementType).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top")),
        lambda s, x: F.struct(x.alias("last"), F.when(s["last"] == x, s["run"] + 1).otherwise(1).alias("run"), F.greatest(s["top"], F.when(s["last"] == x, s["run"] + 1).otherwise(1)).alias("top")),
        lambda s: s["top"],
    )
    n = F.size(tokens)
    own = rollouts.select(
        *keys, F.md5(F.concat_ws(",", tokens)).alias("_hash"), F.size(logp).alias("_m"), add(F.col(logp)).alias("_s"), add(F.transform(logp, lambda x: x * x)).alias("_q"), F.array_min(logp).alias("_low"), F.try_divide(run.cast("double"), F.when(n > 0, n)).alias("_rep"),
        (n > long).cast("double").alias("_long"),
    )
    sums = {"_n": F.count(F.lit(1)), "_m": F.sum("_m"), "_s": F.sum("_s"), "_q": F.sum("_q"), "_low": F.min("_low"), "_rep": F.sum("_rep"), "_reps": F.count("_rep"), "_long": F.sum("_long")}
    kinds = own.groupBy(*keys, "_hash").agg(*(e.alias(c) for c, e in sums.items()))
    total = {c: F.min(c) if c == "_low" else F.sum(c) for c in sums}
    out = kinds.groupBy(*keys).agg(F.count(F.lit(1)).alias("_kinds"), *(e.alias(c) for c, e in total.items()))
    mean = ratio("_s", "_m")
    return out.select(
        *keys, F.sqrt(F.greatest(ratio("_q", "_m") - mean * mean, F.lit(0.0))).alias("tok_std"), F.col("_low").alias("tok_min"), F.exp(-mean).alias("perplexity"), ratio("_rep", "_reps").alias("max_tok_rep"), ratio("_long", "_n").alias("frac_long"),
        ratio("_kinds", "_n").alias("distinct_frac"),
    )


def unigrams(bags: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Relative frequencies of the words [a-z0-9]+ of each bag: keys, token, p."""
    words = bags.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    counts = words.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("t"))
    return counts.join(totals, keys).select(*keys, "token", (F.col("c") / F.col("t")).alias("p"))


#: Tokens of a probe that are sent to all tasks; beyond them tokens in more than HOT_SHARE of the bags' rows spread over SALTS parts.
PROBE_BROADCAST, HOT_SHARE, SALTS = 1_000_000, 1 / 1024, 64


def with_probe(bags: DataFrame, probe: DataFrame, limit: int = PROBE_BROADCAST) -> DataFrame:
    """`bags` (token, p) with q, the probe's frequency of the token, or null.

    A probe of up to `limit` tokens goes to all tasks. A larger one is joined by token: the frequent tokens, at
    most 1 / HOT_SHARE of them, are counted first, dealt over SALTS parts and repeated for these on the probe's side.
    """
    probe = probe.select("token", F.col("p").alias("q"))
    if probe.limit(limit + 1).count() <= limit:
        return bags.join(F.broadcast(probe), "token", "left")
    bags = stored(bags, "bags")
    hot = bags.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > F.lit(bags.count() * HOT_SHARE)).select("token", F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.floor(F.rand(1) * SALTS).cast("int")).otherwise(0)
    salted = stored(bags.join(F.broadcast(hot), "token", "left").withColumn("_salt", salt).drop("_hot"), "salted-bags")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = probe.join(F.broadcast(hot), "token", "left").select("token", "q", F.explode(parts).alias("_salt"))
    return salted.join(spread, ["token", "_salt"], "left").drop("_salt")


def cosine_to_probe(bags: DataFrame, probe: DataFrame, keys: list[str], limit: int = PROBE_BROADCAST) -> DataFrame:
    """Cosine of every bag of unigrams with one common bag (token, p)."""
    norm = probe.agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("nb"))
    dots = with_probe(bags, probe, limit).groupBy(*keys).agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0.0)).alias("dot"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("na"))
    # the norm is one row
    return dots.crossJoin(F.broadcast(norm)).select(*keys, (F.col("dot") / (F.col("na") * F.coalesce("nb", F.lit(0.0)) + 1e-9)).alias("similarity"))


def token_weighted_nll(rows: DataFrame, keys: list[str], loss: str, tokens: str) -> DataFrame:
    return rows.groupBy(*keys).agg(ratio(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens)).alias("nll"))


def kl_positions(p: Column, q: Column) -> Column:
    """Sum over a position's vocabulary of p (log p - log q)."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: a * (F.ln(a) - F.ln(b))), F.lit(0.0), lambda s, x: s + x)


def reward_summary(rows: DataFrame, keys: list[str], reward: tuple[str, ...] = ("reward", "score"), tokens: tuple[str, ...] = ("completion_tokens", "num_completion_tokens", "tokens")) -> DataFrame:
    """Count and means over the first of the given columns that has a number; null if none has.

    A column may be a struct with a field of its own name, as {"reward": {"reward": 1}}. Text is no number.
    """
    nested = lambda c: clean(F.col(c).getField(c)) if isinstance(rows.schema[c].dataType, T.StructType) else clean(c)
    first = lambda names: F.coalesce(*(nested(c) for c in names if c in rows.columns), F.lit(None).cast("double"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(first(reward)).alias("mean_reward"), F.avg(first(tokens)).alias("mean_tokens"))


def policy_loss(new: Column, old: Column, ref: Column, advantage: Column, clip: float = 0.2, beta: float = 0.04) -> tuple[Column, Column]:
    """Clipped loss and share of clipped tokens over the common prefix of three log-probability arrays."""
    n = F.least(F.size(new), F.size(old), F.size(ref))
    cut = lambda x: F.slice(x, F.lit(1), n)
    triple = F.zip_with(F.zip_with(cut(new), cut(old), lambda c, o: F.struct(c.alias("c"), o.alias("o"))), cut(ref), lambda t, r: F.struct(t["c"].alias("c"), t["o"].alias("o"), r.alias("r")))

    def loss(t):
        rho = F.exp(t["c"] - t["o"])
        gain = F.least(rho * advantage, F.least(F.greatest(rho, F.lit(1 - clip)), F.lit(1 + clip)) * advantage)
        drift = t["r"] - t["c"]
        return -gain + beta * (F.exp(drift) - drift - 1)

    add = lambda s, x: s + x
    total = F.aggregate(F.transform(triple, loss), F.lit(0.0), add)
    clipped = F.aggregate(F.transform(triple, lambda t: (F.abs(F.exp(t["c"] - t["o"]) - 1) > clip).cast("double")), F.lit(0.0), add)
    return F.try_divide(total, n.cast("double")), F.try_divide(clipped, n.cast("double"))


def truncate_after(ids: Column, end: int) -> Column:
    """Through the first `end`, or all."""
    at = F.array_position(ids, F.lit(end)).cast("int")
    return F.slice(ids, F.lit(1), F.when(at > 0, at).otherwise(F.size(ids)))


def encode_window(prompt: Column, completion: Column, limit: int) -> tuple[Column, Column]:
    """Ids cut at the limit, and how many of them are targets (behind the prompt)."""
    ids = F.slice(F.concat(prompt, completion), 1, limit)
    return ids, F.greatest(F.size(ids) - F.size(prompt), F.lit(0))
