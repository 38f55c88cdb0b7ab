"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Each distinct URL expands to (host suffixes) x (path prefixes of the lengths that rules have).
Expressions and rules meet in an equi-join on a short prefix of their digest, full digests confirm
the match, and the longest rule wins. Everything is a built-in expression; the expansion is bounded
by labels in the host times distinct path lengths of rules, not by the number of rules. Spark
broadcasts the rules only under its own size threshold and shuffles both sides beyond it; the rules
are repeated for SALTS parts of the URLs, so that a top-level domain's rule is no hot key there.

Defined results: a null URL, or one without '://', has an empty host and path and no rule. A URL of any
length is judged whole. Repeated rows come back as often as they came. Equal lengths: the smaller rule
string wins; of one rule with both actions, block. Rules with a null host are left out, a null path fits
all. Hosts of URLs and rules are lower-cased in A-Z only. Other columns of the input do not come back,
whatever their names. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract cuts them."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def compile_rules(rules: DataFrame, prefix: int = 8) -> DataFrame:
    """Rules (host, path, action) with digest, short prefix and weight. A repeated rule: block beats allow."""
    r = rules.filter(F.col("host").isNotNull()).select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    r = r.groupBy("host", "path").agg(F.max("action").alias("action"))
    full = _digest(F.concat("host", F.lit("\n"), "path"))
    return r.select(
        F.concat("host", "path").alias("rule"), "action", F.length("path").alias("path_length"), full.alias("digest"), F.substring(full, 1, prefix).alias("short")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", prefix: int = 8) -> DataFrame:
    """key, url, host, path, rule and verdict of every row of `pages`."""
    compiled = compile_rules(rules, prefix)
    # the distinct lengths of rule paths: one small row, bounded by the longest path a rule has
    lengths = compiled.agg(F.array_sort(F.collect_set("path_length")).alias("_lengths"))
    host, path = url_parts(F.col("_url"))
    urls = (
        pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).groupBy("_key", "_url").agg(F.count(F.lit(1)).alias("_n")).withColumns({"host": host, "path": path})
    )
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.transform(F.filter("_lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    # every URL of a domain has that domain among its expressions: rules are repeated for SALTS parts of the URLs
    part = F.pmod(F.xxhash64("_key", "_url"), F.lit(SALTS)).cast("int").alias("_part")
    compiled = compiled.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    expressions = (
        urls.filter(F.col("host") != "")
        .crossJoin(F.broadcast(lengths))  # one row
        .select("_key", "_url", F.explode(suffixes).alias("_suffix"), heads.alias("_heads"))
        .select("_key", "_url", "_suffix", F.explode("_heads").alias("_head"))
        .select("_key", "_url", part, _digest(F.concat("_suffix", F.lit("\n"), "_head")).alias("_full"))
        .withColumn("short", F.substring("_full", 1, prefix))
    )
    best = (
        expressions.join(compiled, ["short", "_part"])
        .filter(F.col("_full") == F.col("digest"))
        .groupBy("_key", "_url")
        .agg(F.min(F.struct((-F.length("rule")).alias("w"), "rule", "action")).alias("_best"))
    )
    same = F.col("u._key").eqNullSafe(F.col("b._key")) & F.col("u._url").eqNullSafe(F.col("b._url"))
    return (
        urls.alias("u")
        .join(best.alias("b"), same, "left")
        .select(
            F.col("u._key").alias(key), F.col("u._url").alias(url), "host", "path", F.col("_best.rule").alias("rule"),
            F.coalesce("_best.action", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"),
        )
        .drop("_copy")
    )
