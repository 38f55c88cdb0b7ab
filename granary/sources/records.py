"""JSON-lines sources and sinks with explicit schemas."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

LABELS = "domain string, chain_id int, anchor_index int, candidate_id string, seed int, lift_acc double, lift_nll double, kl_drift double"
ROLLOUTS = "key string, domain string, trajs array<struct<group_id: string, reward: double, advantage: double, comp_ids: array<int>, token_logp: array<double>>>"
_BAD = "_corrupt"


def read_records(spark: SparkSession, path, schema: str, missing_ok: bool = False) -> DataFrame:
    """One object for each non-blank line; a missing path is an empty table only if asked for."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_many(spark: SparkSession, globs: list[str], schema: str) -> DataFrame:
    """All files of several globs, with the file each row came from."""
    return spark.read.schema(schema).json(globs).withColumn("source_file", F.col("_metadata.file_name"))


def read_tolerant(spark: SparkSession, path, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that do not parse."""
    full = T.StructType.fromDDL(schema).add(_BAD, "string")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", full, {"columnNameOfCorruptRecord": _BAD}).alias("r"))
    return rows.filter(F.col(f"r.{_BAD}").isNull()).select("r.*").drop(_BAD), rows.filter(F.col(f"r.{_BAD}").isNotNull()).select(F.col("value").alias("line"))


def read_rollouts(spark: SparkSession, path, schema: str = ROLLOUTS) -> DataFrame:
    """One row for each trajectory; of records with one key the last by file name and place wins."""
    rows = spark.read.schema(schema).json(path)
    order = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    last = rows.select("key", "domain", "trajs", order.alias("o")).groupBy("domain", "key").agg(F.max_by("trajs", "o").alias("trajs"))
    return last.select("domain", "key", F.posexplode("trajs").alias("pos", "t")).select("domain", "key", "pos", "t.*")


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Columns in the order of their names."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def append_labels(df: DataFrame, path: str, keys: list[str], schema: str) -> int:
    """Appends the rows whose key the log lacks; returns how many."""
    from granary.operators.labels import pending

    fresh = pending(df, read_records(df.sparkSession, path, schema, missing_ok=True), keys).cache()
    n = fresh.count()
    write_records(fresh, path, "append")
    fresh.unpersist()
    return n


def concat_shards(*shards: DataFrame) -> DataFrame:
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def select_files(spark: SparkSession, folder: str, include: str, exclude: str, schema: str, within: str | None = None) -> DataFrame:
    """Files whose name fits the glob `include` and whose path, from the folder on, fits `within` and does not hold `exclude`."""
    rows = spark.read.schema(schema).option("pathGlobFilter", include).option("recursiveFileLookup", "true").json(folder)
    path = F.substring_index(F.col("_metadata.file_path"), folder.rstrip("/").rpartition("/")[2], -1)
    if within:
        rows = rows.filter(path.rlike(fnmatch.translate(within)))
    return rows.filter(~F.contains(path, F.lit(exclude)))


def export_nested(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """A JSON document for each key: its rows in order, with non-finite numbers as null."""
    clean = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c)
    rows = df.select(key, order, *(clean(c) for c in columns))
    nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))
    return nested.select(key, F.to_json("rows", {"ignoreNullFields": "false"}).alias("document"))
