"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


#: At most so many keys can each have more than one row in FREQUENT of a table.
FREQUENT = 4096


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder, and that on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends there and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what `stored` wrote for a table that nothing reads any more."""
    path = getattr(df, "stored_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, from which jobs take their number of buckets."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def with_value(rows: DataFrame, counts: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """`rows` joined with `counts`, which has one row for each key and, in `count`, how many of `rows` have it.

    Keys of more than total / FREQUENT rows, of which there are at most FREQUENT, are broadcast, so
    that no task of the other keys' shuffle gets more rows of one key than that.
    """
    often = F.broadcast(counts.filter(F.col(count) > total / FREQUENT))
    hot = rows.join(often, key)
    rest = rows.join(often.select(key), key, "left_anti").join(counts.filter(F.col(count) <= total / FREQUENT), key, how)
    return hot.unionByName(rest)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    while name in df.columns:
        name += "_"
    return name
