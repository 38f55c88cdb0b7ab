"""Token counts: the exact histogram of encoded lengths, with suffix sums for every context limit.

Documents are encoded once and aggregated by length before the shuffle, so what moves is one row per
distinct length and task. The histogram answers every limit L that equals a length: documents and
tokens of length L or more, tokens left when every document is cut at L, and the share of documents
of length L or less (from which any quantile is read). Suffix sums run in blocks of lengths, whose
totals are carried over in a second, far smaller sum: no window spans the whole histogram.

Defined results: a null or empty text has length 0; a text of any length is encoded whole. Repeated rows count
each. Columns other than the text take no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ._shared import stored
from .bpe import token_counts

BLOCK = 256


def length_histogram(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    lengths = token_counts(docs.select(text), path, text, "length")
    by_length = stored(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")), "token-lengths").withColumn("_block", F.floor(F.col("length") / BLOCK))
    tokens = F.col("n_docs") * F.col("length")
    inside = W.partitionBy("_block").orderBy(F.desc("length"))
    rows = by_length.withColumns({"_docs": F.sum("n_docs").over(inside), "_tokens": F.sum(tokens).over(inside)})
    # blocks are as many as the longest document has tokens / BLOCK
    blocks = by_length.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    above = W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(
        "_block",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_tokens_above"),
        F.sum("_d").over(W.partitionBy()).alias("_all_docs"),
        F.sum("_t").over(W.partitionBy()).alias("_all_tokens"),
    )
    docs_from, tokens_from = F.col("_docs") + F.col("_docs_above"), F.col("_tokens") + F.col("_tokens_above")
    return rows.join(carried, "_block").select(
        "length",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("_all_tokens") - tokens_from + docs_from * F.col("length")).alias("tokens_cut_here"),
        (docs_from - F.col("n_docs")).alias("docs_cut_here"),
        F.round((F.col("_all_docs") - docs_from + F.col("n_docs")) / F.col("_all_docs"), 9).alias("share_up_to"),
        F.col("_all_docs").alias("all_docs"),
        F.col("_all_tokens").alias("all_tokens"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any context limits, from the histogram alone."""
    some = histogram.sparkSession.createDataFrame([(x,) for x in limits], "context long")
    return (
        histogram.crossJoin(F.broadcast(some))  # the limits are a parameter
        .groupBy("context")
        .agg(
            F.sum(F.col("n_docs") * F.least("length", "context")).alias("tokens_cut"),
            F.coalesce(F.sum(F.when(F.col("length") > F.col("context"), F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
        )
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that at least `share` of the documents do not exceed."""
    return histogram.filter((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) >= F.lit(share) * F.col("all_docs")).agg(F.min("length").alias("length"))
