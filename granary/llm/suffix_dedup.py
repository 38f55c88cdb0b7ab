"""Suffix-array dedup on bytes: groups of equal suffixes through the threshold's depth.

`sorted_suffixes` is the dealt method in full: every suffix is a row, ordered most significant digit
first by passes over eight of its bytes, groups of one leave after each pass, and the groups left at
full depth are the repeated 200-byte strings. Its first pass shuffles every suffix, which is many times
the input (figures in the README), so `byte_digests` sorts fewer: suffixes whose 200 bytes share the
least 32-byte gram at one spot travel as one run. The first digit is that gram, the second the run's
whole content, then for runs that differ the 84 bytes beside the gram, and last each suffix's 200 bytes;
digits are compared by hash (see _repeats). Both find the same strings; a test compares them. All
occurrences of a repeated string are removed, as it also starts elsewhere.

Defined results: a null or empty text has no bytes. A text of any length is read whole. Repeated rows
are different documents and remove each other. Rows with a null doc_id stay whole. Other columns of the
input take no part, whatever their names. An empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._bytes import BYTE_KEYS, flat, gram_keys, ranges, runs
from ._repeats import Windows, remove_repeats
from ._shared import stored

DEPTH, GRAM = 200, 32


def byte_tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    body, ends = flat(texts)
    keys = BYTE_KEYS[body]
    return body, keys, keys, ends


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    many = len(v) - width + 1
    blocks = np.concatenate([v, np.full(-len(v) % width, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:many], ahead[width - 1 : width - 1 + many])


def least_gram_anchors(body, keys, ends):
    """For every 200-byte string the leftmost of its least grams; runs of strings that share it."""
    n = len(keys)
    empty = np.zeros(0, np.int64)
    begin, size = ends[:-1], np.diff(ends)
    fits = size >= DEPTH
    if not fits.any():
        return empty, empty, empty, np.zeros(0, np.uint64)
    at = np.arange(n - GRAM + 1)
    h = gram_keys(body, GRAM)
    place = np.uint64(n.bit_length())
    least = _sliding_least(h >> place << place | at.astype(np.uint64), DEPTH - GRAM + 1)
    p = ranges(begin[fits], size[fits] - DEPTH + 1)
    spot = (least[p] & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    edge = np.flatnonzero(np.diff(spot, prepend=-1))
    s, e = p[edge], p[np.append(edge[1:], len(p)) - 1]
    spot = spot[edge]
    return spot, s, e, h[spot]


BYTE_WINDOWS = Windows(DEPTH, byte_tokens, least_gram_anchors, False, GRAM)


def sorted_suffixes(docs: DataFrame, depth: int = DEPTH, digit: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, key, at (from 0) and group of every suffix whose first `depth` bytes (a multiple of `digit`) start elsewhere too.

    A group is named by its least suffix. Suffixes of rows with a null key take no part.
    """
    raw = F.col(text).cast("binary")
    rows = stored(docs.filter(F.col(key).isNotNull() & (F.octet_length(raw) >= depth)).select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), raw.alias("raw")), "suffix-rows")
    places = F.explode(F.sequence(F.lit(0), F.octet_length("raw") - depth)).alias("at")
    none = F.lit(None).cast("struct<row: bigint, at: int>").alias("group")
    alive = rows.select("row", "raw", places).select("row", "at", none, F.substring("raw", F.col("at") + 1, F.lit(digit)).alias("digit"))
    for done in range(digit, depth + digit, digit):
        more = alive.groupBy("group", "digit").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at")).alias("least")).filter("n > 1")
        same = alive["group"].eqNullSafe(more["group"]) & (alive["digit"] == more["digit"])
        left = stored(alive.join(more, same).select("row", "at", F.col("least").alias("group")), "suffix-pass")
        if done < depth:
            alive = left.join(rows, "row").select("row", "at", "group", F.substring("raw", F.col("at") + done + 1, F.lit(digit)).alias("digit"))
    return left.join(rows.select("row", "key"), "row").select("row", F.col("key").alias(key), "at", "group")


def byte_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", windows: Windows = BYTE_WINDOWS) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def finish(table: pa.Table, removed: list) -> pa.Table:
        out = []
        for t, mask in zip(table.column(text).to_pylist(), removed):
            raw = (t or "").encode()
            if mask is None:
                out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
            else:
                keep = np.ones(len(raw), bool)
                keep[: len(mask)] = ~mask
                left = np.frombuffer(raw, np.uint8)[keep]
                out.append((len(raw), len(raw) - len(left), len(runs(mask)[0]), hashlib.sha256(left.tobytes()).hexdigest()))
        columns = [pa.array([x[i] for x in out], pa.string() if i == 3 else pa.int64()) for i in range(4)]
        return pa.table([table.column(key), *columns], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return remove_repeats(docs.select(key, text), windows, finish, schema, key, text)
