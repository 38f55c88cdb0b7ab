"""Importance resampling towards a target distribution, by bit-sliced sums over hashed features.

A text's features are the runs of one to three consecutive words; each falls into one of 10,000
buckets by the CRC-32 of its bytes. Words are hashed once, and a run's checksum follows from its
words' alone, as appending bytes shifts a checksum linearly. Tasks add up whole-corpus counts of the
buckets, and the target's, and Spark merges them into 10,000 gains.

A document's counts are then cut into bit planes of 10,000 bits: plane j holds bit j of every count.
The gains, in two's complement, are planes as well. The weight is the sum over pairs of planes
of 2**(j + k) times the set bits of their AND, the sign plane counting negatively: exact integers.
The draw adds to each weight a perturbation fixed by the document's id and keeps the highest scores,
numbered in ranges of the score, so that no task sorts all rows.

Defined results: a null, empty or wordless text has no features and weight 0, and is not drawn, as
it has fewer words than a drawn one needs. Very long texts are read whole, in blocks of words. A null
doc_id is perturbed as the empty text and comes last among ties. Repeated rows are counted, scored and
ranked each. An empty table gives an empty one; an empty target leaves the gains defined. Other
columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ._bytes import flat, pieces
from ._shared import stored

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
PLANE = -(-BUCKETS // 64)  # 64-bit words of a plane
#: Documents whose planes are held together, words whose runs are hashed together, longest word hashed with others.
TOGETHER, WORDS, SHORT = 256, 1 << 19, 64

_WORD = np.ones(256, bool)
_WORD[:128] = False
_WORD[48:58] = _WORD[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 table, and what 0 to 63 further bytes make of each byte of a checksum."""
    one = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32)
    step = one ^ one[0]  # the part of a byte's checksum that is linear in the byte
    near = np.empty((SHORT, 4, 256), np.uint32)
    for k in range(4):
        near[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, SHORT):
        near[n] = step[near[n - 1] & 255] ^ (near[n - 1] >> np.uint32(8))
    return step, near


@lru_cache(64)
def _far(i: int) -> np.ndarray:
    """What 64 * 2**i further bytes make of each byte of a checksum."""
    if i:
        return _apply(_far(i - 1), _far(i - 1))
    step, near = _tables()
    return step[near[-1] & 255] ^ (near[-1] >> np.uint32(8))


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & 255]
    for k in range(1, 4):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & 255]
    return out


def shifted(crc: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The part of a checksum in that of its text and `more` further bytes."""
    near = _tables()[1].reshape(-1)
    base = (more & (SHORT - 1)) << 10
    out = near[base + (crc & 255)]
    for k in range(1, 4):
        out ^= near[base + (256 * k) + ((crc >> np.uint32(8 * k)) & 255)]
    rest, i = more >> 6, 0
    while rest.any():
        some = np.flatnonzero(rest & 1)
        out[some] = _apply(_far(i), out[some])
        rest, i = rest >> 1, i + 1
    return out


def checksums(body: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of every word."""
    step = _tables()[0]
    out = np.empty(len(begin), np.uint32)
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    long = int(np.searchsorted(-size[order].clip(max=SHORT + 1), -SHORT))
    for i in order[:long]:
        out[i] = zlib.crc32(body[begin[i] : begin[i] + size[i]])
    rest = order[long:]
    at, reg = begin[rest], np.full(len(rest), 0xFFFFFFFF, np.uint32)
    open_ = np.bincount(size[rest], minlength=SHORT + 1)[::-1].cumsum()[::-1] if len(rest) else np.zeros(SHORT + 1, int)
    for j in range(SHORT):
        n = int(open_[j + 1])  # words of more than j bytes lie first
        if not n:
            break
        reg[:n] = step[(reg[:n] ^ body[at[:n] + j]) & 255] ^ (reg[:n] >> np.uint32(8))
    out[rest] = ~reg
    return out


def words_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, begins and sizes of words, and the offsets of the texts in the words."""
    body, ends = flat(texts)
    body = _LOWER[body]
    inside = np.zeros(len(body) + 2, bool)
    inside[1:-1] = _WORD[body]
    cut = np.zeros(len(body) + 1, bool)
    cut[ends] = True
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    stop = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return body, begin, stop - begin, np.searchsorted(begin, ends)


def feature_buckets(body: np.ndarray, begin: np.ndarray, size: np.ndarray, ends: np.ndarray):
    """The text's number and the bucket of every run of one to RUN words, in blocks of words."""
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    space = np.uint32(zlib.crc32(b" "))
    for first in range(0, len(begin), WORDS):
        last = min(first + WORDS, len(begin))
        part = slice(first, min(last + RUN - 1, len(begin)))
        n, own = size[part], text[part]
        word = checksums(body, begin[part], n)
        spaced = shifted(np.full(len(n), space), n) ^ word  # of a space and the word
        run = word
        for more in range(RUN):
            if more:
                run = shifted(run[:-1], n[more:] + 1) ^ spaced[more:]
            here = min(last - first, len(run))
            whole = own[:here] == own[more : more + here]
            yield own[:here][whole], (run[:here][whole] % np.uint32(BUCKETS)).astype(np.int64)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """[bit, row, 64-bit words]: bit k of every value in a row, for k < bits."""
    out = np.zeros((bits, len(values), PLANE * 8), np.uint8)
    for k in range(bits):
        packed = np.packbits((values >> k) & 1 == 1, axis=1)
        out[k, :, : packed.shape[1]] = packed
    return out.view(np.uint64)


def gain_planes(gains: np.ndarray) -> np.ndarray:
    """Planes of gains in two's complement; the last is the sign."""
    bits = int(max(gains.max(), -gains.min() - 1, 0)).bit_length() + 1
    return planes(gains[None, :], bits)[:, 0]


def weights(counts: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Sums of counts times gains: counts as a row for each document, gains as planes."""
    out = np.zeros(len(counts), np.int64)
    for j, plane in enumerate(planes(counts, int(counts.max(initial=0)).bit_length())):
        for k, gain in enumerate(gains):
            ones = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
            out += (-ones if k == len(gains) - 1 else ones) << (j + k)
    return out


def bucket_totals(texts: DataFrame, text: str = "text") -> DataFrame:
    """bucket and n: features of all texts in each bucket."""

    def work(batches):
        total = np.zeros(BUCKETS, np.int64)
        for part in pieces(batches, text):
            for _, buckets in feature_buckets(*words_of(part.column(0))):
                total += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(text).mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(totals: DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in totals.collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, both smoothed by one."""
    s, t = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    ratio = ((float(y) + 1) * s / ((float(x) + 1) * t) for x, y in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _noise(doc_id) -> int:
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features, weight and score of every row."""
    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    sliced = gain_planes(gains)  # BUCKETS bits for each bit of a gain

    def work(batches):
        for part in pieces(batches, text):
            for a in range(0, part.num_rows, TOGETHER):
                some = part.slice(a, TOGETHER)
                body, begin, size, ends = words_of(some.column(1))
                counts = np.zeros(some.num_rows * BUCKETS, np.int64)
                for row, buckets in feature_buckets(body, begin, size, ends):
                    counts += np.bincount(row * BUCKETS + buckets, minlength=len(counts))
                counts = counts.reshape(-1, BUCKETS)
                weight, noise = weights(counts, sliced), np.array([_noise(d) for d in some.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(x) for x in (np.diff(ends), counts.sum(axis=1), weight, weight + noise))], names=[f.name for f in schema])

    return docs.select(key, text).mapInArrow(work, schema)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """key, n_features, weight, score and rank of every row; the rank is null where the row is not drawn.

    Of the rows with `least_words` words or more, `percent` in a hundred are drawn, rounded down.
    """
    gains = bucket_gains(_dense(bucket_totals(docs, text)), _dense(bucket_totals(target, text)))
    scored = stored(scores(docs, gains, key, text), "resampling-scores")
    order = [F.desc("score"), F.asc_nulls_last(key), F.desc("n_features")]
    able = F.col("n_words") >= least_words
    # written with the range's number: counting and numbering see the same ranges
    ranges = stored(scored.filter(able).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "resampling-ranges")
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    rank = F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(*order))
    drawn = ranges.join(F.broadcast(before), "_range").withColumn("_rank", rank).withColumn("rank", F.when(F.col("_rank") <= F.floor(F.col("_all") * percent / 100), F.col("_rank")))
    columns = [key, "n_features", "weight", "score"]
    return drawn.select(*columns, F.col("rank").cast("long").alias("rank")).unionByName(scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
