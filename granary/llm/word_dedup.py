"""Substring dedup on words, with difference-cover anchors.

Of every 13 positions of a document those at 0, 1, 3 and 9 are anchors: any two positions can be
shifted by the same amount below 13 so that both become anchors. Two equal windows of 20 words so
share anchors at one offset, whose 8 words lie inside both. Each anchor's hash is compared across the
corpus and then extended to the run of windows around it (see _repeats). The first occurrence of a
window stays: smaller doc_id, or earlier start.

Defined results: a null or blank text has no words. Rows of one doc_id: windows at the same start
are equally early, so neither removes the other. Rows with a null doc_id stay whole. Ids are whole numbers, as
their order says which text is earlier. A text of any length is cut whole, in runs of windows that no task has to
hold at once. Extra columns are kept, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._bytes import Spans, flat, word_keys
from ._repeats import Windows, remove_repeats

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, two independent 64-bit keys of every word, and the offsets of the texts in the words."""
    body, ends = flat(texts)
    n = len(body)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_BLANK[body]
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return body, word_keys(body, begin, end - begin), word_keys(body, begin, end - begin, 1), np.searchsorted(begin, ends)


def cover_anchors(body, keys, ends):
    """Anchors at the cover's positions, the runs of windows that hold them, and their words' hash."""
    size = np.diff(ends)
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    room = np.repeat(size, size)
    is_cover = np.zeros(PERIOD, bool)
    is_cover[list(COVER)] = True
    pick = np.flatnonzero(is_cover[at % PERIOD] & (at <= room - ANCHOR) & (room >= WINDOW))
    local, base = at[pick], pick - at[pick]
    s = base + np.maximum(local - (PERIOD - 1), 0)
    e = base + np.minimum(local, room[pick] - WINDOW)
    return pick, s, e, Spans(keys)(pick, pick + ANCHOR)


WORD_WINDOWS = Windows(WINDOW, words, cover_anchors, True)


def _kept(text, mask) -> tuple[int, int, bytes]:
    own = (text or "").encode().split()
    if mask is None:
        return len(own), 0, b" ".join(own)
    keep = np.ones(len(own), bool)
    keep[: len(mask)] = ~mask
    return len(own), int(len(own) - keep.sum()), b" ".join(compress(own, keep.tolist()))


def word_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", windows: Windows = WORD_WINDOWS) -> DataFrame:
    """key, n_words, n_removed and kept_sha256 of every row."""
    schema = T.StructType([docs.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def finish(table: pa.Table, removed: list) -> pa.Table:
        out = [(a, b, hashlib.sha256(c).hexdigest()) for a, b, c in map(_kept, table.column(text).to_pylist(), removed)]
        columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.table([table.column(key), *columns], names=[key, "n_words", "n_removed", "kept_sha256"])

    return remove_repeats(docs.select(key, text), windows, finish, schema, key, text)


def drop_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the kept words, joined by one space, as the text. Texts that lose nothing stay as they are."""

    def finish(table: pa.Table, removed: list) -> pa.Table:
        texts = [t if mask is None else _kept(t, mask)[2].decode() for t, mask in zip(table.column(text).to_pylist(), removed)]
        i = table.schema.get_field_index(text)
        return table.set_column(i, text, pa.array(texts, pa.string()))

    return remove_repeats(docs, WORD_WINDOWS, finish, docs.schema, key, text)
