"""Alignment of two tokenizers' tokens over the same bytes, with Arrow tables inside the tasks.

Each text is encoded by a byte-level BPE (A) and a piece model (B). Ids are Arrow lists: flattening
gives tokens, parent indices their documents, and running sums of byte widths less the sum at the
document's start give every token's end. An Acero full join on document and end finds where both end,
which cuts the tokens into groups. In the order of ends each row of that join is a link, since the bytes
between two consecutive ends belong to one token of A and one of B: missing ids are filled from the
row behind.

A document keeps its distinct linked id pairs with their counts as one binary value. Counts over the
corpus are made by Table.group_by in the tasks and merged by Spark. Pairs that hold more than 2**-18 of all
links, at most 2**18 of them, return to the tasks as a broadcast of that bound; the rows of all other
pairs are joined by Spark, where no pair is hot.

Defined results: a text that is null, empty, or whose tokens' bytes are not a space and the text (one that holds
U+2581, say) has no tokens, zeros everywhere and the empty string as digest. Very long texts are encoded whole, in
a slice of their own. Repeated rows and rows with a null doc_id count and come back each. An empty
table gives an empty one. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ._bytes import flat, pieces, ranges
from ._shared import stored
from .bpe import Bpe, default_path

#: Pairs above this share of all links are broadcast: at most as many as its inverse.
FREQUENT_PAIRS = 1 << 18
#: Bytes of text that are aligned together: their join fits a cache.
SLICE = 1 << 18
#: Distinct pairs that a task holds before it hands its counts on.
HELD = 1 << 20


def default_piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers, loaded in the task, and the bytes of their entries."""

    def __init__(self, a_text: str, b_model: bytes):
        import sentencepiece

        spec = json.loads(a_text)
        spec["added_tokens"] = []  # their strings in texts are plain text
        self.a = Bpe(json.dumps(spec))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        own = [self._piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.b_width = np.array([len(x) for x in own], np.int64)
        self.b_begin = np.cumsum(self.b_width) - self.b_width
        self.b_bytes = np.frombuffer(b"".join(own), np.uint8)
        self.b_size = len(own)
        self.names = pa.array([str(i) for i in range(max(self.a.size, self.b_size))])

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(re.fullmatch(r"<0x([0-9A-F]{2})>", piece)[1], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of a space and the text by A, and of the text by B; none where their bytes differ from a space and the text."""
        spaced = pa.array([" " + t if t else "" for t in texts])
        ids, ends = self.a.encode(spaced)
        b_lists = pa.array(self.b.encode(texts, num_threads=1) if texts else [], pa.list_(pa.int32()))
        b_ids, b_ends = pc.list_flatten(b_lists).to_numpy(), b_lists.offsets.to_numpy().astype(np.int64)
        body, at = flat(spaced)
        same = self._spells(body, at, ids.astype(np.int64), ends, self.a.width, self.a.begin, self.a.bytes)
        same &= self._spells(body, at, b_ids.astype(np.int64), b_ends, self.b_width, self.b_begin, self.b_bytes)
        return _lists(ids.astype(np.int32), ends, same), _lists(b_ids, b_ends, same)

    @staticmethod
    def _spells(body, at, ids, ends, width, begin, entries) -> np.ndarray:
        """Whether each document's tokens, joined, are its bytes."""
        upto = np.append(0, np.cumsum(width[ids]))[ends]
        same = np.diff(upto) == np.diff(at)
        rows = np.flatnonzero(same & (np.diff(at) > 0))
        n = np.diff(at)[rows]
        written = entries[ranges(begin[ids], width[ids])]
        if not same.all():  # documents of other lengths shift what lies behind them
            written, body = written[ranges(upto[rows], n)], body[ranges(at[rows], n)]
        wrong = np.flatnonzero(written != body)
        same[rows[np.searchsorted(np.cumsum(n), wrong, "right")]] = False
        return same


def _lists(ids: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> pa.ListArray:
    n = np.diff(ends)
    kept = ids[np.repeat(keep, n)]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n * keep)), pa.int32()), pa.array(kept, pa.int32()))


def _ends(lists: pa.ListArray, width: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Ids, documents and, as document * 2**32 + end, the end of every token's bytes in its document."""
    ids, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    running = pc.cumulative_sum(pc.take(pa.array(width), ids))
    first = lists.offsets.to_numpy()[:-1]  # a document's first token; the sum before it is its start
    before = np.append(0, running.to_numpy())[first]
    ends = pc.subtract(running, pc.take(pa.array(before), parents))
    return ids, parents, pc.add(pc.shift_left(parents, 32), ends)


def links(a_lists: pa.ListArray, b_lists: pa.ListArray, a_width: np.ndarray, b_width: np.ndarray) -> pa.Table:
    """doc, a, b, a_ends and b_ends of every link in order; both ends at once close a group."""
    tables = []
    for name, lists, width in (("a", a_lists, a_width), ("b", b_lists, b_width)):
        ids, _, key = _ends(lists, width)
        tables.append(pa.table({"key": key, name: ids}))
    found = tables[0].join(tables[1], "key", join_type="full outer", use_threads=False).combine_chunks()
    found = found.sort_by("key")
    a, b = found.column("a"), found.column("b")
    return pa.table({
        "doc": pc.shift_right(found.column("key"), 32), "a": pc.fill_null_backward(a), "b": pc.fill_null_backward(b), "a_ends": pc.is_valid(a), "b_ends": pc.is_valid(b),
    })


def _spelt(names: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The decimal ids between two cuts, joined by commas."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pc.take(names, pa.array(ids))), ",")


class Tokenizers:
    """Both tokenizer files, read once on the driver and sent to the executors as broadcasts of fixed size."""

    _loaded: dict[str, Pair] = {}

    def __init__(self, spark, a_path: str | None = None, b_path: str | None = None):
        with open(a_path or default_path(), encoding="utf-8") as f:
            a = f.read()
        with open(b_path or default_piece_path(), "rb") as f:
            b = f.read()
        self.key = hashlib.sha256(a.encode() + b).hexdigest()
        self.files = spark.sparkContext.broadcast((a, b))

    def pair(self) -> Pair:
        if self.key not in self._loaded:
            self._loaded.clear()
            self._loaded[self.key] = Pair(*self.files.value)
        return self._loaded[self.key]


def _aligned(pair: Pair, keys: pa.Array, texts: list[str], first: int) -> pa.RecordBatch:
    a_lists, b_lists = pair.encode(texts)
    found = links(a_lists, b_lists, pair.a.width, pair.b_width)
    docs = len(texts)
    doc, a_ends, b_ends = (found.column(c).to_numpy() for c in ("doc", "a_ends", "b_ends"))
    shut = a_ends & b_ends
    in_group = np.flatnonzero(shut) + 1  # links up to each group's end
    a_ids, b_ids = (pc.list_flatten(x).to_numpy() for x in (a_lists, b_lists))
    a_cuts, b_cuts = (np.append(0, np.append(0, np.cumsum(x))[in_group]) for x in (a_ends, b_ends))
    groups = pc.binary_join_element_wise(_spelt(pair.names, a_ids, a_cuts), _spelt(pair.names, b_ids, b_cuts), "|")
    per_doc = np.bincount(doc[shut], minlength=docs)
    written = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_doc)), pa.int32()), groups), ";")
    digests = [hashlib.sha256(x.as_buffer()).hexdigest() if n else "" for x, n in zip(written, per_doc)]
    code = doc.astype(np.uint64) << np.uint64(40) | (found.column("a").to_numpy().astype(np.uint64) * np.uint64(pair.b_size) + found.column("b").to_numpy().astype(np.uint64))
    code, many = np.unique(code, return_counts=True)
    of = (code >> np.uint64(40)).astype(np.int64)
    packed = np.empty(len(code), [("code", "<u8"), ("n", "<u4")])
    packed["code"], packed["n"] = code & np.uint64((1 << 40) - 1), many
    at = np.searchsorted(of, np.arange(docs + 1)).tolist()
    n_a, n_b = (np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (a_lists, b_lists))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(first, first + docs)), keys, pa.array(n_a), pa.array(n_b), pa.array(per_doc.astype(np.int64)), pa.array(np.bincount(doc, minlength=docs).astype(np.int64)), pa.array(digests, pa.string()),
            pa.array([packed[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary()),
        ],
        names=["_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_pairs"],
    )


def aligned(docs: DataFrame, tokenizers: Tokenizers, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of tokens, groups and links of every document, the digest of its groups, and its distinct pairs."""
    longs = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("doc_id", docs.schema[key].dataType), *longs, T.StructField("groups_sha256", T.StringType()), T.StructField("_pairs", T.BinaryType())])

    def work(batches):
        pair, row = tokenizers.pair(), TaskContext.get().partitionId() << 40
        for part in pieces(batches, text, SLICE):
            yield _aligned(pair, part.column(0), [x or "" for x in part.column(1).to_pylist()], row)
            row += part.num_rows

    return docs.select(key, text).mapInArrow(work, schema)


PAIR = np.dtype([("code", "<u8"), ("n", "<u4")])


def _pairs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a batch, and the row of each."""
    body, ends = flat(column)
    many = np.diff(ends) // PAIR.itemsize
    return np.frombuffer(body.tobytes(), PAIR), np.repeat(np.arange(len(many)), many)


def pair_counts(rows: DataFrame) -> DataFrame:
    """code and n: links of every id pair, over all documents."""

    def work(batches):
        held = []
        for batch in batches:
            pairs, _ = _pairs_of(batch.column(0))
            held.append(pa.table({"code": pairs["code"].astype(np.int64), "n": pairs["n"].astype(np.int64)}))
            if sum(t.num_rows for t in held) > HELD:
                held = [_summed(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from _summed(held).to_batches()

    return rows.select("_pairs").mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("code", use_threads=False).aggregate([("n", "sum")]).rename_columns(["code", "n"])


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    spark = docs.sparkSession
    tokenizers = Tokenizers(spark, a_path, b_path)
    b_size = Pair(*tokenizers.files.value).b_size
    rows = stored(aligned(docs, tokenizers, key, text), "alignment-rows")
    counts = stored(pair_counts(rows), "alignment-counts")
    by_b = F.col("code") % b_size
    most = counts.groupBy(by_b.alias("_b")).agg(F.max("n").alias("_most"))  # at most a row for each entry of B
    counts = counts.join(F.broadcast(most), by_b == F.col("_b")).select("code", "n", (F.col("n") == F.col("_most")).cast("long").alias("best"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * FREQUENT_PAIRS > total
    top = counts.filter(often).toPandas().sort_values("code")  # at most FREQUENT_PAIRS rows
    frequent = spark.sparkContext.broadcast(tuple(top[c].to_numpy(np.int64) for c in ("code", "n", "best")))

    def totals(batches):
        code, n, best = frequent.value
        for batch in batches:
            pairs, row = _pairs_of(batch.column(batch.schema.get_field_index("_pairs")))
            some = np.minimum(np.searchsorted(code, pairs["code"].astype(np.int64)), max(len(code) - 1, 0))
            hit = code[some] == pairs["code"].astype(np.int64) if len(code) else np.zeros(len(pairs), bool)
            links_, out = pairs["n"].astype(np.int64), np.zeros((2, batch.num_rows), np.int64)
            for i, value in enumerate((best, n)):
                np.add.at(out[i], row[hit], links_[hit] * value[some[hit]])
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in out)], names=[*batch.schema.names[:-1], "_best", "_sum"])

    def rare(batches):
        code = frequent.value[0]
        for batch in batches:
            pairs, row = _pairs_of(batch.column(1))
            own = pairs["code"].astype(np.int64)
            rest = ~np.isin(own, code)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row[rest]]), pa.array(own[rest]), pa.array(pairs["n"][rest].astype(np.int64))], names=["_row", "code", "m"])

    plain = T.StructType([f for f in rows.schema if f.name != "_pairs"] + [T.StructField(c, T.LongType()) for c in ("_best", "_sum")])
    seldom = rows.select("_row", "_pairs").mapInArrow(rare, "_row long, code long, m long").join(counts.filter(~often), "code")
    seldom = seldom.groupBy("_row").agg(F.sum(F.col("m") * F.col("best")).alias("_rare_best"), F.sum(F.col("m") * F.col("n")).alias("_rare_sum"))
    both = rows.select(*(c for c in rows.columns if c != "_pairs"), "_pairs").mapInArrow(totals, plain).join(seldom, "_row", "left")
    plus = lambda x, y: F.col(x) + F.coalesce(y, F.lit(0))
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("_best", "_rare_best").alias("n_best"), plus("_sum", "_rare_sum").alias("count_sum"), "groups_sha256")
