"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source is a queue: the ids of its documents in one row, cut into chunks of QUANTUM tokens, 32 to a
window, so that the mixture holds in each window and not only over many. A
queue earns credit in proportion to its weight (its tokens unless weights are given) and the queue
with the largest deficit sends its next chunk. That order is the order of the chunks' due times,
(tokens before the chunk + phase * its tokens) / weight, where phases between 0 and 1 spread the queues'
first credit evenly. So a chunk's place among all queues is a sum over queues of the tokens they have
due before it: every task computes it alone, and deficits carry across windows and partitions without a
pass over the data. A queue's last, shorter chunk is due like any other, so the mixture holds through
the last window. The last sequence is cut at powers of two, which need no padding.

Due times are doubles; their order, ties going to the lower queue, is the same in every task, as each
count of chunks due before a time is settled by comparing due times.

Documents are encoded once; the ids are written to the shared folder with each document's place in
the row of its queue inside its task. What joins them to the row's start in the queue is one row for
each task and queue. No ids are shuffled.

That holds for up to MAX_SOURCES queues, whose totals every task gets. Beyond it no total leaves the
executors: Spark makes one row for each chunk, sorts those rows by due time in ranges and adds up the
sizes before each, and every document is joined with the places of its chunks. The order, and so the
result, is the same; the ids are then shuffled once.

Defined results: a null or empty text has the end id alone; a text of any length is packed whole, in as
many pieces as it takes; a null source is a queue of its own; repeated rows are packed each; a null
doc_id is packed like any other. doc_id comes back as a long. Each source is a queue of its own, however
many there are. Other columns of the input take no part, whatever their names. An empty table gives no
rows. Weights must be whole numbers of at least 1 and name sources that the documents have; the sources
they name share what credit their tokens earn together, all others earn by their tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ._bytes import flat, pieces, ranges
from ._shared import stored
from .bpe import Tokenizer

#: Tokens of a sequence, and of a chunk: a window has room for a chunk of each of SEQUENCE // QUANTUM queues, so
#: a queue with a share of QUANTUM / SEQUENCE or more is in every window.
SEQUENCE, QUANTUM = 2048, 64
#: Rows of starts, one for each task and queue, up to which they are broadcast instead of shuffling the ids.
MAX_BROADCAST = 200_000
#: Queues up to which each task gets all totals and computes places alone: some 50 bytes each.
MAX_SOURCES = 4096
#: Chunks that one row of a queue's makes at once, and rows that one task sorts.
BLOCK, RANGE = 1 << 16, 1 << 18
GOLDEN = 0.6180339887498949

PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [T.StructField("queue", T.StringType())]
)


def _encoded(docs: DataFrame, model: Tokenizer, end_id: int) -> DataFrame:
    """doc_id, queue, ids, and each row's place among its task's rows of that queue."""
    schema = "doc_id long, queue string, task long, place long, n_tokens long, ids binary"

    def work(batches):
        bpe, task, so_far = model.bpe(), TaskContext.get().partitionId(), {}
        for part in pieces(batches, "text"):
            ids, ends = bpe.encode(part.column(1))
            raw, w = ids.tobytes(), ids.dtype.itemsize
            tail = np.array([end_id], ids.dtype).tobytes()
            cut = (ends * w).tolist()
            many = np.diff(ends) + 1
            queues, places = part.column(2).to_pylist(), []
            for q, n in zip(queues, many.tolist()):
                places.append(so_far.get(q, 0))
                so_far[q] = places[-1] + n
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.full(len(many), task)), pa.array(places, pa.int64()), pa.array(many), pa.array([raw[x:y] + tail for x, y in zip(cut, cut[1:])], pa.binary())],
                names=["doc_id", "queue", "task", "place", "n_tokens", "ids"],
            )

    return docs.mapInArrow(work, schema)


def spread(start: np.ndarray, length: np.ndarray):
    """The chunks of spans of queues' rows: each one's span, number, place in that chunk, place in that span and length."""
    first = start // QUANTUM
    many = (start + length - 1) // QUANTUM - first + 1
    row = np.repeat(np.arange(len(start)), many)
    k = ranges(first, many)
    begin, end = np.maximum(k * QUANTUM, start[row]), np.minimum((k + 1) * QUANTUM, (start + length)[row])
    return row, k, begin - k * QUANTUM, begin - start[row], end - begin


def cut(total: int, row: np.ndarray, at: np.ndarray, size: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Columns (row, start in its document, length, sequence, offset) of parts of documents at places of the packed order."""
    last = place + size > total // SEQUENCE * SEQUENCE  # what lies in the last sequence may be cut into many
    room = SEQUENCE - place % SEQUENCE
    two = np.flatnonzero((size > room) & ~last)  # a piece crosses one end of a sequence at most
    head = np.flatnonzero(~last)
    out = [
        np.concatenate([row[head], row[two]]), np.concatenate([at[head], (at + room)[two]]), np.concatenate([np.minimum(size, room)[head], (size - room)[two]]),
        np.concatenate([(place // SEQUENCE)[head], (place // SEQUENCE)[two] + 1]), np.concatenate([(place % SEQUENCE)[head], np.zeros(len(two), np.int64)]),
    ]
    extra: list[tuple] = []
    for r, b, n, p in zip(*(x[last].tolist() for x in (row, at, size, place))):
        while n:
            sequence, offset, left = spot(total, p)
            take = min(n, left)
            extra.append((r, b, take, sequence, offset))
            b, n, p = b + take, n - take, p + take
    return [np.concatenate([x, np.array([e[i] for e in extra], np.int64)]) for i, x in enumerate(out)]


def spot(total: int, p: int) -> tuple[int, int, int]:
    """Sequence, offset and what is left of the sequence at place p of the packed order."""
    s, last = p // SEQUENCE, total // SEQUENCE
    if s < last:
        return s, p % SEQUENCE, SEQUENCE - p % SEQUENCE
    rest, offset, n = total % SEQUENCE, p % SEQUENCE, 0
    while rest:  # the remainder's binary digits, largest first
        size = 1 << (rest.bit_length() - 1)
        if offset < size:
            return last + n, offset, size - offset
        offset, rest, n = offset - size, rest - size, n + 1
    raise ValueError("a place beyond the last token")


class Plan:
    """Totals of all queues: from them any token's place in the packed order follows."""

    def __init__(self, totals: list[tuple[str, int]], weights: dict[str, int] | None = None):
        self.index = {q: i for i, (q, _) in enumerate(totals)}
        self.tokens = np.array([n for _, n in totals], np.int64)
        self.chunks = -(-self.tokens // QUANTUM)
        weights = weights or {}
        if not weights.keys() <= self.index.keys():
            raise unknown(weights.keys() - self.index.keys())
        self.weights = self.tokens.astype(np.float64)
        named = [self.index[q] for q in weights]
        if named:
            own = np.array(list(weights.values()), np.float64)
            self.weights[named] = own / own.sum() * float(self.tokens[named].sum())
        self.total = int(self.tokens.sum())
        # queues of one chunk in the order of their due times; the others are compared one by one
        self.long, one = np.flatnonzero(self.chunks > 1), np.flatnonzero(self.chunks == 1)
        self.phase = (np.arange(1, len(totals) + 1) * GOLDEN) % 1.0
        due = self.due(np.zeros(len(one), np.int64), one)
        order = np.lexsort((one, due))
        self.due_once, one = due[order], one[order]
        self.tokens_once = np.append(0, np.cumsum(self.tokens[one]))
        self.key_once = np.searchsorted(self.due_once, self.due_once, "left") * len(totals) + one

    def due(self, k: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Due times of chunks k of queues q."""
        size = np.where(k == self.chunks[q] - 1, self.tokens[q] - k * QUANTUM, QUANTUM)
        return (k * float(QUANTUM) + self.phase[q] * size) / self.weights[q]

    def place(self, k: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Tokens of all queues that come before chunk k of queue q."""
        due = self.due(k, q)
        low, high = np.searchsorted(self.due_once, due, "left"), np.searchsorted(self.due_once, due, "right")
        before = self.tokens_once[np.where(high > low, np.searchsorted(self.key_once, low * len(self.index) + q), low)]
        w, chunks, tokens = self.weights[self.long], self.chunks[self.long], self.tokens[self.long]
        if len(self.long):
            lower, mine, queues = self.long[None, :] < q[:, None], due[:, None], self.long[None, :]

            def is_before(j):
                t = self.due(j, queues)
                return ((t < mine) | (t == mine) & lower) & (j < chunks[None, :])

            # estimated from full chunks, then settled by the due times themselves
            many = np.clip(np.ceil(mine * w[None, :] / QUANTUM - self.phase[queues]), 0, chunks[None, :]).astype(np.int64)
            many -= (many > 0) & ~is_before(many - 1)
            for _ in range(2):
                many += is_before(many)
            at = np.searchsorted(self.long, q)
            own = np.flatnonzero((at < len(self.long)) & (self.long[np.minimum(at, len(self.long) - 1)] == q))
            many[own, at[own]] = k[own]
            before = before + np.minimum(many * QUANTUM, tokens[None, :]).sum(axis=1)
        return before

    def pieces(self, q: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """The columns of `cut` for spans of queues' rows."""
        row, k, place, at, size = spread(start, length)
        own = q[row]
        for some in np.array_split(np.arange(len(k)), max(1, len(k) * len(self.long) >> 20)):
            place[some] += self.place(k[some], own[some])
        return cut(self.total, row, at, size, place)


def checked(weights: dict[str, int] | None) -> dict[str, int]:
    """Weights by queue."""
    weights = weights or {}
    if any(w != int(w) or w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers of at least 1")
    return {f"={k}": int(v) for k, v in weights.items()}


def unknown(queues) -> ValueError:
    return ValueError(f"weights of sources that no document has: {sorted(q[1:] for q in queues)}")


def _running(rows: DataFrame, order: list[str], size: str, into: str, parts: int) -> DataFrame:
    """`into`: the sum of `size` over all rows before, in an order that tells all rows apart.

    The order is cut into ranges, written once so that a task that runs again finds the same ranges.
    """
    dealt = stored(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "packing-order")
    parts_before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    sums = dealt.groupBy("_part").agg(F.sum(size).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(parts_before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum(size).over(inside), F.lit(0))
    return dealt.withColumn("_own", own).join(before, "_part").withColumn(into, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def chunk_places(totals: DataFrame, weights: dict[str, int], block: int = BLOCK, span: int = RANGE) -> DataFrame:
    """queue, k and first: the tokens of all queues before each queue's chunk k. totals: queue, tokens."""
    n, chunks = totals.agg(F.count(F.lit(1)), F.sum(F.expr(f"(tokens + {QUANTUM - 1}) div {QUANTUM}"))).first()
    queues = _running(totals.withColumn("one", F.lit(1)), ["queue"], "one", "index", -(-n // span)).drop("one")
    weight = F.col("tokens").cast("double")
    if weights:
        own = totals.sparkSession.createDataFrame(list(weights.items()), "queue string, own long")
        named = queues.join(F.broadcast(own), "queue").select("queue", "tokens").collect()  # no more than the weights given
        if len(named) < len(weights):
            raise unknown(weights.keys() - {r.queue for r in named})
        credit = float(sum(r.tokens for r in named))
        queues = queues.join(F.broadcast(own), "queue", "left")
        weight = F.when(F.col("own").isNull(), weight).otherwise(F.col("own") / F.lit(float(sum(weights.values()))) * F.lit(credit))
    queues = queues.select("queue", "index", "tokens", weight.alias("weight"), ((F.col("index") + 1).cast("double") * F.lit(GOLDEN) % F.lit(1.0)).alias("phase"), F.expr(f"(tokens + {QUANTUM - 1}) div {QUANTUM}").alias("chunks"))
    # a large queue makes its chunks in many tasks
    blocks = queues.withColumn("b", F.explode(F.expr(f"sequence(0L, (chunks - 1) div {block})"))).repartition("index", "b")
    rows = blocks.withColumn("k", F.explode(F.expr(f"sequence(b * {block}, least((b + 1) * {block}, chunks) - 1)")))
    rows = rows.withColumn("size", F.least(F.lit(QUANTUM), F.col("tokens") - F.col("k") * QUANTUM))
    due = (F.col("k").cast("double") * F.lit(float(QUANTUM)) + F.col("phase") * F.col("size").cast("double")) / F.col("weight")
    rows = rows.select("queue", "index", "k", "size", due.alias("due"))
    return _running(rows, ["due", "index", "k"], "size", "first", -(-chunks // span)).select("queue", "k", "first")


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, weights: dict[str, int] | None = None, most_sources: int = MAX_SOURCES) -> DataFrame:
    """Pieces of every document (doc_id, text, source), as in PIECES. weights: relative credit of the sources they name."""
    spark = docs.sparkSession
    model, credit = Tokenizer(spark, path), checked(weights)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    queue = F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", queue.alias("queue"))
    encoded = stored(_encoded(rows, model, end_id), "packing")
    parts = encoded.groupBy("queue", "task").agg(F.sum("n_tokens").alias("_n"))
    before = W.partitionBy("queue").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    begins = parts.select("queue", "task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    queues = encoded.groupBy("queue").agg(F.sum("n_tokens").alias("tokens"))
    first = sorted((r[0], r[1]) for r in queues.limit(most_sources + 1).collect())
    few = len(first) <= most_sources
    if parts.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        begins = F.broadcast(begins)  # some 50 bytes for each task and queue
    width, columns, at = 2 if model.size <= 1 << 16 else 4, ["doc_id", "queue", "at", "n_tokens", "ids"], F.col("place") + F.col("_begin")
    if few:
        plan = Plan(first, credit)
        placed = encoded.join(begins, ["queue", "task"]).withColumn("at", at).select(*columns)
    else:
        queues = stored(queues, "packing-queues")
        plan, total = None, queues.agg(F.sum("tokens")).first()[0]
        spans = encoded.select("queue", "task", "place", "n_tokens").join(begins, ["queue", "task"]).withColumn("at", at)
        spans = spans.withColumn("k", F.explode(F.expr(f"sequence(at div {QUANTUM}, (at + n_tokens - 1) div {QUANTUM})")))
        spans = spans.join(chunk_places(queues, credit), ["queue", "k"])  # a chunk has QUANTUM documents at most
        spans = spans.groupBy("queue", "task", "place").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("k", "first"))).alias("f"))
        placed = encoded.join(spans, ["queue", "task", "place"]).select(*columns, F.col("f.first").alias("firsts"))

    def work(batches):
        for part in pieces(batches, "ids"):
            doc, queue, at, n, ids = part.columns[:5]
            n, at = n.to_numpy(), at.to_numpy()
            if few:
                row, begin, length, sequence, offset = plan.pieces(np.array([plan.index[x] for x in queue.to_pylist()], np.int64), at, n)
            else:
                row, _, inside, begin, size = spread(at, n)
                row, begin, length, sequence, offset = cut(total, row, begin, size, inside + part.column(5).flatten().to_numpy())
            body, ends = flat(ids)
            wide = memoryview(body.view(f"<u{width}").astype("<u4")).cast("B")
            left = (4 * (ends[row] // width + begin)).tolist()
            crc = [zlib.crc32(wide[x : x + 4 * y]) for x, y in zip(left, length.tolist())]
            out = (doc.take(pa.array(row)), pa.array(begin), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(offset), queue.take(pa.array(row)))
            yield pa.RecordBatch.from_arrays(list(out), names=PIECES.names)

    return placed.mapInArrow(work, PIECES)
