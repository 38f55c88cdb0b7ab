"""Long exact repeats across a corpus: shared steps of the word and the byte deduplication.

A window is L consecutive tokens of one document. An operator picks anchors: spots chosen by rule so
that equal windows hold equal anchors at the same offset. Each anchor stands for a run of consecutive
windows around it. Three digits of growing depth then settle all windows:

1. the anchor's own few tokens: runs alone with theirs are done;
2. the whole run: runs of one content are equal window by window;
3. single windows, for the runs of an anchor that differ, which are few: the ends of repeats.

Where anchors are short beside the window, a digit comes between: two runs that share a window agree
on half of the window's rest either before or behind the anchor. Only those go on to the third, with
the windows on that side.

Every step is a shuffle of packed arrays. Records are bucketed by the leading bits of their digit and
sorted inside the bucket. A task sends one record for each digit, however often that occurs in it, so
a passage that many documents share stays as many records as there are tasks. What is settled goes
back to the documents, dealt into groups by row hash; the documents themselves are shuffled once.

An anchor that a task meets in more than HOT different runs is hot there: its runs go to buckets of
their own content and straight on to the third digit, and one of them tells the anchor's bucket that
others exist. So the bucket of a phrase that a third of all documents hold gets HOT records of a task
at most. Beyond FAN buckets, records are dealt twice, so that packed rows stay long at any size; in
between, what tasks sent for one digit is merged again.

Digits are hashes modulo 2**61 - 1 of independent 64-bit keys or bases; what decides is a pair of them
(32 and 61 bits for whole runs, 61 and 61 for single windows).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ._bytes import Spans, mix, pieces, ranges
from ._shared import free_name, stored, text_bytes

BUCKET_BYTES, GROUP_BYTES, FLUSH_BYTES = 8 << 20, 8 << 20, 8 << 20
#: Buckets of one deal; bytes of records merged between two deals; runs of an anchor from which it is hot in a task.
FAN, MERGE_BYTES, HOT = 4096, 64 << 20, 64
#: Groups of one task, and most tasks.
GROUPS_A_TASK, MAX_TASKS = 2, 1 << 16
SETTLED, OPEN = 1, 2
#: Flags of a record: it stands for several; its anchor is hot; it tells of a hot anchor and was also sent as hot.
SEVERAL, IS_HOT, HERALD = np.uint8(1), np.uint8(2), np.uint8(4)
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)

_BLOBS = ("docs", "rows", "d", "s", "n", "h1", "h2", "m", "sides")
_SIDES = np.dtype([("left", "<u2"), ("right", "<u2"), ("at", "<u2")])
_RECORDS = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), ("many", pa.int64()), *((b, pa.binary()) for b in _BLOBS)])
_RECORDS_SQL = "bucket int, g int, kind int, many long, " + ", ".join(f"{b} binary" for b in _BLOBS)


@dataclass(frozen=True)
class Windows:
    """length: tokens of a window. tokens(texts) gives the bytes, two keys of every token and the offsets
    of the texts in them. anchors(body, keys, ends) gives positions, run starts, run ends (inclusive) and hashes.
    keep_first: a window is removed if an equal one starts earlier; else if an equal one is anywhere.
    anchor: tokens of an anchor, where runs are also told apart by the halves beside it; else 0.
    The rest are limits that change no result."""

    length: int
    tokens: Callable
    anchors: Callable
    keep_first: bool
    anchor: int = 0
    fan: int = FAN
    hot: int = HOT
    bucket_bytes: int = BUCKET_BYTES
    flush_bytes: int = FLUSH_BYTES
    merge_bytes: int = MERGE_BYTES

    @property
    def half(self) -> int:
        return (self.length - self.anchor) // 2


def _small(x: np.ndarray) -> bytes:
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 256 else "<u2" if top < 65536 else "<u4").tobytes()


def _read(blob: bytes, many: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // many}").astype(np.int64) if many else np.zeros(0, np.int64)


class _Rows:
    """Packed rows of one kind, gathered for a record batch."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in _RECORDS]

    def add(self, bucket: int, g: int, kind: int, doc: np.ndarray, row: np.ndarray, d: np.ndarray, s: np.ndarray, n: np.ndarray, h1=None, h2=None, m=None, sides=None) -> None:
        used, local = np.unique(d, return_inverse=True)
        values = (
            bucket, g, kind, len(d), doc[used].astype("<i8").tobytes(), row[used].astype("<i8").tobytes(), _small(local), _small(s), _small(n),
            None if h1 is None else h1.tobytes(), None if h2 is None else h2.astype("<u8").tobytes(), None if m is None else m.astype("<u1").tobytes(),
            None if sides is None else sides.tobytes(),
        )
        for c, v in zip(self.columns, values):
            c.append(v)

    def add_by(self, key: np.ndarray, of: str, kind: int, doc, row, d, s, n, buckets: int = 0, **more) -> None:
        """One packed row for each value of `key`."""
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order], prepend=-1)) if len(key) else []
        for i in np.split(order, cuts[1:]) if len(key) else ():
            k = int(key[i[0]])
            self.add(k if of == "bucket" else k % buckets if buckets else -1, k if of == "g" else -1, kind, doc, row, d[i], s[i], n[i], **{c: v[i] for c, v in more.items()})

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, _RECORDS)], schema=_RECORDS)


def _open_rows(table: pa.Table, kind: int | None = None):
    """The packed records of a table as flat arrays: doc, row, s, n, h1, h2, m, sides."""
    out: list[list] = [[] for _ in range(8)]
    for k, many, docs, rows, d, s, n, h1, h2, m, sides in zip(*(table.column(c).to_pylist() for c in ("kind", "many", *_BLOBS))):
        if kind is not None and k != kind or not many:
            continue
        d = _read(d, many)
        values = (
            np.frombuffer(docs, "<i8")[d], np.frombuffer(rows, "<i8")[d], _read(s, many), _read(n, many),
            None if h1 is None else np.frombuffer(h1, f"<u{len(h1) // many}").astype(np.uint64), None if h2 is None else np.frombuffer(h2, "<u8"), None if m is None else np.frombuffer(m, "<u1"),
            None if sides is None else np.frombuffer(sides, _SIDES),
        )
        for c, v in zip(out, values):
            c.append(v)
    return [np.concatenate(c) if c and c[0] is not None else np.zeros(0, np.int64) for c in out]


class _Classes:
    """Records in classes of equal (h1, h2), each class in the order of (doc, s)."""

    def __init__(self, h1, h2, doc, s):
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        edge = np.ones(len(order), bool)
        edge[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.begin = np.flatnonzero(edge)
        self.size = np.diff(np.append(self.begin, len(order)))
        big = self.size > 1
        at = ranges(self.begin[big], self.size[big])
        some = order[at]
        order[at] = some[np.lexsort((s[some], doc[some], np.repeat(np.arange(int(big.sum())), self.size[big])))]
        self.order, self.first = order, order[self.begin]
        first = np.repeat(self.first, self.size)
        self.later = np.zeros(len(order), bool)  # by record: a record of its class has a smaller (doc, s)
        self.later[order] = (doc[order] != doc[first]) | (s[order] != s[first])
        self.group = a[self.begin]

    def spread(self, by_class: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.order), by_class.dtype)
        out[self.order] = np.repeat(by_class, self.size)
        return out


def _mixed(h2: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Second digits that keep hot records apart from the one that stands for them in the anchor's bucket."""
    return np.where(m & IS_HOT > 0, h2 ^ _SALT, h2)


def _settle(c: _Classes, m: np.ndarray, keep_first: bool) -> np.ndarray:
    """Records whose windows are to be removed. m: the record stands for several of its task."""
    if keep_first:
        return c.later
    times = np.add.reduceat(1 + (m[c.order] & SEVERAL).astype(np.int64), c.begin) if len(c.order) else np.zeros(0, np.int64)
    return c.spread(times > 1)


@dataclass(frozen=True)
class _Deal:
    """Buckets of digits and groups of documents. fan: buckets that the next shuffle tells apart."""

    buckets: int
    groups: int
    fan: int
    hot: int

    def group(self, row: np.ndarray) -> np.ndarray:
        return (row.astype(np.uint64) % np.uint64(self.groups)).astype(np.int64)

    def bucket(self, h1: np.ndarray, h2: np.ndarray, hot: np.ndarray) -> np.ndarray:
        digit = np.where(hot, mix(h1 ^ h2 * _SALT), h1) >> np.uint64(40)
        return (digit % np.uint64(self.buckets) % np.uint64(self.fan)).astype(np.int64)


def _send(out: _Rows, keep_first: bool, deal: _Deal, h1, h2, doc, row, d, s, n, narrow: bool, m=None, sides=None) -> None:
    """A task's records: one of each class to its bucket; what the task can settle itself to the documents' groups.

    doc and row are those of d's values. m: flags of records that a task has sent before.
    """
    m = np.zeros(len(h1), np.uint8) if m is None else m
    c = _Classes(h1, _mixed(h2, m), doc[d], s)
    gone = _settle(c, m, keep_first)
    if gone.any():
        out.add_by(deal.group(row[d[gone]]), "g", SETTLED, doc, row, d[gone], s[gone], n[gone], deal.fan)
    first = ~c.later if keep_first else np.zeros(len(h1), bool)
    if not keep_first:
        first[c.first] = True
    flag = m & (IS_HOT | HERALD)
    flag[c.spread(c.size > 1) | (m & SEVERAL > 0)] |= SEVERAL
    # classes of one anchor lie side by side
    edge = np.flatnonzero(np.diff(c.group, prepend=c.group[:1] + np.uint64(1))) if len(c.group) else np.zeros(0, np.int64)
    kinds = np.diff(np.append(edge, len(c.group)))
    hot = c.spread(np.repeat(kinds > deal.hot, kinds)) & first & (flag & (IS_HOT | HERALD) == 0)
    herald = np.zeros(len(h1), bool)
    herald[c.first[edge[kinds > deal.hot]]] = True
    herald &= hot
    for some, extra in ((first & ~hot | herald, np.where(herald, HERALD, np.uint8(0))), (hot, np.full(len(h1), IS_HOT))):
        i = np.flatnonzero(some)
        f = flag[i] | extra[i]
        sent = h1[i].astype("<u4") if narrow else h1[i]
        out.add_by(deal.bucket(h1[i], h2[i], f & IS_HOT > 0), "bucket", 0, doc, row, d[i], s[i], n[i], h1=sent, h2=h2[i], m=f, **({} if sides is None else {"sides": sides[i]}))


def _pass_on(table: pa.Table, out: _Rows) -> None:
    for r in table.filter(pc.greater(table.column("kind"), 0)).to_pylist():
        for c, f in zip(out.columns, _RECORDS):
            c.append(r[f.name])


def remove_repeats(docs: DataFrame, windows: Windows, finish: Callable, schema: T.StructType, key: str = "doc_id", text: str = "text") -> DataFrame:
    """finish(table of documents, removed): rows of `schema` for a group of documents.

    `removed` has, for each row, None or the tokens to remove as a mask. Rows with a null key take no
    part: nothing is removed from them or because of them.
    """
    spark = docs.sparkSession
    size = text_bytes(docs, text)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(-(-size // windows.bucket_bytes), min(32, tasks))
    groups = max(-(-size // GROUP_BYTES), 2 * tasks)
    tasks = max(tasks, min(max(groups, buckets) // GROUPS_A_TASK, MAX_TASKS))
    deal = _Deal(buckets, groups, min(windows.fan, buckets), windows.hot)
    mark, dealt_by = free_name(docs, "_row"), free_name(docs, "_g")
    keyed = docs.withColumn(mark, F.xxhash64(F.col(key), F.col(text)))
    length, keep_first = windows.length, windows.keep_first

    def find(batches):
        held, doc, row, count, load = [], [], [], 0, 0

        def flush():
            out = _Rows()
            columns = [np.concatenate(x) for x in zip(*held)]
            if len(columns[0]):
                _send(out, keep_first, deal, *columns[:2], np.concatenate(doc), np.concatenate(row), *columns[2:5], deal.fan == buckets, None, *columns[5:])
            return out.batch()

        for part in pieces(batches, text):
            body, keys, second, ends = windows.tokens(part.column(2))
            at, s, e, h1 = windows.anchors(body, keys, ends)
            spans = Spans(second, 1)
            h2 = spans(s, e + length) + ((at - s) * 1000003 + (e - s)).astype(np.uint64) * _SALT
            d = np.searchsorted(ends, s, "right") - 1
            columns = (h1, h2, d + count, s - ends[d], e - s)
            if windows.anchor:
                sides = np.zeros(len(at), _SIDES)
                sides["at"] = at - s
                for side, begin, ok in (("left", at - windows.half, at - s >= windows.half), ("right", at + windows.anchor, e + length - at - windows.anchor >= windows.half)):
                    b = begin[ok]
                    sides[side][ok] = 1 + (spans(b, b + windows.half) % np.uint64(65535)).astype("<u2")
                columns = (*columns, sides)
            held.append(columns)
            doc.append(part.column(0).to_numpy(zero_copy_only=False))
            row.append(part.column(1).to_numpy(zero_copy_only=False))
            count, load = count + part.num_rows, load + part.column(2).nbytes
            if load >= windows.flush_bytes:
                yield flush()
                held, doc, row, count, load = [], [], [], 0, 0
        if held:
            yield flush()

    def merge(batches):
        """Records of a few buckets, dealt on to all of them; what several tasks sent for one class is merged."""
        wide, held, load = _Deal(buckets, groups, buckets, windows.hot), [], 0

        def flush():
            out, table = _Rows(), pa.Table.from_batches(held)
            _pass_on(table, out)
            doc, row, s, n, h1, h2, m, sides = _open_rows(table, 0)
            if len(doc):
                _send(out, keep_first, wide, h1, h2, doc, row, np.arange(len(doc)), s, n, False, m, sides if windows.anchor and len(sides) else None)
            return out.batch()

        for batch in batches:
            held.append(batch)
            load += batch.nbytes
            if load >= windows.merge_bytes:
                yield flush()
                held, load = [], 0
        if held:
            yield flush()

    def dealt_out(records: DataFrame) -> DataFrame:
        if deal.fan < buckets:
            records = records.repartition(max(tasks, deal.fan), "bucket").mapInArrow(merge, _RECORDS_SQL)
        return records.repartition(tasks, "bucket").groupBy("bucket")

    def halves(c, classes, s, n, sides):
        """Records, starts and lengths of the windows on a side where several classes of an anchor agree."""
        rep = c.first[classes]
        middle = s[rep] + sides["at"][rep] - windows.half  # the last window with half of its rest before the anchor
        last = s[rep] + n[rep]
        for side, begin, end in (("left", s[rep], np.minimum(last, middle)), ("right", np.maximum(s[rep], middle), last)):
            mark = sides[side][rep].astype(np.uint64)
            _, which, many = np.unique(c.group[classes] << np.uint64(16) ^ mark, return_inverse=True, return_counts=True)
            ok = (mark > 0) & (many[which] > 1) & (begin <= end)
            yield rep[ok], begin[ok], (end - begin)[ok]

    def compare(table: pa.Table) -> pa.Table:
        out = _Rows()
        _pass_on(table, out)
        doc, row, s, n, h1, h2, m, sides = _open_rows(table, 0)
        if len(doc):
            c = _Classes(h1, _mixed(h2, m), doc, s)
            gone = _settle(c, m, keep_first)
            g = deal.group(row)
            index = np.arange(len(doc))
            out.add_by(g[gone], "g", SETTLED, doc, row, index[gone], s[gone], n[gone])
            edge = np.diff(c.group, prepend=c.group[0] + np.uint64(1)) != 0
            kinds = np.diff(np.append(np.flatnonzero(edge), len(c.group)))
            hot = m[c.first] & IS_HOT > 0
            differ = np.repeat(kinds > 1, kinds) | hot  # classes whose anchor has other runs too
            if windows.anchor:
                for i, b, m2 in halves(c, np.flatnonzero(differ & ~hot), s, n, sides):
                    out.add_by(g[i], "g", OPEN, doc, row, i, b, m2)
                differ = hot
            speak = c.spread(differ) & ~c.later if keep_first else np.isin(index, c.first[differ])
            out.add_by(g[speak], "g", OPEN, doc, row, index[speak], s[speak], n[speak])
        return pa.Table.from_batches([out.batch()])

    def places(table: pa.Table) -> dict:
        found: dict = {}
        for i, k in enumerate(zip(table.column(key).to_pylist(), table.column(mark).to_pylist())):
            found.setdefault(k, []).append(i)
        return found

    def single(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _Rows()
        doc, row, s, n, *_ = _open_rows(right, OPEN)
        if len(doc):
            at = places(left)
            d = np.array([at[k][0] for k in zip(doc.tolist(), row.tolist())], np.int64)
            doc_of, row_of = left.column(key).to_numpy(), left.column(mark).to_numpy()
            used = np.unique(d)
            held = []
            texts = left.column(text).combine_chunks()
            for some in np.array_split(used, max(1, left.nbytes >> 21)):
                if len(some):
                    _, keys, second, ends = windows.tokens(texts.take(pa.array(some)))
                    mine = np.isin(d, some)
                    j = np.searchsorted(some, d[mine])
                    p = np.unique(ranges(ends[j] + s[mine], n[mine] + 1))
                    own = np.searchsorted(ends, p, "right") - 1
                    held.append((Spans(keys)(p, p + length), Spans(second, 1)(p, p + length), some[own], p - ends[own]))
            h1, h2, d, p = (np.concatenate(x) for x in zip(*held))
            _send(out, keep_first, deal, h1, h2, doc_of, row_of, d, p, np.zeros(len(p), np.int64), False)
        return pa.Table.from_batches([out.batch()])

    def compare_single(table: pa.Table) -> pa.Table:
        out = _Rows()
        _pass_on(table, out)
        doc, row, s, n, h1, h2, m, _ = _open_rows(table, 0)
        if len(doc):
            gone = _settle(_Classes(h1, h2, doc, s), m, keep_first)
            g = deal.group(row)
            out.add_by(g[gone], "g", SETTLED, doc, row, np.arange(len(doc))[gone], s[gone], n[gone])
        return pa.Table.from_batches([out.batch()])

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        removed: list = [None] * left.num_rows
        doc, row, s, n, *_ = _open_rows(right, SETTLED)
        if len(doc) and left.num_rows:
            at = places(left)
            order = np.lexsort((row, doc))
            cut = np.flatnonzero((np.diff(doc[order]) != 0) | (np.diff(row[order]) != 0)) + 1
            for i in np.split(order, cut):
                stop = int((s[i] + n[i]).max()) + length
                step = np.zeros(stop + 1, np.int64)
                np.add.at(step, s[i], 1)
                np.add.at(step, s[i] + n[i] + length, -1)
                mask = np.cumsum(step)[:stop] > 0
                for j in at[int(doc[i[0]]), int(row[i[0]])]:
                    removed[j] = mask
        return finish(left.drop_columns([mark, dealt_by]), removed)

    records = keyed.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), mark, text).mapInArrow(find, _RECORDS_SQL)
    told = stored(dealt_out(records).applyInArrow(compare, _RECORDS_SQL).filter("g >= 0"), "repeats")
    # both uses of the documents read one shuffle
    dealt = keyed.withColumn(dealt_by, _group(mark, groups)).repartition(tasks, dealt_by)
    by_group = dealt.groupBy(dealt_by)
    ends = by_group.cogroup(told.filter(F.col("kind") == OPEN).groupBy("g")).applyInArrow(single, _RECORDS_SQL)
    more = dealt_out(ends).applyInArrow(compare_single, _RECORDS_SQL).filter("g >= 0")
    all_told = told.filter(F.col("kind") == SETTLED).unionByName(more)
    return by_group.cogroup(all_told.groupBy("g")).applyInArrow(apply, schema)


def _group(row: str, groups: int):
    """The row hash as an unsigned number modulo the number of groups, as the tasks compute it."""
    high, low = F.shiftrightunsigned(row, 32), F.col(row).bitwiseAND(F.lit(0xFFFFFFFF))
    return (((high % groups) * ((1 << 32) % groups) + low) % groups).cast("int")
