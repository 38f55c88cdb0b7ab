"""Byte-level BPE: whole texts to ids and back, with batched merge rounds.

Texts of an Arrow batch lie in one flat byte array. Class boundaries cut it into words in a few
vector passes; equal words are found by sorting their hashes and comparing their bytes, so each distinct word
of a piece is merged once, and words met before come from the worker's bounded cache. The new words' symbols lie
in one flat array; each round finds every word's lowest-ranked pair, whose rank comes from a binary
search over the sorted keys of all pairs, and merges it in all words together.

Defined results: a null or empty text has no ids. A text of any length is encoded whole, in a piece of
its own, and a word of over LONG_WORD bytes by a heap. An empty table gives none. A special token's string in a text becomes
that token's id, as the tokenizers library does. Repeated rows encode alike. Columns named like a
result are replaced by it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._bytes import flat, pieces, ranges, word_keys

OTHER, LETTER, NUMBER, BLANK = range(4)
#: Words and bytes of them that the worker remembers; beyond these the memory starts anew.
REMEMBERED, REMEMBERED_BYTES = 1 << 19, 1 << 25
#: Words of more symbols are merged one by one with a heap.
LONG_WORD = 4096
#: Words of up to so many bytes have equal keys and sizes only if they are equal; longer ones are compared.
ONE_TO_ONE = 8
_NONE = np.int64(1 << 40)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: bytes that print stand for themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in own}, 256
    for b in range(256):
        if chr(b) not in out or b not in own:
            out[chr(extra)] = b
            extra += 1
    return out


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point, and of every byte below 128."""
    table = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        table[cp] = kinds.get(unicodedata.category(chr(cp))[0], OTHER)
    # Code points with the Unicode property White_Space.
    for cp in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[cp] = BLANK
    return table, table[:256].copy()


def byte_classes(body: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table, low = _classes()
    out = low[body]
    lead = np.flatnonzero(body >= 0xC0)
    if len(lead):
        b = np.concatenate([body, np.zeros(3, np.uint8)]).astype(np.uint32)
        first = b[lead]
        two, three, four = first < 0xE0, (first >= 0xE0) & (first < 0xF0), first >= 0xF0
        c1, c2, c3 = b[lead + 1] & 63, b[lead + 2] & 63, b[lead + 3] & 63
        cp = np.where(two, (first & 31) << 6 | c1, np.where(three, (first & 15) << 12 | c1 << 6 | c2, (first & 7) << 18 | c1 << 12 | c2 << 6 | c3))
        kind = table[np.minimum(cp, 0x10FFFF)]
        for step, some in ((0, None), (1, None), (2, three | four), (3, four)):
            at = lead + step if some is None else (lead + step)[some]
            out[at] = kind if some is None else kind[some]
    return out


def word_starts(body: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words begin: runs of letters, numbers or others, each with one space before it, and runs of white space."""
    n = len(body)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(body)
    edge = np.zeros(n, bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    first = np.unique(ends[:-1][ends[:-1] < n])
    edge[first] = True
    text_start = np.zeros(n + 1, bool)
    text_start[ends] = True
    at = np.flatnonzero(edge)  # run starts
    run_end = np.append(at[1:], n)
    blank = kind[at] == BLANK
    # a run of white space before a word gives its last character away: a space joins the word, another stands alone
    inner = blank & ~text_start[run_end]
    last = run_end[inner] - 1
    while len(deep := np.flatnonzero((body[last] & 0xC0) == 0x80)):
        last[deep] -= 1
    space = body[last] == 32
    start = edge
    start[run_end[inner][space]] = False
    start[last] = True
    # 's 't 'm 'd 're 've 'll: an apostrophe that no space precedes, with letters right behind
    quote = at[(run_end - at == 1) & (body[at] == 39)]
    quote = quote[start[quote]]
    b = np.concatenate([body, np.zeros(2, np.uint8)])
    stop = np.concatenate([text_start, np.ones(2, bool)])
    one, two = b[quote + 1], b[quote + 2]
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & ~stop[quote + 1]
    pair = (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)) & ~stop[quote + 1] & ~stop[quote + 2]
    for some, width in ((single, 2), (pair & ~single, 3)):
        q = quote[some]
        start[q + 1] = False
        tail = q + width
        tail = tail[tail < n]
        start[tail] = True
    return np.flatnonzero(start)


def _same_words(a: np.ndarray, a_begin: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_begin: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether words with equal keys have equal bytes."""
    same = a_size == b_size
    long = np.flatnonzero(same & (a_size > ONE_TO_ONE))
    if len(long):
        n = a_size[long]
        differ = a[ranges(a_begin[long], n)] != b[ranges(b_begin[long], n)]
        same[long] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return same


class Bpe:
    """Vocabulary and merges of one byte-level BPE file, as arrays."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        alphabet = _byte_alphabet()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = made  # by rank
        by_id = [b""] * self.size
        for s, i in vocab.items():
            by_id[i] = bytes(alphabet[c] for c in s)
        for s, i in self.special.items():
            by_id[i] = s.encode()
        self.width = np.array([len(x) for x in by_id], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known, self.text, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.at, self.many, self.start, self.length = (np.zeros(0, np.int64) for _ in range(4))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (left >= 0) & (right >= 0), self.ranks[i], _NONE)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words whose byte ids lie in one flat array: (ids, number of ids of each word)."""
        count = len(sizes)
        out_ids, out_word = [], []
        word = np.repeat(np.arange(count), sizes)
        long = np.flatnonzero(sizes > LONG_WORD)
        if len(long):
            begin = np.cumsum(sizes) - sizes
            for w in long:
                ids = self._merge_long(symbols[begin[w] : begin[w] + sizes[w]].tolist())
                out_ids.append(np.array(ids, np.int64))
                out_word.append(np.full(len(ids), w))
            keep = sizes[word] <= LONG_WORD
            symbols, word = symbols[keep], word[keep]
        # the rank of the pair that starts at each symbol; none where the word ends
        ranks = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            ranks[:-1] = np.where(word[:-1] == word[1:], self.rank(symbols[:-1], symbols[1:]), _NONE)
        while len(symbols):
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(ranks, heads)
            done = low == _NONE
            if done.any():  # finished words leave the array
                lengths = np.diff(np.append(heads, len(word)))
                out = np.repeat(done, lengths)
                out_ids.append(symbols[out])
                out_word.append(word[out])
                symbols, word, ranks = symbols[~out], word[~out], ranks[~out]
                if not len(symbols):
                    break
                heads = np.flatnonzero(np.diff(word, prepend=-1))
                low = low[~done]
            lengths = np.diff(np.append(heads, len(word)))
            hit = ranks == np.repeat(low, lengths)
            # of overlapping hits (a run of one symbol) every second one from the left counts
            at = np.flatnonzero(hit)
            if len(at) > 1:
                fresh = np.diff(at, prepend=-2) != 1
                first = at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
                at = at[(at - first) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            for i in (new, new[new > 0] - 1):  # pairs that begin or end with a new symbol
                last = i + 1 >= len(symbols)
                j = np.where(last, i, i + 1)
                ranks[i] = np.where(last | (word[i] != word[j]), _NONE, self.rank(symbols[i], symbols[j]))
        ids = np.concatenate(out_ids) if out_ids else np.zeros(0, np.int64)
        owner = np.concatenate(out_word) if out_word else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=count)

    def _merge_long(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda a, b: int(self.rank(np.array([a]), np.array([b]))[0])
        s = np.array(symbols)
        heap = [(int(r), i, symbols[i], symbols[i + 1]) for i, r in enumerate(self.rank(s[:-1], s[1:])) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := rank(symbols[x], symbols[y])) < _NONE:
                    heapq.heappush(heap, (q, x, symbols[x], symbols[y]))
        return [x for x in symbols if x >= 0]

    def _look_up(self, body: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of every word's ids in self.ids; unknown words are merged first.

        Hashes only find candidates: a word takes another's ids after their bytes have been compared.
        """
        h = word_keys(body, begin, size)
        distinct, one, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED or len(self.text) > REMEMBERED_BYTES:
            self.forget()
        clash = ~_same_words(body, begin, size, body, begin[one[which]], size[one[which]])
        i = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[i] != distinct if len(self.known) else np.ones(len(distinct), bool)
        old = np.flatnonzero(~new)
        if len(old):
            wrong = np.zeros(len(distinct), bool)
            wrong[old] = ~_same_words(body, begin[one[old]], size[one[old]], self.text, self.start[i[old]], self.length[i[old]])
            clash |= wrong[which]
        if new.any():
            b, n = begin[one[new]], size[one[new]]
            letters = body[ranges(b, n)]
            at, many = self._append(letters, n)
            start = len(self.text) + np.cumsum(n) - n
            self.text = np.concatenate([self.text, letters])
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            for name, more in (("at", at), ("many", many), ("start", start), ("length", n)):
                setattr(self, name, np.concatenate([getattr(self, name), more])[order])
            i = np.searchsorted(self.known, distinct)
        at, many = self.at[i][which], self.many[i][which]
        if clash.any():  # other words have the same hash: merged on their own
            b, n = begin[clash], size[clash]
            at[clash], many[clash] = self._append(body[ranges(b, n)], n)
        return at, many

    def _append(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words and append their ids to self.ids: places and numbers."""
        ids, many = self.merge(self.byte_id[letters], sizes)
        at = len(self.ids) + np.cumsum(many) - many
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        return at, many

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and the n + 1 offsets of the texts in it."""
        body, ends = flat(texts)
        cuts = ends
        found: dict[int, tuple[int, int]] = {}
        raw = body.tobytes()
        for s, i in self.special.items():
            mark, p = s.encode(), -1
            while (p := raw.find(mark, p + 1)) >= 0:
                t = int(np.searchsorted(ends, p, "right")) - 1
                if p + len(mark) <= ends[t + 1] and not any(q < p + len(mark) and p < q + w for q, (w, _) in found.items()):
                    found[p] = (len(mark), i)
        if found:
            cuts = np.unique(np.concatenate([ends, [p for p in found], [p + w for p, (w, _) in found.items()]]))
        begin = word_starts(body, cuts)
        size = np.diff(np.append(begin, len(body)))
        if not len(begin):
            return np.zeros(0, self.ids.dtype), np.zeros(len(ends), np.int64)
        at, many = self._look_up(body, begin, size)
        if found:  # a special token's string is one word between two cuts, but its pieces may be several
            marks = np.array(sorted(found))
            first = np.searchsorted(begin, marks)
            stop = np.searchsorted(begin, marks + np.array([found[p][0] for p in marks]))
            keep = np.ones(len(begin), bool)
            for a, z in zip(first, stop):
                keep[a + 1 : z] = False
            extra = len(self.ids)
            self.ids = np.concatenate([self.ids, np.array([found[p][1] for p in marks], self.ids.dtype)])
            at[first], many[first] = extra + np.arange(len(marks)), 1
            begin, at, many = begin[keep], at[keep], many[keep]
        ids = self.ids[ranges(at, many)]
        if found:
            self.ids = self.ids[:extra]
        upto = np.append(0, np.cumsum(many))
        return ids, upto[np.searchsorted(begin, ends)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents in one flat array, and the offsets of the documents in it."""
        width = self.width[ids]
        upto = np.append(0, np.cumsum(width))
        return self.bytes[ranges(self.begin[ids], width)], upto[ends]


_LOADED: dict[int, Bpe] = {}


class Tokenizer:
    """A tokenizer file, read once on the driver and sent to the executors as a broadcast of fixed size."""

    def __init__(self, spark, path: str | None = None):
        with open(path or default_path(), encoding="utf-8") as f:
            text = f.read()
        self.key = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
        self.size = Bpe(text).size
        self.text = spark.sparkContext.broadcast(text)

    def __getstate__(self):
        return {"key": self.key, "size": self.size, "text": self.text}

    def bpe(self) -> Bpe:
        if self.key not in _LOADED:
            _LOADED.clear()
            _LOADED[self.key] = Bpe(self.text.value)
        return _LOADED[self.key]


def digests(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then decoded from the ids."""
    model = Tokenizer(docs.sparkSession, path)
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def work(batches):
        bpe, sha = model.bpe(), hashlib.sha256
        for part in pieces(batches, text):
            ids, ends = bpe.encode(part.column(1))
            back, upto = bpe.decode(ids, ends)
            wide, back = memoryview(ids.astype("<u4")).cast("B"), back.tobytes()
            a, b = ends.tolist(), upto.tolist()
            decoded = [sha(back[x:y].decode("utf-8", "replace").encode()).hexdigest() for x, y in zip(b, b[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(ends)), pa.array([sha(wide[4 * x : 4 * y]).hexdigest() for x, y in zip(a, a[1:])]), pa.array(decoded)],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(key, text).mapInArrow(work, schema)


def token_ids(docs: DataFrame, path: str | None = None, text: str = "text", into: str = "ids", end_id: int | None = None) -> DataFrame:
    """`docs` with `into`: the ids as little-endian unsigned integers of 16 bits, or 32 for a larger vocabulary."""
    model = Tokenizer(docs.sparkSession, path)
    kept = docs.drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.BinaryType())])

    def work(batches):
        bpe = model.bpe()
        for part in pieces(batches, text):
            ids, ends = bpe.encode(part.column(part.schema.get_field_index(text)))
            raw, w = ids.tobytes(), ids.dtype.itemsize
            tail = b"" if end_id is None else np.array([end_id], ids.dtype).tobytes()
            e = (ends * w).tolist()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([raw[x:y] + tail for x, y in zip(e, e[1:])], pa.binary())], names=[*part.schema.names, into])

    return kept.mapInArrow(work, schema)


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """`docs` without the text and with the number of its ids."""
    model = Tokenizer(docs.sparkSession, path)
    kept = [c for c in docs.columns if c not in (text, into)]
    schema = T.StructType([*docs.select(kept).schema.fields, T.StructField(into, T.LongType())])

    def work(batches):
        bpe = model.bpe()
        for part in pieces(batches, text):
            _, ends = bpe.encode(part.column(part.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(np.diff(ends))], names=[*kept, into])

    return docs.select(*kept, text).mapInArrow(work, schema)
