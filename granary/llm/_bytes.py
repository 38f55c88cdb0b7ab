"""Flat byte arrays for Arrow batches of texts, and hashes over them (used inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: A batch is worked on in pieces of about this many bytes, so a task's arrays stay small.
PIECE = 1 << 20
MASK = (1 << 64) - 1


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array (nulls as empty) and the n + 1 offsets of its texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets and len(texts) else np.zeros(len(texts) + 1, np.int64)
    body = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return body[ends[0] : ends[-1]], ends - ends[0]


def pieces(batches, text: str, size: int = PIECE):
    """Slices of record batches with about `size` bytes of text each (a longer text is a slice of its own)."""
    for batch in batches:
        if batch.num_rows:
            _, ends = flat(batch.column(batch.schema.get_field_index(text)))
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, "right")) - 1)
                yield batch.slice(start, stop - start)
                start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Hashes of spans are polynomials modulo this prime; its bases are fixed values without structure.
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30, _LOW32 = (np.uint64(x) for x in (PRIME, (1 << 31) - 1, (1 << 30) - 1, (1 << 32) - 1))
BASES = (0x13C6EF372FE94F82, 0x0A5458F2B7E15162)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any 64-bit x."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.minimum(x, x - _P)  # below the prime the difference wraps around to a large value


def times(a: np.ndarray, b) -> np.ndarray:
    """a * b modulo the prime, for values below it."""
    ah, al, bh, bl = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = al * bh
    middle += ah * bl
    ah *= bh
    ah <<= np.uint64(1)
    ah += middle >> np.uint64(30)
    middle &= _LOW30
    middle <<= np.uint64(31)
    al *= bl
    ah += middle
    ah += al
    return _fold(ah)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo the prime for i < n; kept for the life of the worker up to a few pieces' size."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, PIECE + 4096)
        out = []
        for b in (base, pow(base, -1, PRIME)):
            p = np.ones(m, np.uint64)
            done = 1
            while done < m:  # doubling
                more = min(done, m - done)
                p[done : done + more] = times(p[:more], np.uint64(pow(b, done, PRIME)))
                done += more
            out.append(p)
        have = tuple(out)
        if m <= 8 * PIECE:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(3)


class Spans:
    """Hashes of any spans of one flat array of keys, from sums of key * base**position modulo a prime.

    A span's hash is (sum at its end - sum at its start) * base**-start, mixed: it depends on the
    content alone. Two different spans of n tokens agree for at most n of the 2**61 bases, whatever
    their structure (a modulus of 2**64 has no such bound: words of a certain structure agree for
    every base). Operators that decide on hashes alone combine two bases.
    """

    def __init__(self, keys: np.ndarray, base: int = 0):
        n = len(keys)
        up, self.down = powers(n + 1, BASES[base])
        terms = times(_fold(keys), up[:n])
        # sums of the terms' halves are exact
        self.low, self.high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(terms & _LOW32, out=self.low[1:])
        np.cumsum(terms >> np.uint64(32), out=self.high[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        low, high = self.low[ends] - self.low[starts], self.high[ends] - self.high[starts]
        total = _fold(((high << np.uint64(32)) & _P) + (high >> np.uint64(29)) + _fold(low))
        h = times(total, self.down[starts])
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def gram_keys(body: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the `width` bytes (a multiple of 8) that start at each place."""
    if len(body) < width:
        return np.zeros(0, np.uint64)
    h = mix(np.lib.stride_tricks.as_strided(body, (len(body) - 7, 8), (1, 1)).copy().view("<u8").ravel())
    many = len(body) - width + 1
    total = np.zeros(many, np.uint64)
    for i in range(0, width, 8):
        total += h[i : i + many] * np.uint64(pow(BASES[0] | 1, i // 8 + 1, 1 << 64))
    return mix(total)


#: Words of more bytes are hashed one by one.
LONG_KEY = 256


def word_keys(body: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word's bytes, eight at a time, each step a bijection of what came before."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded.view(), (len(body) + 1, 8), (1, 1))
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 + seed))
    open_, at, left = np.arange(len(begin)), begin, size
    step = np.uint64(0xD6E8FEB86659FD93)
    short = size <= LONG_KEY
    if not short.all():
        for i in np.flatnonzero(~short):
            h[i] = xxhash.xxh3_64_intdigest(body[begin[i] : begin[i] + size[i]], seed)
        open_, at, left = open_[short], begin[short], size[short]
    while len(open_):
        chunk = eights[at].copy().view("<u8").ravel()
        chunk &= np.uint64(MASK) >> (np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64)))
        h[open_] = mix((h[open_] ^ chunk) * step + np.uint64(1))
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    return h


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    firsts = np.cumsum(lengths) - lengths
    return np.repeat(starts - firsts, lengths) + np.arange(total, dtype=np.int64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
