"""Whole Arrow batches of text as numpy arrays of words.

A word is a maximal run of bytes other than the ASCII white space
``[\\x20\\x09-\\x0D]``; in UTF-8 that is the same as the run of characters.
Words are told apart by a 64-bit hash of their bytes, which costs a few passes
over the bytes and no Python call per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; longer texts are cut at white space only.
SEGMENT = 1 << 20
#: Text bytes handled at once by the operators.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept, and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.ones(size, np.uint64)
            have[1:] = np.uint64(base)
            have = np.multiply.accumulate(have)
        if size <= 4 * SEGMENT:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about ``size`` bytes of text, of one row at least."""
    if not batch.num_rows:
        return
    lengths = np.diff(offsets(batch.column(column)))
    block = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


class Words:
    """The words of a batch of texts (null: empty).

    raw      the bytes of all texts, lower-cased in A-Z if asked for
    start, end   places of each word in raw
    doc      each word's row
    first    row i's words are first[i] .. first[i + 1] - 1
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        if texts.null_count:
            texts = texts.fill_null("")
        at = offsets(texts)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]
        self.raw = _LOWER[raw] if lower else raw
        inside = ~_SPACE[raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        heads = self.at[:-1][self.at[:-1] < self.at[1:]]
        begins[heads] = inside[heads]
        tails = self.at[1:][self.at[:-1] < self.at[1:]] - 1
        ends[tails] = inside[tails]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, prefix: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``prefix`` bytes."""
        out = np.empty(len(self), np.uint64)
        a = 0
        while a < len(self):
            b = int(np.searchsorted(self.start, self.start[a] + SEGMENT))
            lo, hi = self.start[a], self.end[b - 1]
            with np.errstate(over="ignore"):
                sums = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(_VALUE[self.raw[lo:hi]] * powers(_BASE, hi - lo), out=sums[1:])
                s, e = self.start[a:b] - lo, self.end[a:b] - lo
                if prefix:
                    e = np.minimum(e, s + prefix)
                out[a:b] = mix((sums[e] - sums[s]) * powers(_BASE_INVERSE, hi - lo)[s])
            a = b
        return out


def runs(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive values; shorter by n - 1."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    base = np.uint64((0xD1342543DE82EF95 + 2 * seed * 0x9E3779B97F4A7C15) % (1 << 64) | 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            total = total * base + hashes[i : len(hashes) - n + 1 + i]
    return mix(total)
