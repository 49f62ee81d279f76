"""Texts of an Arrow batch as byte arrays, with hashes of words and byte runs by prefix sums.

Runs of bytes are hashed by a polynomial modulo the prime 2^61 - 1, finished by a mixing step. A prime modulus has no
zero divisors, so no family of words (such as the Thue-Morse words, whose sums agree modulo 2^64 for every base) has
equal hashes by construction. Hashes depend on the bytes alone and are the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PRIME = (1 << 61) - 1
BASE = 0x1E3779B97F4A7C15 % PRIME
_VALUES = np.random.default_rng(20240131).choice(np.arange(1, 1 << 16, dtype=np.uint64), 256, replace=False) * np.uint64(32_749) + np.uint64(17)
_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
#: Numbers that are worked on at a time, so that what comes in between stays in a core's cache.
_STEP = 1 << 13


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.minimum(x, x - _P)


def _times_31_bits(x: np.ndarray) -> np.ndarray:
    """x * 2^31 of numbers below 2^61, below 2^62: bits from 2^61 on come in again at the bottom."""
    return ((x & _LOW30) << _31) + (x >> _30)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it, by halves of 31 bits."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    return _reduced(((a1 * b1) << np.uint64(1)) + _times_31_bits(a1 * b0 + a0 * b1) + a0 * b0)


def power(n: int) -> np.ndarray:
    """The first ``n`` powers of the base modulo the prime; kept, and made longer by a million at a time."""
    global _powers
    while len(_powers) < n:
        block = _powers[: 1 << 20]
        _powers = np.concatenate([_powers, product(block, np.full(len(block), pow(BASE, len(_powers), PRIME), np.uint64))])
    return _powers[:n]


def inverse_power(at: np.ndarray) -> np.ndarray:
    """The powers of the base's inverse at some places, from two short tables: 4,096 powers, and every 4,096th."""
    global _far
    last = int(at.max(initial=0)) >> 12
    if len(_far) <= last:
        step, known = pow(_INVERSE, 1 << 12, PRIME), _far.tolist()
        while len(known) <= last:
            known.append(known[-1] * step % PRIME)
        _far = np.array(known, np.uint64)
    return product(_NEAR[at & 4095], _far[at >> 12])


_INVERSE = pow(BASE, -1, PRIME)
_powers, _far = np.ones(1, np.uint64), np.ones(1, np.uint64)
_NEAR = np.array([pow(_INVERSE, k, PRIME) for k in range(1 << 12)], np.uint64)


def pieces_of(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of about ``most_bytes`` of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Texts:
    """The UTF-8 bytes of a text column, laid end to end; a null text is empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
        column = pc.fill_null(column.cast(kind), "")
        if lower:
            column = pc.utf8_lower(column)
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = self.offsets[0] if len(self.offsets) else 0
        self.data = whole[first : self.offsets[-1]]
        self.offsets = self.offsets - first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def prefix(self) -> np.ndarray:
        """Sums modulo the prime for :func:`run_hash`, one longer than the data."""
        n = len(self.data)
        sums, powers, before = np.zeros(n + 1, np.uint64), power(n), np.uint64(0)
        for k in range(0, n, _STEP):
            up, values = powers[k : k + _STEP], _VALUES[self.data[k : k + _STEP]]
            terms = _reduced(_times_31_bits((up >> _31) * values) + (up & _LOW31) * values)
            high = np.cumsum(terms >> _31)
            part = _reduced(_times_31_bits(high) + np.cumsum(terms & _LOW31) + before)
            sums[k + 1 : k + 1 + len(part)] = part
            before = part[-1]
        return sums

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each longest run of bytes that ``is_word`` (a table of 256) holds for."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        inside = is_word[self.data]
        filled = self.sizes > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = self.offsets[:-1][filled]
        first[at] = inside[at]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        at = self.offsets[1:][filled] - 1
        last[at] = inside[at]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1


def run_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to each end."""
    found = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), _STEP):
        s, e = starts[k : k + _STEP], ends[k : k + _STEP]
        found[k : k + _STEP] = mix(product(_reduced(sums[e] + (_P - sums[s])), inverse_power(s)))
    return found


def table(allowed: str | bytes, high: bool = False) -> np.ndarray:
    """A table of 256 that holds the given ASCII bytes, and all bytes of non-ASCII characters if ``high``."""
    found = np.zeros(256, bool)
    found[np.frombuffer(allowed.encode() if isinstance(allowed, str) else allowed, np.uint8)] = True
    found[128:] = high
    return found
