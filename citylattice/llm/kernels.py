"""Vectorised text kernels over Arrow string buffers: words, rolling hashes and windows without Python strings.

A column is walked in slices of about ``SLICE`` bytes (a longer single text is a slice of its own), so that the
temporary arrays stay bounded by the slice or by the longest text and not by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words split at ASCII white space only.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(mix(np.arange(n, dtype=U64) + U64(salt * 1_000_003)))


#: Hashes are polynomials modulo this prime.
PRIME = (1 << 61) - 1
_P, _LOW32, _LOW29 = U64(PRIME), U64((1 << 32) - 1), U64((1 << 29) - 1)
#: Positions that are worked on in one go, so that temporary arrays stay in the processor's cache.
STEP = 1 << 15


def _least(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2^64."""
    x = (x & _P) + (x >> U64(61))
    return np.minimum(x, x - _P)  # below the prime the difference wraps round and is the larger


def _times32(x: np.ndarray) -> np.ndarray:
    """Something below 2^62 that is x * 2^32 modulo the prime, for x below 2^62."""
    return (x >> U64(29)) + ((x & _LOW29) << U64(32))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for values below it."""
    a0, a1, b0, b1 = a & _LOW32, a >> U64(32), b & _LOW32, b >> U64(32)
    low = a0 * b0
    return _least((a1 * b1 << U64(3)) + _times32(a1 * b0 + a0 * b1) + (low & _P) + (low >> U64(61)))


class Powers:
    """Polynomial hashes modulo 2^61 - 1: powers of a base and of its inverse, grown when a longer slice comes. Two strings
    of n bytes have the same hash for n of the 2^61 bases at most."""

    def __init__(self, salt: int):
        self.base = int(seeds(1, salt)[0]) % (PRIME - 2) + 2
        self.inverse = pow(self.base, -1, PRIME)
        self.n = 0

    def _series(self, base: int, n: int) -> np.ndarray:
        out = np.ones(n, dtype=U64)
        done, factor = 1, base % PRIME
        while done < n:
            more = min(done, n - done)
            with np.errstate(over="ignore"):
                out[done : done + more] = product(out[:more], U64(factor))
            done, factor = done + more, factor * factor % PRIME
        return out

    def _upto(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, SLICE + 65536)
            up = self._series(self.base, self.n)
            self.up_low, self.up_high = (up & _LOW32).astype(np.uint32), (up >> U64(32)).astype(np.uint32)
            self.down = self._series(self.inverse, self.n)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of (byte + 1) * base^position; one more entry than bytes."""
        self._upto(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=U64)
        with np.errstate(over="ignore"):
            for at in range(0, len(data), STEP):
                to = min(at + STEP, len(data))
                value = data[at:to].astype(U64) + U64(1)
                low, high = np.cumsum(value * self.up_low[at:to]), np.cumsum(value * self.up_high[at:to])
                out[at + 1 : to + 1] = _least(_times32(high) + (low & _P) + (low >> U64(61)) + out[at])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], equal for equal bytes wherever they stand."""
        self._upto(len(prefix))
        out = np.empty(len(start), dtype=U64)
        with np.errstate(over="ignore"):
            for at in range(0, len(start), STEP):
                s, e = start[at : at + STEP], end[at : at + STEP]
                out[at : at + STEP] = product(_least(prefix[e] + _P - prefix[s]), self.down[s])
        return out

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all strings of ``size`` bytes, by where they start."""
        self._upto(len(prefix))
        n = max(0, len(prefix) - size)
        out = np.empty(n, dtype=U64)
        with np.errstate(over="ignore"):
            for at in range(0, n, STEP):
                to = min(at + STEP, n)
                out[at:to] = product(_least(prefix[at + size : to + size] + _P - prefix[at:to]), self.down[at:to])
        return out


FIRST, SECOND = Powers(11), Powers(23)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not large and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    n = len(column)
    _, offsets, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows holding about ``size`` bytes."""
    data, offs = text_buffers(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(low: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in lower-cased bytes, and n+1 offsets of each text's words. No word crosses texts."""
    inside = kind[low]
    before = np.zeros(len(low) + 1, dtype=bool)
    before[1:] = inside
    edges = offs[(offs >= 0) & (offs <= len(low))]
    before[edges] = False
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(low) + 1, dtype=bool)
    after[:-1] = inside
    after[edges] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(FIRST.spans(FIRST.prefix(low), start, end))


def grams(hashes: np.ndarray, k: int, salt: int = 5) -> np.ndarray:
    """Hashes of k consecutive word hashes, one for each start that has k words after it in the array."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    factor, out = seeds(k, salt) | U64(1), np.zeros(n, dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += hashes[j : j + n] * factor[j]
    return mix(out)
