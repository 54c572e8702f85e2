"""Vectorised text primitives for Arrow batches: slabs of rows, words, hashes of words and runs.

All hashes are fixed functions of the bytes, the same in every task and run. A word's hash is a
polynomial in 2^64 over randomised bytes, mixed; powers of odd bases have inverses there, so
prefix sums give the hash of any span without a loop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SLAB = 1 << 20
_P, _Q = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)
_RANDOM = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict = {}


def powers(base, n):
    """base**0 .. base**(n-1) modulo 2^64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, SLAB + 1), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def inverse(base):
    return U(pow(int(base), -1, 1 << 64))


def mix(x):
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(values, starts, ends, base):
    """Hash of values[s:e] for each pair, before mixing."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return (total[ends] - total[starts]) * powers(inverse(base), n + 1)[starts]


def raw_bytes(column):
    """The bytes and the n+1 offsets of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, at


def slabs(column, most=SLAB):
    """(first row, rows' bytes, offsets from 0): whole rows, about `most` bytes or one long row."""
    body, at = raw_bytes(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a slab: byte starts and ends, `first` (words before each row, n+1), hashes."""

    def __init__(self, body, offsets, lower=False):
        if lower:
            body = _LOWER[body]
        n = len(body)
        inside = ~_SEP[body]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | cut[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | cut[1:n]
        self.body, self.offsets = body, offsets
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self):
        return mix(span_hashes(_RANDOM[self.body], self.starts, self.ends, _P))

    def rows(self):
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def run_hashes(words, k, base=_Q):
    """Hash of every k consecutive values, over row borders too."""
    n = max(0, len(words) - k + 1)
    at = np.arange(n)
    return mix(span_hashes(words, at, at + k, base)) if n else np.zeros(0, np.uint64)


def whole_runs(first, k):
    """True at each position from which k words lie in one row; len(words)-k+1 of them."""
    total = int(first[-1])
    n = max(0, total - k + 1)
    ok = np.zeros(total + 1, np.int32)
    lo, hi = first[:-1], np.maximum(first[1:] - k + 1, first[:-1])
    np.add.at(ok, lo, 1)
    np.add.at(ok, hi, -1)
    return np.cumsum(ok)[:n] > 0
