"""Vectorised text kernels over UTF-8 bytes: word hashes and word shingles.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
Hashes are 64 bit: a polynomial over seeded per-byte values, then mixed.
"""

from __future__ import annotations

import zlib

import numpy as np

U = np.uint64
WIDTH = 5
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
_MULT = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return values, space


VALUES, SPACE = _tables()
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, (1 << 20) + 65536)
        with np.errstate(over="ignore"):
            up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
            up[0] = down[0] = 1
            _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def prefix(data: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, with a leading 0."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end]: equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT[4])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; rows are data[offsets[i]:offsets[i + 1]]."""
    return runs(~SPACE[data], offsets)


def runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of solid bytes inside a row."""
    n = len(solid)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


CRC_LONG = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


CRC = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] for each pair; `before`: the CRC of what comes ahead of each."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32) if before is None else before.astype(np.uint32)
    order = np.argsort(-np.minimum(size, CRC_LONG + 1), kind="stable")
    own, at, size_of = ~out[order], starts[order], size[order]
    own_long = int(np.searchsorted(-size_of, -CRC_LONG, "left")) if len(order) else 0
    for k in range(own_long):  # long ones, each for itself
        own[k] = ~np.uint32(zlib.crc32(data[at[k] : at[k] + size_of[k]], int(~own[k])))
    size_of[:own_long] = 0
    short, at = own[own_long:], at[own_long:]
    falling = -size_of[own_long:]
    for j in range(int(-falling[0]) if len(falling) else 0):
        k = int(np.searchsorted(falling, -j, "left"))
        short[:k] = CRC[(short[:k] ^ data[at[:k] + j]) & np.uint32(255)] ^ (short[:k] >> np.uint32(8))
    out[order] = ~own
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of `width` words, in text order; a shorter text has one, of all its words."""
    starts, ends, row = words(data, offsets)
    if not len(starts):
        return row, np.zeros(0, np.uint64)
    h = span_hash(prefix(data), starts, ends)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    m = len(h) - width + 1
    out_row, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if m > 0:
            acc = np.zeros(m, np.uint64)
            for k in range(width):
                acc += h[k : k + m] * (_MULT[k % 5] + U(2 * k))
            full = row[:m] == row[width - 1 :]
            out_row, out = row[:m][full], mix(acc[full])
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            acc = count[short].astype(np.uint64) * U(0x2545F4914F6CDD1D)
            for k in range(width - 1):
                has = count[short] > k
                acc[has] += h[first[short[has]] + k] * (_MULT[k % 5] + U(2 * k))
            out_row, out = np.concatenate((out_row, short)), np.concatenate((out, mix(acc)))
            order = np.argsort(out_row, kind="stable")
            out_row, out = out_row[order], out[order]
    return out_row, out
