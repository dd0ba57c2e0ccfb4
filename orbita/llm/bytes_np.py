"""Numpy kernels over the UTF-8 bytes of Arrow string columns; no Python object is made for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in groups of about so many bytes, which bounds memory; a longer text is a group of its own.
GROUP_BYTES = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Powers that a worker keeps; a longer text has its own, which go with it.
KEPT_POWERS = 4 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n + 1 of each."""
    held = _powers if n <= KEPT_POWERS else [_powers[0][:1], _powers[1][:1]]
    if len(held[0]) <= n:
        for k, base in enumerate((_B, _B_INV)):
            full = np.full(n + 1, base, np.uint64)
            full[0] = 1
            held[k] = np.cumprod(full, dtype=np.uint64)
    return held[0][: n + 1], held[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, rows + 1) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(offsets: np.ndarray, data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of anything but ASCII white space) of consecutive texts: row, start, end and a 64-bit hash of each.

    Start and end count bytes in ``data[offsets[0]:offsets[-1]]``.
    """
    b = data[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    n = len(b)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    inside = ~SPACE[b]
    first = np.zeros(n + 1, bool)
    first[at] = True  # a text starts here, so what precedes is another text
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | first[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | first[1:])) + 1
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[LOWER[b] if lower else b] * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.searchsorted(at, starts, "right") - 1, starts, ends, hashes


def shingles(row: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of k words of one text, in order."""
    n = len(row) - k + 1
    if n <= 0:
        return row[:0], hashes[:0]
    out = hashes[:n].copy()
    for j in range(1, k):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[j : n + j])
    whole = row[:n] == row[k - 1 :]
    return row[:n][whole], out[whole]


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text, words lower-cased in A-Z. A text of fewer words has one: all of them. None for no words."""
    row, _, _, hashes = words(offsets, data, lower=True)
    n = len(offsets) - 1
    per = np.bincount(row, minlength=n)
    at = np.concatenate(([0], np.cumsum(per)))
    srow, sh = shingles(row, hashes, k)
    sat = np.concatenate(([0], np.cumsum(np.bincount(srow, minlength=n))))
    out = []
    for i in range(n):
        if sat[i + 1] > sat[i]:
            out.append(np.unique(sh[sat[i] : sat[i + 1]]))
        elif per[i]:
            h = np.uint64(per[i])
            for x in hashes[at[i] : at[i + 1]]:
                h = mix(np.array([h], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + x)[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
