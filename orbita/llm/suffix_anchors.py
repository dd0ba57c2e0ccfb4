"""Anchors: places that a text's bytes alone determine, close enough that every long repeat holds one at the same distance in all its copies."""

from __future__ import annotations

import numpy as np

from orbita.llm.bytes_np import mix, powers

#: Bytes of which an anchor is the least hash.
GRAM = 16


def cells(values: np.ndarray, begin: np.ndarray, length: int, core: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Splits the starts of all strings of ``length`` values in some texts into runs that have one anchor: row, first start, last start, anchor.

    ``values`` has 64 random bits for each byte, or word, and ``begin`` the texts' offsets in it. The anchor of a start is the place of the least gram hash (the first of equal ones) among
    those that leave ``core`` bytes from the anchor on inside the string, so equal strings have their anchors at equal distances.
    """
    n = len(values)
    span = length - core + 1
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z, z, z
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power[:n], out=total[1:])
    g = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    v = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    step = 1
    while 2 * step <= span:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    if span > step:
        v = np.minimum(v[: len(v) - (span - step)], v[span - step :])
    anchor = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)[: n - length + 1]
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[: n - length + 1]
    start = np.arange(n - length + 1)
    valid = start + length <= begin[1:][row]
    change = np.ones(len(start), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(valid & change)
    # a run ends before the next change, or where its text has no more whole string
    stop = np.flatnonzero(valid & np.append(change[1:] | ~valid[1:], True))
    return row[first], first, stop, anchor[first]
