"""Permutations as lists of 0..n-1, on the driver. ``apply``: place i of the result takes what stood at ``p[i]``."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator, Sequence


def identity(n: int) -> list[int]:
    return list(range(n))


def apply(p: Sequence[int], x: Sequence) -> list:
    return [x[i] for i in p]


def compose(first: Sequence[int], second: Sequence[int]) -> list[int]:
    """Maps i to ``second[first[i]]``."""
    return [second[i] for i in first]


def inverse(p: Sequence[int]) -> list[int]:
    return sorted(range(len(p)), key=p.__getitem__)


def is_permutation(p: Sequence[int]) -> bool:
    return sorted(p) == list(range(len(p)))


def transposition(n: int, i: int, j: int) -> list[int]:
    if not (0 <= i < n and 0 <= j < n and i != j):
        raise ValueError("a transposition takes two places of 0..n-1")
    return from_cycles(n, [[i, j]])


def from_cycles(n: int, cycles: Sequence[Sequence[int]], offset: int = 0) -> list[int]:
    """Each cycle sends an element to the next one. Cycles must be disjoint; their numbers start at ``offset``."""
    out = identity(n)
    for cycle in cycles:
        for a, b in zip(cycle, [*cycle[1:], cycle[0]], strict=True):
            if out[a - offset] != a - offset:
                raise ValueError("cycles share an element")
            out[a - offset] = b - offset
    if not is_permutation(out):
        raise ValueError("cycles share an element")
    return out


def rotation(n: int, by: int = 1) -> list[int]:
    return [(i + by) % n for i in range(n)]


def reversal(n: int, i: int, j: int) -> list[int]:
    """Reverses places i..j."""
    return [*range(i), *range(j, i - 1, -1), *range(j + 1, n)]


def power(p: Sequence[int], k: int) -> list[int]:
    out = identity(len(p))
    for _ in range(k):
        out = compose(out, p)
    return out


def by_cycle_type(n: int, lengths: Sequence[int]) -> Iterator[list[int]]:
    """All permutations of n points with these cycle lengths, each once: cycles by ascending length, equal lengths by ascending least elements."""
    sizes = sorted(x for x in lengths if x > 1)
    if any(x < 1 for x in lengths) or sum(lengths) > n:
        raise ValueError("cycle lengths must be positive and sum to n at most")

    def extend(k: int, free: list[int], least: int, out: list[int]) -> Iterator[list[int]]:
        if k == len(sizes):
            yield out
            return
        size = sizes[k]
        for head in free:
            if k and sizes[k - 1] == size and head < least:
                continue
            for rest in itertools.permutations([x for x in free if x > head], size - 1):
                cycle = [head, *rest]
                new = list(out)
                for a, b in zip(cycle, [*rest, head], strict=True):
                    new[a] = b
                yield from extend(k + 1, [x for x in free if x not in cycle], head, new)

    yield from extend(0, list(range(n)), -1, identity(n))


def of_partition(lengths: Sequence[int], shuffled: bool = False, seed: int | None = None) -> list[int]:
    """One permutation with these cycle lengths: over consecutive elements, or over shuffled ones."""
    n = sum(lengths)
    points = identity(n)
    if shuffled:
        random.Random(seed).shuffle(points)
    it = iter(points)
    return from_cycles(n, [[next(it) for _ in range(k)] for k in lengths])


def rank(p: Sequence[int]) -> int:
    """Place in lexicographic order."""
    return sum(sum(y < x for y in p[k + 1 :]) * math.factorial(len(p) - 1 - k) for k, x in enumerate(p))


def unrank(r: int, n: int) -> list[int]:
    left, out = identity(n), []
    for k in range(n - 1, -1, -1):
        d, r = divmod(r, math.factorial(k))
        out.append(left.pop(d))
    return out


def stirling_growth(n: int) -> list[int]:
    """Permutations of n by least number of transpositions: unsigned Stirling numbers, most cycles first."""
    row = [1]
    for m in range(1, n):
        row = [a + m * b for a, b in zip([*row, 0], [0, *row], strict=True)]
    return row


def mahonian_growth(n: int) -> list[int]:
    """Permutations of n by number of inversions."""
    row = [1]
    for m in range(2, n + 1):
        row = [sum(row[max(0, k - m + 1) : k + 1]) for k in range(len(row) + m - 1)]
    return row
