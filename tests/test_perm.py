from __future__ import annotations

import itertools
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from orbita.functions import perm

perms = st.integers(1, 9).flatmap(lambda n: st.permutations(range(n)))


@given(perms)
def test_inverse_and_rank(p):
    assert perm.compose(p, perm.inverse(p)) == perm.identity(len(p))
    assert perm.unrank(perm.rank(p), len(p)) == list(p)
    assert perm.apply(p, perm.identity(len(p))) == list(p)


def test_from_cycles():
    assert perm.from_cycles(5, [[0, 1, 2]]) == [1, 2, 0, 3, 4]
    assert perm.from_cycles(3, [[1, 2]], offset=1) == [1, 0, 2]
    with pytest.raises(ValueError):
        perm.from_cycles(4, [[0, 1], [1, 2]])


def test_cycle_types():
    assert list(perm.by_cycle_type(4, [2, 2])) == [[1, 0, 3, 2], [2, 3, 0, 1], [3, 2, 1, 0]]
    for lengths in ([3], [2, 2], [2, 3], [1, 1, 2], [5]):
        got = [tuple(p) for p in perm.by_cycle_type(5, lengths)]
        want = {p for p in itertools.permutations(range(5)) if _type(p) == sorted([x for x in lengths if x > 1])}
        assert len(got) == len(set(got)) and set(got) == want


def _type(p):
    seen, out = set(), []
    for i in range(len(p)):
        n = 0
        while i not in seen:
            seen.add(i)
            i = p[i]
            n += 1
        if n > 1:
            out.append(n)
    return sorted(out)


def test_closed_forms():
    assert perm.stirling_growth(6) == [1, 15, 85, 225, 274, 120]
    assert sum(perm.stirling_growth(30)) == math.factorial(30)
    assert perm.mahonian_growth(4) == [1, 3, 5, 6, 5, 3, 1]
    assert sum(perm.mahonian_growth(9)) == math.factorial(9)
