"""Known families of generators. Each function gives a :class:`GraphDef`; ``prepare_graph`` finds one by codename."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Mapping, Sequence

from orbita.functions import perm
from orbita.plans.definition import GraphDef, Matrix


def _graph(gens: Sequence[Sequence[int]], names: Sequence[str], name: str = "") -> GraphDef:
    return GraphDef.permutations(gens, names, name=name)


def _cycle(n: int, points: Sequence[int]) -> list[int]:
    return perm.from_cycles(n, [points])


def _label(points: Sequence[int]) -> str:
    return "(" + ",".join(map(str, points)) + ")"


def all_transpositions(n: int) -> GraphDef:
    pairs = list(itertools.combinations(range(n), 2))
    return _graph([perm.transposition(n, *p) for p in pairs], [_label(p) for p in pairs])


def _swapped(n: int, i: int, j: int, k: int, m: int) -> list[int]:
    """Exchanges places i..j-1 and k..m-1."""
    x = list(range(n))
    return x[:i] + x[k:m] + x[j:k] + x[i:j] + x[m:]


def transposons(n: int) -> GraphDef:
    cuts = list(itertools.combinations(range(n + 1), 3))
    return _graph([_swapped(n, i, j, j, k) for i, j, k in cuts], [f"T[{i}..{j - 1},{k - 1}]" for i, j, k in cuts])


def block_interchange(n: int) -> GraphDef:
    cuts = [(i, j, k, m) for i, j, k, m in itertools.combinations_with_replacement(range(n + 1), 4) if i < j <= k < m]
    return _graph([_swapped(n, *c) for c in cuts], [f"I[{i}..{j - 1},{k}..{m - 1}]" for i, j, k, m in cuts])


def full_reversals(n: int) -> GraphDef:
    ends = list(itertools.combinations(range(n), 2))
    return _graph([perm.reversal(n, i, j) for i, j in ends], [f"R[{i}..{j}]" for i, j in ends])


def signed_reversals(n: int) -> GraphDef:
    """Point i is the front of element i, point n + i its back; a reversal turns each element over."""
    gens, names = [], []
    for i in range(n):
        for j in range(i, n):
            g = perm.identity(2 * n)
            for x in range(i, j + 1):
                g[x], g[n + x] = n + i + j - x, i + j - x
            gens.append(g)
            names.append(f"R[{i}..{j}]")
    return _graph(gens, names)


def lrx(n: int, k: int = 1) -> GraphDef:
    return _graph([perm.rotation(n), perm.rotation(n, -1), perm.transposition(n, 0, k)], ["L", "R", "X"], f"lrx-{n}" + (f"(k={k})" if k != 1 else ""))


def lx(n: int) -> GraphDef:
    return _graph([perm.rotation(n), perm.transposition(n, 0, 1)], ["L", "X"], f"lx-{n}")


def top_spin(n: int, k: int = 4) -> GraphDef:
    return _graph([perm.rotation(n), perm.rotation(n, -1), perm.reversal(n, 0, k - 1)], ["L", "R", "X"], f"top_spin-{n}-{k}")


def coxeter(n: int) -> GraphDef:
    return _graph([perm.transposition(n, k, k + 1) for k in range(n - 1)], [f"({k},{k + 1})" for k in range(n - 1)], f"coxeter-{n}")


def cyclic_coxeter(n: int) -> GraphDef:
    pairs = [(k, k + 1) for k in range(n - 1)] + ([(0, n - 1)] if n > 2 else [])
    return _graph([perm.transposition(n, *p) for p in pairs], [_label(p) for p in pairs], f"cyclic_coxeter-{n}")


def pancake(n: int) -> GraphDef:
    return _graph([perm.reversal(n, 0, k) for k in range(1, n)], [f"R{k}" for k in range(1, n)], f"pancake-{n}")


#: Lengths of the reversed prefixes of the seven cubic pancake graphs, as distances from n or plain.
_CUBIC: dict[int, Callable[[int], tuple[int, ...]]] = {
    1: lambda n: (n, n - 1, 2),
    2: lambda n: (n, n - 1, 3),
    3: lambda n: (n, n - 1, n - 2),
    4: lambda n: (n, n - 1, n - 3),
    5: lambda n: (n, n - 2, 2),
    6: lambda n: (n, n - 2, 3),
    7: lambda n: (n, n - 2, n - 3),
}


def cubic_pancake(n: int, subset: int) -> GraphDef:
    if subset not in _CUBIC:
        raise ValueError("subset must be from 1 to 7")
    sizes = _CUBIC[subset](n)
    return _graph([perm.reversal(n, 0, k - 1) for k in sizes], [f"R{k}" for k in sizes], f"cubic_pancake-{n}-{subset}")


def burnt_pancake(n: int) -> GraphDef:
    gens = []
    for k in range(n):
        g = perm.identity(2 * n)
        for x in range(k + 1):
            g[x], g[n + x] = n + k - x, k - x
        gens.append(g)
    return _graph(gens, [f"R{k + 1}" for k in range(n)], f"burnt_pancake-{n}")


def three_cycles(n: int) -> GraphDef:
    cs = [c for c in itertools.permutations(range(n), 3) if c[0] == min(c)]
    return _graph([_cycle(n, c) for c in cs], [_label(c) for c in cs], f"three_cycles-{n}")


def three_cycles_0ij(n: int) -> GraphDef:
    cs = [(0, i, j) for i, j in itertools.permutations(range(1, n), 2)]
    return _graph([_cycle(n, c) for c in cs], [_label(c) for c in cs], f"three_cycles_0ij-{n}")


def three_cycles_01i(n: int, add_inverses: bool = True) -> GraphDef:
    gens, names = [], []
    for i in range(2, n):
        for c in ((0, 1, i), (1, 0, i))[: 1 + add_inverses]:
            gens.append(_cycle(n, c))
            names.append(_label(c))
    return _graph(gens, names, f"three_cycles_01i-{n}" + "-ic" * add_inverses)


def derangements(n: int) -> GraphDef:
    ps = [p for p in itertools.permutations(range(n)) if all(i != x for i, x in enumerate(p))]
    return _graph(ps, [f"D{k}" for k in range(len(ps))], f"derangements-{n}")


def involutive_derangements(n: int) -> GraphDef:
    if n % 2:
        raise ValueError("n must be even")
    ps = list(perm.by_cycle_type(n, [2] * (n // 2)))
    return _graph(ps, [f"D{k}" for k in range(len(ps))], f"involutive_derangements-{n}")


def stars(n: int) -> GraphDef:
    return _graph([perm.transposition(n, 0, i) for i in range(1, n)], [f"(0,{i})" for i in range(1, n)], f"stars-{n}")


def generalized_stars(n: int, k: int = 1) -> GraphDef:
    if not 1 <= k < n:
        raise ValueError("k must be from 1 to n - 1")
    pairs = list(itertools.product(range(k), range(k, n)))
    return _graph([perm.transposition(n, *p) for p in pairs], [_label(p) for p in pairs], f"generalized_stars-{n}-{k}")


def _swaps(n: int, first: int, count: int | None = None) -> list[list[int]]:
    return [[i, i + 1] for i in range(first, n - 1, 2)][:count]


def rapaport_m1(n: int) -> GraphDef:
    gens, names = [], []
    for first in (0, 1):
        for k in range(1, len(_swaps(n, first)) + 1):
            gens.append(perm.from_cycles(n, _swaps(n, first, k)))
            names.append(f"M1_{first}_{k}")
    return _graph(gens, names, f"rapaport_m1-{n}")


def rapaport_m2(n: int) -> GraphDef:
    cycles = [[[0, 1]], _swaps(n, 0), _swaps(n, 1)]
    return _graph([perm.from_cycles(n, c) for c in cycles], ["M2_0", "M2_1", "M2_2"], f"rapaport_m2-{n}")


def all_cycles(n: int) -> GraphDef:
    cs = [c for k in range(2, n + 1) for c in itertools.permutations(range(n), k) if c[0] == min(c)]
    return _graph([_cycle(n, c) for c in cs], [_label(c) for c in cs], f"all_cycles-{n}")


def lsl_cycles(n: int, add_inverses: bool = True) -> GraphDef:
    long, short = _cycle(n, range(n)), _cycle(n, range(n - 1))
    gens, names = [long, short], ["L", "S"]
    if add_inverses:
        gens, names = [*gens, perm.inverse(long), perm.inverse(short)], [*names, "L'", "S'"]
    return _graph(gens, names, f"lsl_cycles-{n}" + "-ic" * add_inverses)


def _distinct(n: int, cycles: Sequence[Sequence[int]], name: str) -> GraphDef:
    return _graph([_cycle(n, c) for c in cycles], [_label(c) for c in cycles], name)


def wrapped_k_cycles(n: int, k: int) -> GraphDef:
    return _distinct(n, [[(i + j) % n for j in range(k)] for i in range(n)], f"wrapped_k_cycles-{n}-{k}")


def larx(n: int) -> GraphDef:
    return _graph([perm.transposition(n, 0, 1), _cycle(n, range(1, n))], ["X", "L"], f"larx-{n}")


def increasing_k_cycles(n: int, k: int) -> GraphDef:
    return _distinct(n, list(itertools.combinations(range(n), k)), f"increasing_k_cycles-{n}-{k}")


def consecutive_k_cycles(n: int, k: int) -> GraphDef:
    return _distinct(n, [range(i, i + k) for i in range(n - k + 1)], f"consecutive_k_cycles-{n}-{k}")


def down_cycles(n: int) -> GraphDef:
    return _distinct(n, [range(i, j + 1) for i, j in itertools.combinations(range(n), 2)], f"down_cycles-{n}")


def prefix_cycles(n: int) -> GraphDef:
    return _distinct(n, [range(j) for j in range(2, n + 1)], f"prefix_cycles-{n}")


def sheveleva2(n: int, k: int) -> GraphDef:
    """Alternating adjacent swaps, with a 4-cycle at k - 1 in place of those that it meets; what follows stays alternate."""
    if not 1 <= k <= n - 3:
        raise ValueError("k must be from 1 to n - 3")
    four = [k - 1, k, k + 1, k + 2]
    own = [c for c in _swaps(n, (k - 1) % 2) if not set(c) & set(four)]
    other = [c for c in _swaps(n, k % 2) if not set(c) & {k, k + 1, k + 2, k + 3}]
    if k + 3 < n:
        other.append([k + 1, k + 3])
    return _graph([perm.from_cycles(n, other), perm.from_cycles(n, [*own, four])], ["A", "S"], f"sheveleva2-n{n}-k{k}")


def koltsov3(n: int, perm_type: int = 2, k: int = 1, d: int = 1) -> GraphDef:
    if perm_type not in (1, 2) or k + (d if perm_type == 1 else 3) >= n:
        raise ValueError("unknown type, or places beyond n")
    swap = [[k, k + d]] if perm_type == 1 else [[k, k + 3], [k + 1, k + 2]]
    return _graph([perm.from_cycles(n, c) for c in (_swaps(n, 0), _swaps(n, 1), swap)], ["I", "K", "S"], f"koltsov3-n{n}-k{k}")


def conjugacy_classes(n: int, classes: Mapping[Sequence[int], int | None], seed: int | None = None) -> GraphDef:
    """All permutations of each cycle type, or a random selection of so many."""
    gens: list[list[int]] = []
    rng = random.Random(seed)
    for lengths, count in classes.items():
        if count is None:
            gens += perm.by_cycle_type(n, lengths)
        else:
            full = [*lengths, *[1] * (n - sum(lengths))]
            seen: set[tuple[int, ...]] = set()
            total = math.factorial(n) // math.prod(full) // math.prod(math.factorial(full.count(x)) for x in set(full))
            if count > total:
                raise ValueError(f"there are only {total} permutations of type {lengths}")
            while len(seen) < count:
                seen.add(tuple(perm.of_partition(full, True, rng.randrange(1 << 60))))
            gens += map(list, sorted(seen))
    return _graph(gens, [f"g{k}" for k in range(len(gens))], f"conjugacy_classes-{n}")


def rand_generators(n: int, k: int, seed: int | None = None) -> GraphDef:
    if k > math.factorial(n):
        raise ValueError("there aren't so many permutations")
    rng, seen = random.Random(seed), {}
    while len(seen) < k:
        seen[tuple(rng.sample(range(n), n))] = None
    return _graph(list(seen), [f"g{i}" for i in range(k)], f"rand_generators-{n}-{k}")


def heisenberg(n: int = 3, modulo: int = 0, add_inverses: bool = True) -> GraphDef:
    if n < 3:
        raise ValueError("n must be 3 at least")
    gens, names = [], []
    for letter, at in (("x", lambda i: (0, i)), ("y", lambda i: (i, n - 1))):
        for i in range(1, n - 1):
            gens.append(_elementary(n, *at(i), modulo))
            names.append(letter if n == 3 else f"{letter}{i}")
    out = GraphDef.matrices(gens, names, name=f"heisenberg-{n}" + (f"%{modulo}" if modulo else ""))
    return out.make_inverse_closed() if add_inverses else out


def _elementary(n: int, row: int, col: int, modulo: int) -> Matrix:
    return Matrix.of([[int(i == j or (i, j) == (row, col)) for j in range(n)] for i in range(n)], modulo)


def sl_fundamental_roots(n: int, modulo: int = 0) -> GraphDef:
    gens, names = [], []
    for k in range(n - 1):
        for letter, at in (("e", (k, k + 1)), ("f", (k + 1, k))):
            g = _elementary(n, *at, modulo)
            gens += [g, g.inverse()]
            names += [f"{letter}{k + 1}", f"{letter}{k + 1}'"]
    return GraphDef.matrices(gens, names, name=f"sl_fund_roots-{n}" + (f"%{modulo}" if modulo else ""))


def sl_root_weyl(n: int, modulo: int = 0) -> GraphDef:
    e = _elementary(n, 0, 1, modulo)
    rows = [[int(j == i + 1) for j in range(n)] for i in range(n)]
    rows[n - 1][0] = (-1) ** (n - 1)
    w = Matrix.of(rows, modulo)
    return GraphDef.matrices([e, e.inverse(), w, w.inverse()], ["e", "e'", "w", "w'"], name=f"sl_root_weyl-{n}" + (f"%{modulo}" if modulo else ""))


FAMILIES: dict[str, Callable[..., GraphDef]] = {
    f.__name__: f
    for f in (
        all_transpositions, transposons, block_interchange, full_reversals, signed_reversals, lrx, lx, top_spin, coxeter, cyclic_coxeter, pancake,
        cubic_pancake, burnt_pancake, three_cycles, three_cycles_0ij, three_cycles_01i, derangements, involutive_derangements, stars,
        generalized_stars, rapaport_m1, rapaport_m2, all_cycles, lsl_cycles, wrapped_k_cycles, larx, increasing_k_cycles, sheveleva2, koltsov3,
        consecutive_k_cycles, conjugacy_classes, rand_generators, down_cycles, prefix_cycles,
    )
}
MATRIX_FAMILIES: dict[str, Callable[..., GraphDef]] = {f.__name__: f for f in (heisenberg, sl_fundamental_roots, sl_root_weyl)}


def prepare_graph(name: str, n: int = 0, **options) -> GraphDef:
    """A family by its codename: a family's own name with ``n``, ``lrx-12`` and ``lx-12``, or a puzzle's. ValueError for unknown names.

    ``lx-<n>`` gives the graph of two generators that it names.
    """
    from orbita.plans import puzzles

    known = {"01i": three_cycles_01i, "conjugacy_class": conjugacy_classes}
    cubes = {"cube_2/2/2_6gensQTM": (2, "fixed_QTM"), "cube_2/2/2_9gensHTM": (2, "fixed_HTM"), "cube_3/3/3_12gensQTM": (3, "QTM"), "cube_3/3/3_18gensHTM": (3, "HTM")}
    if name in cubes:
        return puzzles.rubik_cube(*cubes[name])
    if name == "hungarian_rings":
        return puzzles.hungarian_rings(*puzzles.rings_for(n))
    if name in puzzles.NAMED:
        return puzzles.NAMED[name]()
    for family in ("lrx", "lx"):
        if name.startswith(family + "-"):
            return FAMILIES[family](int(name[len(family) + 1 :]))
    f = known.get(name) or FAMILIES.get(name)
    if f is None:
        raise ValueError(f"unknown generator set: {name}")
    return f(n, **options)
