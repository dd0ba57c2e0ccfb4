"""Definitions of state graphs: a central state, and generators that lead from each state to its neighbours."""

from __future__ import annotations

import enum
from collections.abc import Sequence
from dataclasses import dataclass, replace
from fractions import Fraction

from orbita.functions import perm


class Kind(enum.Enum):
    PERMUTATION = "permutation"
    MATRIX = "matrix"


@dataclass(frozen=True)
class Matrix:
    """A square integer matrix that multiplies states from the left, modulo ``modulo``, or without one if that is 0."""

    rows: tuple[tuple[int, ...], ...]
    modulo: int = 0

    @staticmethod
    def of(rows: Sequence[Sequence[int]], modulo: int = 0) -> Matrix:
        if modulo and not 2 <= modulo <= 2**31:
            raise ValueError("modulo must be 0, or from 2 to 2**31")
        out = tuple(tuple(x % modulo if modulo else x for x in r) for r in map(lambda r: [int(v) for v in r], rows))
        if any(len(r) != len(out) for r in out):
            raise ValueError("generators must be square matrices")
        return Matrix(out, modulo)

    @property
    def n(self) -> int:
        return len(self.rows)

    def times(self, other: Sequence[Sequence[int]]) -> list[list[int]]:
        out = [[sum(a * b for a, b in zip(r, c, strict=True)) for c in zip(*other, strict=True)] for r in self.rows]
        return [[x % self.modulo for x in r] for r in out] if self.modulo else out

    def is_inverse_of(self, other: Matrix) -> bool:
        one = [[int(i == j) for j in range(self.n)] for i in range(self.n)]
        return self.modulo == other.modulo and self.n == other.n and self.times(other.rows) == one and other.times(self.rows) == one

    def inverse(self) -> Matrix:
        """By exact elimination; ValueError if there's no integer inverse."""
        n, m = self.n, self.modulo
        rows = [[Fraction(x) if not m else x % m for x in r] + [int(i == j) for j in range(n)] for i, r in enumerate(self.rows)]
        for c in range(n):
            for k in range(c, n):
                try:
                    inv = pow(rows[k][c], -1, m) if m else 1 / rows[k][c]
                    break
                except (ValueError, ZeroDivisionError):
                    continue
            else:
                return self._inverse_by_adjugate()
            rows[c], rows[k] = rows[k], rows[c]
            rows[c] = [x * inv % m if m else x * inv for x in rows[c]]
            for k in range(n):
                if k != c and rows[k][c]:
                    f = rows[k][c]
                    rows[k] = [(x - f * y) % m if m else x - f * y for x, y in zip(rows[k], rows[c], strict=True)]
        out = [r[n:] for r in rows]
        if not m and any(Fraction(x).denominator != 1 for r in out for x in r):
            raise ValueError("the matrix has no integer inverse")
        return Matrix.of(out, m)

    def _inverse_by_adjugate(self) -> Matrix:
        def det(a: list[list[int]]) -> int:
            return a[0][0] if len(a) == 1 else sum((-1) ** j * a[0][j] * det([r[:j] + r[j + 1 :] for r in a[1:]]) for j in range(len(a)) if a[0][j])

        a, n, m = [list(r) for r in self.rows], self.n, self.modulo
        d = det(a)
        if not m and d not in (1, -1):
            raise ValueError("the matrix has no integer inverse")
        try:
            inv = pow(d, -1, m) if m else d
        except ValueError as e:
            raise ValueError("the matrix has no inverse") from e
        cof = [[(-1) ** (i + j) * (det([r[:i] + r[i + 1 :] for k, r in enumerate(a) if k != j]) if n > 1 else 1) * inv for j in range(n)] for i in range(n)]
        return Matrix.of(cof, m)


def flat_state(state: Sequence | str) -> tuple[int, ...]:
    """A list, nested lists or a string of digits as one tuple of ints."""
    if isinstance(state, str):
        return tuple(map(int, state))
    out: list[int] = []
    for x in state:
        out.extend(flat_state(x) if hasattr(x, "__len__") else [int(x)])
    return tuple(out)


@dataclass(frozen=True)
class GraphDef:
    """An implicit graph. Permutations act on places, matrices from the left on n x m matrices kept row by row."""

    generators: tuple
    names: tuple[str, ...]
    central: tuple[int, ...]
    name: str = ""

    @staticmethod
    def permutations(generators: Sequence[Sequence[int]], names: Sequence[str] | None = None, central: Sequence | str | None = None, name: str = "") -> GraphDef:
        gens = tuple(tuple(map(int, g)) for g in generators)
        if not gens or any(not perm.is_permutation(g) or len(g) != len(gens[0]) for g in gens):
            raise ValueError("generators must be permutations of one length")
        n = len(gens[0])
        state = tuple(range(n)) if central is None else flat_state(central)
        if len(state) != n or min(state, default=0) < 0 or max(state, default=0) >= max(n, 1):
            raise ValueError("the central state must have the generators' length and values of 0..n-1")
        return GraphDef(gens, GraphDef._names(gens, names, lambda g: ",".join(map(str, g))), state, name)

    @staticmethod
    def matrices(generators: Sequence[Matrix], names: Sequence[str] | None = None, central: Sequence | None = None, name: str = "") -> GraphDef:
        gens = tuple(generators)
        if not gens or any((g.n, g.modulo) != (gens[0].n, gens[0].modulo) for g in gens):
            raise ValueError("generators must be matrices of one size and modulo")
        n = gens[0].n
        state = tuple(int(i == j) for i in range(n) for j in range(n)) if central is None else flat_state(central)
        if not state or len(state) % n:
            raise ValueError("the central state must have as many rows as the generators")
        return GraphDef(gens, GraphDef._names(gens, names, lambda g: "g"), state, name)

    @staticmethod
    def _names(gens: tuple, names: Sequence[str] | None, make) -> tuple[str, ...]:
        out = tuple(names) if names is not None else tuple(make(g) if not isinstance(g, Matrix) else f"g{k}" for k, g in enumerate(gens))
        if len(out) != len(gens):
            raise ValueError("there must be a name for each generator")
        return out

    @property
    def kind(self) -> Kind:
        return Kind.MATRIX if isinstance(self.generators[0], Matrix) else Kind.PERMUTATION

    @property
    def state_size(self) -> int:
        return len(self.central)

    @property
    def n_generators(self) -> int:
        return len(self.generators)

    @property
    def state_shape(self) -> tuple[int, ...]:
        return (self.state_size,) if self.kind is Kind.PERMUTATION else (self.generators[0].n, self.state_size // self.generators[0].n)

    def inverse_map(self) -> list[int | None]:
        """For each generator the place of its inverse, or None."""
        if self.kind is Kind.MATRIX:
            return [next((k for k, h in enumerate(self.generators) if g.is_inverse_of(h)), None) for g in self.generators]
        at = {}
        for k, g in enumerate(self.generators):
            at.setdefault(g, k)
        return [at.get(tuple(perm.inverse(g))) for g in self.generators]

    @property
    def inverse_closed(self) -> bool:
        return None not in self.inverse_map()

    def _inverse_of(self, g):
        return g.inverse() if isinstance(g, Matrix) else tuple(perm.inverse(g))

    def make_inverse_closed(self) -> GraphDef:
        """Adds the inverses that are missing, named with an apostrophe."""
        missing = [k for k, i in enumerate(self.inverse_map()) if i is None]
        if not missing:
            return self
        more, names = [], []
        for k in missing:
            g = self._inverse_of(self.generators[k])
            if g not in more:
                more.append(g)
                names.append(self.names[k] + "'")
        return GraphDef((*self.generators, *more), (*self.names, *names), self.central, self.name and self.name + "-ic")

    def inverted(self) -> GraphDef:
        """All generators replaced by their inverses, in order."""
        gens = tuple(self._inverse_of(g) for g in self.generators)
        return GraphDef(gens, GraphDef._names(gens, None, lambda g: ",".join(map(str, g))), self.central)

    def with_central(self, state: Sequence | str) -> GraphDef:
        if self.kind is Kind.MATRIX:
            return GraphDef.matrices(self.generators, self.names, state, self.name)
        return GraphDef.permutations(self.generators, self.names, state, self.name)

    def with_name(self, name: str) -> GraphDef:
        return replace(self, name=name)

    def apply(self, k: int, state: Sequence[int]) -> tuple[int, ...]:
        """One generator applied to one state."""
        g = self.generators[k]
        if isinstance(g, Matrix):
            m = self.state_shape[1]
            return flat_state(g.times([list(state[i * m : (i + 1) * m]) for i in range(g.n)]))
        return tuple(state[i] for i in g)

    def apply_path(self, state: Sequence[int] | str, path: Sequence[int]) -> tuple[int, ...]:
        out = flat_state(state)
        for k in path:
            if not 0 <= k < self.n_generators:
                raise ValueError(f"no generator {k}")
            out = self.apply(k, out)
        return out

    def path_states(self, state: Sequence[int] | str, path: Sequence[int]) -> list[tuple[int, ...]]:
        out = [flat_state(state)]
        for k in path:
            out.append(self.apply(k, out[-1]))
        return out

    def validate_path(self, state: Sequence[int] | str, path: Sequence[int]) -> bool:
        return self.apply_path(state, path) == self.central

    def path_to_string(self, path: Sequence[int]) -> str:
        return ".".join(self.names[k] for k in path)

    def revert_path(self, path: Sequence[int]) -> list[int]:
        """The path back; the generators must be closed under inverses."""
        inv = self.inverse_map()
        if None in inv:
            raise ValueError("the generators aren't closed under inverses")
        return [inv[k] for k in reversed(path)]

    @property
    def element_bits(self) -> int:
        """Bits that an element of a state takes when packed."""
        return max(1, max(self.central, default=0).bit_length())


def create_graph(
    *,
    generators_permutations: Sequence[Sequence[int]] | None = None,
    generators_matrices: Sequence[Matrix] | None = None,
    name: str = "",
    generator_names: Sequence[str] | None = None,
    central_state: Sequence | str | None = None,
    make_inverse_closed: bool = False,
    **options,
) -> GraphDef:
    """A graph from one source: permutations, matrices, or the codename of a known family. Unknown options are errors."""
    if generators_permutations is not None and generators_matrices is not None:
        raise ValueError("give permutations or matrices, not both")
    if generators_permutations is not None:
        out = GraphDef.permutations(generators_permutations, generator_names, central_state, name)
    elif generators_matrices is not None:
        out = GraphDef.matrices(generators_matrices, generator_names, central_state, name)
    else:
        if not name:
            raise ValueError("give generators or a name")
        from orbita.plans.library import prepare_graph

        out = prepare_graph(name, **options)
        options = {}
        if central_state is not None:
            out = out.with_central(central_state)
    if options:
        raise ValueError(f"unknown options: {sorted(options)}")
    return out.make_inverse_closed() if make_inverse_closed else out
