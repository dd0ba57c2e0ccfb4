"""Generators, encodings and scores as DataFrame columns: literal indexes and masks, which whole-stage codegen compiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbita.plans.definition import GraphDef, Kind, Matrix

#: States with more elements than this are permuted by a transform over a literal index list, as spelt-out arrays outgrow a method.
MOST_INLINE = 200


def literal_state(state: Sequence[int]) -> Column:
    return F.array(*(F.lit(int(x)).cast("bigint") for x in state)) if len(state) else F.array().cast("array<bigint>")


def permuted(p: Sequence[int], state: Column) -> Column:
    """``state`` with place i taken from place p[i]."""
    if len(p) <= MOST_INLINE:
        return F.array(*(F.get(state, F.lit(i)) for i in p))
    return F.transform(F.array(*(F.lit(i) for i in p)), lambda i: F.get(state, i))


def multiplied(m: Matrix, columns: int, state: Column) -> Column:
    """The matrix times a state of as many rows, modulo its modulus. Products are reduced one by one, so 2**31 is safe."""
    out = []
    for row in m.rows:
        for c in range(columns):
            terms = [(F.lit(a).cast("bigint") * F.get(state, F.lit(k * columns + c)) if a != 1 else F.get(state, F.lit(k * columns + c))) for k, a in enumerate(row) if a]
            if m.modulo and len(terms) > 1:
                terms = [F.pmod(t, F.lit(m.modulo).cast("bigint")) for t in terms]
            total = terms[0] if terms else F.lit(0).cast("bigint")
            for t in terms[1:]:
                total = total + t
            out.append(F.pmod(total, F.lit(m.modulo).cast("bigint")) if m.modulo else total)
    return F.array(*out)


def applied(graph: GraphDef, k: int, state: Column) -> Column:
    g = graph.generators[k]
    return multiplied(g, graph.state_shape[1], state) if graph.kind is Kind.MATRIX else permuted(g, state)


def neighbours(graph: GraphDef, state: Column) -> Column:
    """All neighbours of a state, in order of the generators."""
    return F.array(*(applied(graph, k, state) for k in range(graph.n_generators)))


def along(graph: GraphDef, path: Sequence[int], state: Column) -> Column:
    """A fixed path, composed on the driver first where generators are permutations."""
    if graph.kind is Kind.PERMUTATION:
        whole = list(range(graph.state_size))
        for k in path:
            whole = [whole[i] for i in graph.generators[k]]
        return permuted(whole, state)
    for k in path:
        state = applied(graph, k, state)
    return state


def along_each(graph: GraphDef, path: Column, state: Column) -> Column:
    """A path that differs from row to row, for permutations."""
    table = F.array(*(F.array(*(F.lit(i) for i in g)) for g in graph.generators))
    return F.aggregate(path, state, lambda s, k: F.transform(F.get(table, k), lambda i: F.get(s, i)))


def packed(state: Column, bits: int, n: int) -> list[Column]:
    """A state of n elements as 64-bit words, ``bits`` of each element; an element may lie in two words."""
    words = []
    for w in range((n * bits + 63) // 64):
        parts = []
        for i in range(n):
            at = i * bits - 64 * w
            if -bits < at < 64:
                x = F.get(state, F.lit(i)).cast("bigint")
                parts.append(F.shiftleft(x, at) if at >= 0 else F.shiftrightunsigned(x, -at))
        word = parts[0]
        for p in parts[1:]:
            word = word.bitwiseOR(p)
        words.append(word)
    return words


def unpacked(words: Sequence[Column], bits: int, n: int) -> Column:
    mask = F.lit((1 << bits) - 1).cast("bigint")
    out = []
    for i in range(n):
        w, at = divmod(i * bits, 64)
        x = F.shiftrightunsigned(words[w], at)
        if at + bits > 64:
            x = x.bitwiseOR(F.shiftleft(words[w + 1], 64 - at))
        out.append(x.bitwiseAND(mask))
    return F.array(*out)


def permuted_packed(p: Sequence[int], words: Sequence[Column], bits: int) -> list[Column]:
    """A permutation of packed states: bits that move equally far between the same words move together under one mask."""
    n = len(p)
    moves: dict[tuple[int, int, int], int] = {}
    for i, src in enumerate(p):
        for b in range(bits):
            (ws, bs), (wd, bd) = divmod(src * bits + b, 64), divmod(i * bits + b, 64)
            moves[ws, wd, bd - bs] = moves.get((ws, wd, bd - bs), 0) | 1 << bs
    out: list[Column | None] = [None] * ((n * bits + 63) // 64)
    for (ws, wd, shift), mask in sorted(moves.items()):
        x = words[ws].bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint"))
        x = F.shiftleft(x, shift) if shift > 0 else F.shiftrightunsigned(x, -shift) if shift < 0 else x
        out[wd] = x if out[wd] is None else out[wd].bitwiseOR(x)
    return [x for x in out if x is not None]


def hamming(state: Column, other: Column) -> Column:
    """Number of places that differ."""
    return F.aggregate(F.zip_with(state, other, lambda a, b: F.when(a != b, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)


def named(state: Column) -> Column:
    """A state as text: digits together, or with commas if one exceeds 9."""
    return F.when(F.array_max(state) <= 9, F.array_join(state.cast("array<string>"), "")).otherwise(F.array_join(state.cast("array<string>"), ","))


def is_permutation(state: Column) -> Column:
    return F.array_sort(state) == F.sequence(F.lit(0).cast("bigint"), (F.size(state) - 1).cast("bigint"))


def inverse(state: Column) -> Column:
    return F.transform(F.sequence(F.lit(0).cast("bigint"), (F.size(state) - 1).cast("bigint")), lambda i: F.array_position(state, i) - 1)


def composed(first: Column, second: Column) -> Column:
    return F.transform(first, lambda i: F.get(second, i))


def unranked(rank: Column, n: int) -> Column:
    """The permutation of n at a place of lexicographic order."""
    start = F.struct(rank.cast("bigint").alias("r"), F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")).alias("left"), F.array().cast("array<bigint>").alias("out"))
    factorials = F.array(*(F.factorial(F.lit(k)) for k in range(n - 1, -1, -1)))

    def step(s: Column, f: Column) -> Column:
        x = F.get(s["left"], F.call_function("div", s["r"], f).cast("int"))
        return F.struct((s["r"] % f).alias("r"), F.array_remove(s["left"], x).alias("left"), F.array_append(s["out"], x).alias("out"))

    return F.aggregate(factorials, start, step, lambda s: s["out"])


def ranked(state: Column, n: int) -> Column:
    """A permutation's place in lexicographic order."""
    total = F.lit(0).cast("bigint")
    for i in range(n - 1):
        less = F.lit(0)
        for j in range(i + 1, n):
            less = less + F.when(F.get(state, F.lit(j)) < F.get(state, F.lit(i)), 1).otherwise(0)
        total = total + less * F.factorial(F.lit(n - 1 - i))
    return total
