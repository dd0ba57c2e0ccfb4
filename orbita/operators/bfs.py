"""Breadth-first search: layers of states at equal distance.

A layer is expanded in one projection, deduplicated, and stripped of what came before. Layers of at most ``local_states`` states are kept as arrays on
the driver, whose size that bounds; the first larger one, and all after it, are DataFrames in the shared folder. There, states of permutation graphs are 64-bit words, as
few bits of them for each element as it needs (see :class:`Space`), so a layer shuffles 8 bytes a state where an array takes some hundreds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions.columns import applied, packed, permuted_packed, unpacked
from orbita.plans.definition import GraphDef, Kind, flat_state
from orbita.sources.storage import LayerStore

LOCAL_STATES = 1 << 16
SCHEMA = "state array<bigint>"
#: States of more words than this stay arrays.
MOST_WORDS = 8


class Space:
    """How states lie in the columns of a layer: words of packed elements for permutation graphs, else one array."""

    def __init__(self, graph: GraphDef, starts: np.ndarray):
        self.graph, self.n = graph, graph.state_size
        self.bits = max(graph.element_bits, int(starts.max()).bit_length())  # generators only move the elements of the start states
        words = -(-self.n * self.bits // 64)
        self.packed = graph.kind is Kind.PERMUTATION and words <= MOST_WORDS and starts.min() >= 0
        self.columns = [f"w{k}" for k in range(words)] if self.packed else ["state"]
        self.schema = ", ".join(f"{c} bigint" for c in self.columns) if self.packed else SCHEMA

    def inward(self, states: DataFrame) -> DataFrame:
        """Columns of this space from a column ``state`` of elements like the start states'; others stay."""
        if not self.packed:
            return states
        rest = [c for c in states.columns if c != "state"]
        return states.select(*rest, *(w.alias(c) for c, w in zip(self.columns, packed(F.col("state"), self.bits, self.n), strict=True)))

    def outward(self, rows: DataFrame) -> DataFrame:
        """A column ``state`` from those of this space; others stay."""
        if not self.packed:
            return rows
        rest = [c for c in rows.columns if c not in self.columns]
        return rows.select(*rest, unpacked([F.col(c) for c in self.columns], self.bits, self.n).alias("state"))

    def moved(self, k: int) -> list[Column]:
        """The columns after generator k."""
        if self.packed:
            return permuted_packed(self.graph.generators[k], [F.col(c) for c in self.columns], self.bits)
        return [applied(self.graph, k, F.col("state"))]

    def step(self, rows: DataFrame, undo: list[int] | None = None) -> DataFrame:
        """Distinct neighbours. With ``undo``, rows have the generator ``last`` that led to them, the one that undoes it isn't applied, and each neighbour has its least ``last``."""
        moves = []
        for k in range(self.graph.n_generators):
            move = F.struct(*(x.alias(c) for c, x in zip(self.columns, self.moved(k), strict=True)), F.lit(k).alias("last"))
            moves.append(move if undo is None else F.when(~F.col("last").eqNullSafe(F.lit(undo[k])), move))
        found = rows.select(F.explode(F.array(*moves)).alias("x"))
        if undo is None:
            return found.select(*(f"x.{c}" for c in self.columns)).distinct()
        return found.filter("x is not null").select("x.*").groupBy(*self.columns).agg(F.min("last").alias("last"))


def local_neighbours(graph: GraphDef, states: np.ndarray) -> np.ndarray:
    """Neighbours of rows of states, by generator first, as (generators, rows, elements)."""
    if graph.kind is Kind.PERMUTATION:
        return states[:, np.array(graph.generators)].transpose(1, 0, 2)
    n, m = graph.state_shape
    cube = states.reshape(-1, n, m)
    out = []
    for g in graph.generators:
        a = np.array(g.rows, np.int64)
        if g.modulo:
            total = np.zeros_like(cube)
            for k in range(n):
                total = (total + a[:, k][None, :, None] * cube[:, k][:, None, :] % g.modulo) % g.modulo
        else:
            total = np.einsum("ij,njk->nik", a, cube)
        out.append(total.reshape(len(states), -1))
    return np.stack(out)


def _keys(states: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(states).view(np.dtype((np.void, states.dtype.itemsize * states.shape[1]))).ravel()


def _distinct(states: np.ndarray) -> np.ndarray:
    return np.unique(states, axis=0)


@dataclass
class BfsResult:
    """Layer sizes, and the layers that were kept."""

    graph: GraphDef
    sizes: list[int]
    completed: bool
    store: LayerStore | None
    space: Space
    local: dict[int, np.ndarray] = field(default_factory=dict)
    stored: set[int] = field(default_factory=set)
    spark: SparkSession | None = None

    @property
    def diameter(self) -> int:
        return len(self.sizes) - 1

    @property
    def n_vertices(self) -> int:
        return sum(self.sizes)

    def same_as(self, other: BfsResult) -> bool:
        """Whether two results have equal graphs, sizes and ends, and kept the same states of the same layers."""
        if (self.graph, self.sizes, self.completed, self.stored) != (other.graph, other.sizes, other.completed, other.stored):
            return False
        mine, theirs = self.layers(), other.layers()
        return mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()

    def growth(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(self.sizes)), "layer int, size bigint")

    def layer(self, k: int) -> DataFrame:
        """States of one layer; KeyError if there's no such layer or it wasn't kept."""
        if not 0 <= k < len(self.sizes) or k not in self.stored:
            raise KeyError(f"layer {k} isn't kept")
        if k in self.local:
            return _frame(self.spark, self.local[k])
        return self.space.outward(self.store.get(k))

    def last_layer(self) -> DataFrame:
        return self.layer(self.diameter)

    def layers(self, upto: int | None = None) -> DataFrame:
        """(layer, state) of all kept layers."""
        keep = sorted(k for k in self.stored if upto is None or k <= upto)
        near = [k for k in keep if k in self.local]
        out = None
        if near:
            rows = np.concatenate([self.local[k] for k in near])
            numbers = np.repeat(np.array(near), [len(self.local[k]) for k in near])
            out = _frame(self.spark, rows, numbers)
        for k in keep:
            if k not in self.local:
                df = self.layer(k).select(F.lit(k).alias("layer"), "state")
                out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], "layer int, " + SCHEMA)


def _frame(spark: SparkSession, states: np.ndarray, layers: np.ndarray | None = None) -> DataFrame:
    import pyarrow as pa

    flat = pa.array(np.ascontiguousarray(states, np.int64).ravel())
    column = pa.ListArray.from_arrays(pa.array(np.arange(len(states) + 1, dtype=np.int32) * states.shape[1]), flat)
    columns = {"state": column} if layers is None else {"layer": pa.array(layers, pa.int32()), "state": column}
    return spark.createDataFrame(pa.table(columns))


def start_array(graph: GraphDef, starts: Sequence | None) -> np.ndarray:
    rows = [graph.central] if starts is None else [flat_state(s) for s in ([starts] if _single(graph, starts) else starts)]
    out = np.array(rows, np.int64)
    if out.ndim != 2 or out.shape[1] != graph.state_size:
        raise ValueError("start states must have the central state's length")
    return _distinct(out)


def _single(graph: GraphDef, starts: Sequence) -> bool:
    return isinstance(starts, str) or not hasattr(starts[0], "__len__")


def bfs(
    spark: SparkSession,
    graph: GraphDef,
    start_states: Sequence | None = None,
    max_layer_size_to_store: int | None = 1000,
    max_layer_size_to_explore: int = 10**12,
    max_diameter: int = 10**6,
    stop_condition: Callable[[int, DataFrame], bool] | None = None,
    local_states: int = LOCAL_STATES,
) -> BfsResult:
    """Explores from the start states, which count once each.

    Layer 0 is always kept, others up to ``max_layer_size_to_store`` states (None: all), and the last one if the search is complete. The
    search ends without being complete once a layer has ``max_layer_size_to_explore`` states, at ``max_diameter``, or where ``stop_condition(layer,
    states)`` holds. Graphs closed under inverses look back two layers, others at all.
    """
    most = 10**18 if max_layer_size_to_store is None else max_layer_size_to_store
    closed = graph.inverse_closed
    current = start_array(graph, start_states)
    out = BfsResult(graph, [], False, None, Space(graph, current), spark=spark)
    out.sizes.append(len(current))
    out.local[0] = current
    out.stored.add(0)
    if local_states < len(current):
        return _distributed(out, {0: current}, most, max_layer_size_to_explore, max_diameter, stop_condition, closed)
    past = [_keys(current)]
    arrays = {0: current}
    while len(out.sizes) <= max_diameter:
        found = local_neighbours(graph, arrays[len(out.sizes) - 1]).reshape(-1, graph.state_size)
        found = _distinct(found)
        keys = _keys(found)
        for seen in past[-2:] if closed else past:
            found, keys = (x[~np.isin(keys, seen)] for x in (found, keys))
        if not len(found):
            out.completed = True
            break
        k = len(out.sizes)
        out.sizes.append(len(found))
        arrays[k] = found
        past.append(keys)
        if closed:
            for old in (k - 3,):
                if old not in out.stored:
                    arrays.pop(old, None)
            past[:-3] = [past[0][:0]] * len(past[:-3])
        if len(found) <= most:
            out.local[k] = found
            out.stored.add(k)
        if len(found) >= max_layer_size_to_explore or stop_condition and stop_condition(k, _frame(spark, found)):
            return out
        if len(found) > local_states or (not closed and sum(out.sizes) > 16 * local_states):
            return _distributed(out, arrays, most, max_layer_size_to_explore, max_diameter, stop_condition, closed)
    if out.completed:
        last = out.diameter
        out.local[last] = arrays[last]
        out.stored.add(last)
    return out


def _distributed(out: BfsResult, arrays: dict[int, np.ndarray], most: int, explore: int, max_diameter: int, stop, closed: bool) -> BfsResult:
    """The search from the layers on the driver on, as DataFrames."""
    spark, space = out.spark, out.space
    out.store = store = LayerStore(spark, space.schema)
    for k in range(len(out.sizes)) if not closed else range(max(0, len(out.sizes) - 2), len(out.sizes)):
        store.put(k, space.inward(_frame(spark, arrays[k])))
    while len(out.sizes) <= max_diameter:
        k = len(out.sizes)
        past = store.get(*range(max(0, k - 2) if closed else 0, k))
        size = store.put(k, space.step(store.get(k - 1)).join(past, space.columns, "left_anti"))
        if not size:
            out.completed = True
            out.stored.add(k - 1)
            break
        out.sizes.append(size)
        if size <= most:
            out.stored.add(k)
        if size >= explore or stop and stop(k, space.outward(store.get(k))):
            break
    return out


def bfs_no_backtrack(spark: SparkSession, graph: GraphDef, max_diameter: int = 10**6) -> list[int]:
    """Sizes of layers, by a search whose states remember the generator that led to them and never undo it: fewer neighbours to shuffle, by one for each state.

    The generators must be closed under inverses. States that were reached in several ways remember the least generator; the layer before is left out by exact states.
    """
    undo = graph.inverse_map()
    if None in undo:
        raise ValueError("the generators aren't closed under inverses")
    start = start_array(graph, None)
    space = Space(graph, start)
    store = LayerStore(spark, space.schema + ", last int")
    first = space.inward(_frame(spark, start)).withColumn("last", F.lit(None).cast("int"))
    sizes = [store.put(0, first)]
    while len(sizes) <= max_diameter:
        k = len(sizes)
        past = store.get(*range(max(0, k - 2), k)).drop("last")
        size = store.put(k, space.step(store.get(k - 1), undo).join(past, space.columns, "left_anti"))
        if not size:
            break
        sizes.append(size)
    return sizes


class InteractiveBfs:
    """A search in single steps."""

    def __init__(self, spark: SparkSession, graph: GraphDef, start_states: Sequence | None = None):
        self.spark, self.graph = spark, graph
        start = start_array(graph, start_states)
        self.space = Space(graph, start)
        self.store = LayerStore(spark, self.space.schema)
        self.closed = graph.inverse_closed
        self.sizes = [self.store.put(0, self.space.inward(_frame(spark, start)))]

    def step(self) -> int:
        """Adds the next layer; returns its size, 0 at the end."""
        k = len(self.sizes)
        if not self.sizes[-1]:
            return 0
        past = self.store.get(*range(max(0, k - 2) if self.closed else 0, k))
        self.sizes.append(self.store.put(k, self.space.step(self.store.get(k - 1)).join(past, self.space.columns, "left_anti")))
        return self.sizes[-1]

    def layer(self, k: int) -> DataFrame:
        return self.space.outward(self.store.get(k))

    def find_on_last_layer(self, states: DataFrame) -> DataFrame:
        """Those of ``states`` that the last layer has."""
        return states.join(self.layer(len(self.sizes) - 1), "state", "left_semi")


def iterate_layers(spark: SparkSession, graph: GraphDef, starts: Sequence | None = None) -> Iterator[tuple[int, DataFrame]]:
    """Layers one by one, each once it is complete."""
    search = InteractiveBfs(spark, graph, starts)
    yield 0, search.layer(0)
    while search.step():
        yield len(search.sizes) - 1, search.layer(len(search.sizes) - 1)
