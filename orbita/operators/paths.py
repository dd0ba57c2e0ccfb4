"""Shortest paths: by kept layers, and by meeting in the middle."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions.columns import literal_state
from orbita.operators.bfs import BfsResult, InteractiveBfs, bfs
from orbita.plans.definition import GraphDef, flat_state


def _member(result: BfsResult, k: int, states: list[tuple[int, ...]]) -> list[bool]:
    """Which of a few states a layer holds."""
    if k in result.local:
        rows = result.local[k]
        return [bool((rows == np.array(s)).all(axis=1).any()) for s in states]
    wanted = F.array(*(literal_state(s) for s in states))
    found = {tuple(r["state"]) for r in result.layer(k).filter(F.array_contains(wanted, F.col("state"))).collect()}  # at most as many as asked for
    return [s in found for s in states]


def distance(result: BfsResult, state: Sequence[int] | str) -> int | None:
    """The first layer with the state; all layers must be kept."""
    return next((k for k in range(len(result.sizes)) if _member(result, k, [flat_state(state)])[0]), None)


def distances(layers: DataFrame, states: DataFrame) -> DataFrame:
    """``states`` with ``distance``, null where no layer has the state. One join for all of them."""
    first = layers.groupBy("state").agg(F.min("layer").alias("distance"))
    return states.join(first, "state", "left")


def restore_path(result: BfsResult, state: Sequence[int] | str, layer: int | None = None) -> list[int]:
    """Generators that lead from the start set to the state; in each layer the predecessor by the least generator."""
    here = flat_state(state)
    back = result.graph.inverted()
    path: list[int] = []
    for k in range((layer if layer is not None else distance(result, here) or 0) - 1, -1, -1):
        before = [back.apply(g, here) for g in range(back.n_generators)]
        hits = [g for g, hit in enumerate(_member(result, k, before)) if hit]
        if not hits:
            raise ValueError("the state has no predecessor in the layers")
        path.append(hits[0])
        here = before[hits[0]]
    return path[::-1]


def find_path_to(result: BfsResult, state: Sequence[int] | str) -> list[int] | None:
    d = distance(result, state)
    return None if d is None else restore_path(result, state, d)


def find_path_from(result: BfsResult, state: Sequence[int] | str) -> list[int] | None:
    """A path from the state to the centre; the generators must be closed under inverses."""
    path = find_path_to(result, state)
    return None if path is None else result.graph.revert_path(path)


def meet_to(spark: SparkSession, graph: GraphDef, target: Sequence[int] | str, result: BfsResult) -> list[int] | None:
    """A shortest path from the centre to the target, if it takes at most twice the kept diameter; None otherwise.

    The other half is searched from the target over inverse generators until it meets the last kept layer.
    """
    direct = find_path_to(result, target)
    if direct is not None:
        return direct
    last, met = result.last_layer(), {}

    def meets(k: int, layer: DataFrame) -> bool:
        row = layer.join(last, "state", "left_semi").orderBy("state").first()
        if row is not None:
            met["state"], met["layer"] = tuple(row["state"]), k
        return row is not None

    back = graph.inverted()
    half = bfs(spark, back, [flat_state(target)], None, max_diameter=result.diameter, stop_condition=meets)
    if not met:
        return None
    first = restore_path(result, met["state"], result.diameter)
    # from the target back to the meeting state; the same generators, in reverse, lead on to the target
    return first + restore_path(half, met["state"], met["layer"])[::-1]


def meet_from(spark: SparkSession, graph: GraphDef, start: Sequence[int] | str, result: BfsResult) -> list[int] | None:
    path = meet_to(spark, graph, start, result)
    return None if path is None else graph.revert_path(path)


def meet_between(spark: SparkSession, graph: GraphDef, starts: Sequence, targets: Sequence, max_diameter: int) -> tuple[tuple[int, ...], list[int]] | None:
    """(start, path) of a shortest path between two sets, expanding both sides in turn up to ``max_diameter`` layers each."""
    sides = (InteractiveBfs(spark, graph, starts), InteractiveBfs(spark, graph.inverted(), targets))

    def results() -> list[BfsResult]:
        return [BfsResult(s.graph, [x for x in s.sizes if x], False, s.store, s.space, {}, set(range(len(s.sizes))), spark) for s in sides]

    def meeting(i: int, j: int):
        if i < 0 or j < 0:
            return None
        row = sides[0].layer(i).join(sides[1].layer(j), "state", "left_semi").orderBy("state").first()
        return None if row is None else (tuple(row["state"]), i, j)

    found = meeting(0, 0)
    step = 0
    while found is None and step < max_diameter:
        step += 1
        if not sides[0].step():
            break
        found = meeting(step, step - 1)
        if found is None:
            if not sides[1].step():
                break
            found = meeting(step, step)
    if found is None:
        return None
    state, i, j = found
    a, b = results()
    head, tail = restore_path(a, state, i), restore_path(b, state, j)[::-1]
    start = a.graph.inverted().apply_path(state, head[::-1])
    return start, head + tail


def near_search(spark: SparkSession, graph: GraphDef, max_layer_size: int = 10**6, max_diameter: int = 50) -> BfsResult:
    """The search around the centre that :func:`find_path` meets; made once, it serves many start states."""
    return bfs(spark, graph if graph.inverse_closed else graph.inverted(), None, None, max_layer_size, max_diameter)


def find_path(spark: SparkSession, graph: GraphDef, start: Sequence[int] | str, max_layer_size: int = 10**6, max_diameter: int = 50, near: BfsResult | None = None, **beam) -> list[int] | None:
    """A path from ``start`` to the centre: by meeting in the middle, or by beam search where ``predictor`` is given. ``near`` is the result of :func:`near_search`, if there is one already."""
    if "predictor" in beam:
        from orbita.operators.beam import beam_search

        found = beam_search(spark, graph, start, return_path=True, **({"beam_width": 10**4} | beam))
        return found.path if found.found else None
    near = near or near_search(spark, graph, max_layer_size, max_diameter)
    if graph.inverse_closed:
        return meet_from(spark, graph, start, near)
    path = meet_to(spark, graph.inverted(), start, near)
    return None if path is None else path[::-1]
