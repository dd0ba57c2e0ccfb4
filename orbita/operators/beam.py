"""Beam search and scores of states."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions.columns import hamming, literal_state, neighbours
from orbita.operators.bfs import BfsResult, _frame
from orbita.operators.paths import restore_path
from orbita.plans.definition import GraphDef, flat_state
from orbita.sources.storage import LayerStore


@dataclass(frozen=True)
class Mlp:
    """A network over one-hot states: dense layers with layer norm and ReLU, then one output. Weights as numpy arrays; runs in Arrow batches."""

    num_classes: int
    hidden: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]  # weight, bias, norm's gain and shift
    out: tuple[np.ndarray, np.ndarray]

    def predict(self, states: np.ndarray) -> np.ndarray:
        x = np.eye(self.num_classes)[states].reshape(len(states), -1)
        for w, b, gain, shift in self.hidden:
            x = x @ w.T + b
            x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * gain + shift
            x = np.maximum(x, 0)
        return (x @ self.out[0].T + self.out[1]).ravel()

    @staticmethod
    def load(path: str, num_classes: int) -> Mlp:
        """Weights from an ``.npz`` file with w0, b0, g0, s0, ..., w, b."""
        f = np.load(path)
        n = sum(k.startswith("g") for k in f.files)
        return Mlp(num_classes, tuple((f[f"w{k}"], f[f"b{k}"], f[f"g{k}"], f[f"s{k}"]) for k in range(n)), (f["w"], f["b"]))


def score(graph: GraphDef, predictor, state: Column, target: Sequence[int] | None = None) -> Column:
    """A column of scores: "zero", "hamming", a function from Column to Column, or a model (with ``predict``) or function over arrays of states, in Arrow batches."""
    if predictor == "zero":
        return F.lit(0.0)
    if predictor == "hamming":
        return hamming(state, literal_state(graph.central if target is None else target)).cast("double")
    if isinstance(predictor, str):
        raise ValueError(f"unknown predictor: {predictor}")
    native = getattr(predictor, "column", None)
    if native is not None:
        return native(state)
    model: Callable = getattr(predictor, "predict", predictor)
    if not callable(model):
        raise ValueError("a predictor is a name, a model with predict, or a function")

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(model(np.stack(s.to_numpy())), float).ravel())

    return run(state)


@dataclass
class BeamResult:
    found: bool
    length: int
    path: list[int] | None = None
    best_scores: dict[int, float] = field(default_factory=dict)

    def path_string(self, graph: GraphDef) -> str:
        return graph.path_to_string(self.path or [])


def beam_search(
    spark: SparkSession,
    graph: GraphDef,
    start_state: Sequence[int] | str,
    beam_width: int = 1000,
    max_steps: int = 1000,
    return_path: bool = False,
    predictor="hamming",
    bfs_result: BfsResult | None = None,
) -> BeamResult:
    """From the start to the centre, keeping the ``beam_width`` best new states of each step, ties by state.

    A hit is looked for before states are cut off, in the centre or in the layers of ``bfs_result``. Not found: length 0.
    """
    start = flat_state(start_state)
    near = bfs_result.layers() if bfs_result else _frame(spark, np.array([graph.central])).select(F.lit(0).alias("layer"), "state")
    store = LayerStore(spark, "state array<bigint>, score double")
    store.put(0, _frame(spark, np.array([start])).withColumn("score", F.lit(0.0)))
    hit = store.get(0).join(near, "state").agg(F.min("layer").alias("k")).first()["k"]
    scores: dict[int, float] = {}
    step = 0
    while hit is None and step < max_steps:
        new = store.get(step).select(F.explode(neighbours(graph, F.col("state"))).alias("state")).distinct()
        store.put(f"{step}.all", new.select("state", score(graph, predictor, F.col("state")).alias("score")))
        every = store.get(f"{step}.all")
        hit = every.join(near, "state").agg(F.min("layer").alias("k")).first()["k"]
        step += 1
        kept = every if hit is not None else every.orderBy("score", "state").limit(beam_width)
        store.put(step, kept)
        scores[step - 1] = store.get(step).agg(F.min("score")).first()[0]
    if hit is None:
        return BeamResult(False, 0, None, scores)
    out = BeamResult(True, step + hit, None, scores)
    if return_path:
        here = tuple(store.get(step).join(near.filter(F.col("layer") == hit), "state").orderBy("state").first()["state"])
        tail = []
        if hit:
            tail = graph.revert_path(restore_path(bfs_result, here, hit))
        back, path = graph.inverted(), []
        for k in range(step - 1, -1, -1):
            before = [back.apply(g, here) for g in range(back.n_generators)]
            there = {tuple(r["state"]) for r in store.get(k).filter(F.array_contains(F.array(*(literal_state(s) for s in before)), F.col("state"))).collect()}
            g = next(i for i, s in enumerate(before) if s in there)
            path.append(g)
            here = before[g]
        out.path = path[::-1] + tail
    return out


def beam_search_to(
    spark: SparkSession,
    graph: GraphDef,
    start_state: Sequence[int] | str,
    destination: Sequence[int] | str | None = None,
    beam_width: int = 1000,
    max_steps: int = 1000,
    history_depth: int = 0,
    predictor="hamming",
) -> BeamResult:
    """To any destination, without states of the last ``history_depth`` beams. No path. Not found: the length is the steps taken."""
    goal = graph.central if destination is None else flat_state(destination)
    store = LayerStore(spark, "state array<bigint>, score double")
    store.put(0, _frame(spark, np.array([flat_state(start_state)])).withColumn("score", F.lit(0.0)))
    if flat_state(start_state) == goal:
        return BeamResult(True, 0)
    scores: dict[int, float] = {}
    for step in range(1, max_steps + 1):
        new = store.get(step - 1).select(F.explode(neighbours(graph, F.col("state"))).alias("state")).distinct()
        if history_depth:
            new = new.join(store.get(*range(max(0, step - history_depth), step)).select("state"), "state", "left_anti")
        store.put(f"{step}.all", new.select("state", score(graph, predictor, F.col("state"), goal).alias("score")))
        every = store.get(f"{step}.all")
        if every.filter(F.col("state") == literal_state(goal)).limit(1).count():
            return BeamResult(True, step, None, scores)
        if not store.put(step, every.orderBy("score", "state").limit(beam_width)):
            return BeamResult(False, step, None, scores)
        scores[step] = store.get(step).agg(F.min("score")).first()[0]
    return BeamResult(False, max_steps, None, scores)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k states of least score, ties by state: kept in each task first, then merged."""
    return scored.orderBy("score", "state").limit(k)
