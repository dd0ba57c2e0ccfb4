"""Random walks over state graphs. Draws are hashes of the walk, the step and a seed, so a task that runs again gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbita.functions.columns import literal_state, neighbours
from orbita.operators.bfs import _frame
from orbita.plans.definition import GraphDef, flat_state
from orbita.sources.storage import LayerStore


def _draw(seed: int, k: int, *of):
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(k)).cast("int")


def classic(spark: SparkSession, graph: GraphDef, width: int, length: int, start: Sequence[int] | str | None = None, seed: int = 1) -> DataFrame:
    """(walk_id, step, state, y): ``width`` independent walks of ``length`` states, y = step. All steps of a walk are made in one projection."""
    begin = literal_state(graph.central if start is None else flat_state(start))
    walks = spark.range(width).withColumnRenamed("id", "walk_id")
    path = F.aggregate(
        F.sequence(F.lit(1), F.lit(length - 1)) if length > 1 else F.array().cast("array<int>"),
        F.array(begin),
        lambda a, i: F.array_append(a, F.get(neighbours(graph, F.element_at(a, -1)), _draw(seed, graph.n_generators, F.col("walk_id"), i))),
    )
    return walks.select("walk_id", F.posexplode(path).alias("step", "state")).withColumn("y", F.col("step"))


def by_layers(spark: SparkSession, graph: GraphDef, width: int, length: int, start: Sequence[int] | str | None = None, seed: int = 1) -> DataFrame:
    """(step, state, y): a breadth-first search whose layers are cut to ``width`` states at random; no state twice, y = layer."""
    store = LayerStore(spark, "state array<bigint>")
    n = store.put(0, _frame(spark, np.array([graph.central if start is None else flat_state(start)])))
    done = [0]
    for k in range(1, length):
        new = store.get(k - 1).select(F.explode(neighbours(graph, F.col("state"))).alias("state")).distinct().join(store.get(*done), "state", "left_anti")
        n = store.put(k, new.orderBy(F.xxhash64(F.lit(seed), F.lit(k), F.col("state")), "state").limit(width))
        if not n:
            break
        done.append(k)
    out = None
    for k in done:
        df = store.get(k).select(F.lit(k).alias("step"), "state", F.lit(k).alias("y"))
        out = df if out is None else out.unionByName(df)
    return out


def not_back(spark: SparkSession, graph: GraphDef, width: int, length: int, history: int = 3, start: Sequence[int] | str | None = None, seed: int = 1) -> DataFrame:
    """(walk_id, step, state, y): ``width`` states at each step, none of them in the last ``history`` steps.

    Steps with fewer new states repeat them; one without any keeps the states and the y of the one before.
    """
    store = LayerStore(spark, "walk_id bigint, state array<bigint>, y int")
    picks = LayerStore(spark, "state array<bigint>, place bigint")
    begin = literal_state(graph.central if start is None else flat_state(start))
    store.put(0, spark.range(width).select(F.col("id").alias("walk_id"), begin.alias("state"), F.lit(0).alias("y")))
    for k in range(1, length):
        y = store.get(k - 1).agg(F.max("y")).first()[0] + 1
        past = store.get(*range(max(0, k - history), k)).select("state")
        new = store.get(k - 1).select(F.explode(neighbours(graph, F.col("state"))).alias("state")).distinct().join(past, "state", "left_anti")
        picked = new.orderBy(F.xxhash64(F.lit(seed), F.lit(k), F.col("state")), "state").limit(width)  # at most the width asked for
        numbered = picked.withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), F.lit(k), F.col("state")), "state")).cast("bigint") - 1)  # the width asked for, at most
        n = picks.put(k, numbered)
        if n:
            store.put(k, spark.range(width).join(picks.get(k), F.pmod("id", F.lit(n)) == F.col("place")).select(F.col("id").alias("walk_id"), "state", F.lit(y).alias("y")))
        else:
            store.put(k, store.get(k - 1))
    out = None
    for k in range(length):
        df = store.get(k).select("walk_id", F.lit(k).alias("step"), "state", "y")
        out = df if out is None else out.unionByName(df)
    return out


def random_walks(spark: SparkSession, graph: GraphDef, width: int, length: int, mode: str = "classic", **options) -> DataFrame:
    modes = {"classic": classic, "bfs": by_layers, "nbt": not_back}
    if mode not in modes:
        raise ValueError(f"unknown mode: {mode}")
    return modes[mode](spark, graph, width, length, **options)
