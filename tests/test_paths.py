from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbita.functions import columns as C
from orbita.operators import beam, paths, walks
from orbita.operators.bfs import bfs
from orbita.plans import library as L
from orbita.sources.storage import load_layers, save_layers


def test_meet_in_the_middle(spark):
    graph, state = L.lrx(10), [7, 9, 6, 1, 0, 8, 5, 3, 2, 4]
    near = bfs(spark, graph, None, None, max_diameter=13)
    path = paths.meet_from(spark, graph, state, near)
    assert len(path) == 26 and graph.validate_path(state, path)
    assert paths.meet_from(spark, graph, state, bfs(spark, graph, None, None, max_diameter=12)) is None


def test_find_path_directed(spark):
    graph, state = L.lx(6), [3, 1, 4, 0, 5, 2]
    path = paths.find_path(spark, graph, state)
    assert graph.validate_path(state, path)


def test_between(spark):
    graph = L.lx(6)
    target = graph.apply_path(graph.central, [1, 0, 0, 1, 0])
    start, path = paths.meet_between(spark, graph, [graph.central], [target], 4)
    assert start == graph.central and len(path) <= 5 and graph.apply_path(start, path) == target
    assert paths.meet_between(spark, graph, [graph.central], [[5, 4, 3, 2, 1, 0]], 1) is None


def test_beam(spark):
    graph = L.lrx(5)
    assert beam.beam_search(spark, graph, "10234", return_path=True).path == [2]
    assert beam.beam_search(spark, graph, "41023", return_path=True).path == [0, 2]
    assert not beam.beam_search(spark, L.lrx(30), list(range(29, -1, -1)), beam_width=10, max_steps=2).found
    lost = beam.beam_search_to(spark, L.lrx(30), list(range(29, -1, -1)), beam_width=10, max_steps=2)
    assert (lost.found, lost.length) == (False, 2)
    with pytest.raises(ValueError):
        beam.score(graph, "oracle", F.col("state"))


def test_network(spark):
    rng = np.random.default_rng(1)
    net = beam.Mlp(3, ((rng.normal(size=(4, 9)), np.zeros(4), np.ones(4), np.zeros(4)),), (rng.normal(size=(1, 4)), np.zeros(1)))
    df = spark.createDataFrame([([0, 1, 2],), ([2, 1, 0],)], "state array<bigint>")
    got = [r[0] for r in df.select(beam.score(L.lrx(3), net, F.col("state"))).collect()]
    assert np.allclose(got, net.predict(np.array([[0, 1, 2], [2, 1, 0]])))


def test_walks(spark):
    rows = walks.random_walks(spark, L.lrx(4), 50, 100, "bfs").groupBy("y").count().orderBy("y").collect()
    assert [r["count"] for r in rows] == [1, 3, 5, 6, 5, 3, 1]
    rows = walks.random_walks(spark, L.heisenberg(3), 20, 10).collect()
    assert len(rows) == 200 and all(r["y"] == r["step"] for r in rows)
    assert walks.random_walks(spark, L.lrx(5), 4, 5, "nbt").count() == 20
    with pytest.raises(ValueError):
        walks.random_walks(spark, L.lrx(4), 2, 2, "other")


@pytest.mark.parametrize("bits, n", [(1, 2), (1, 5), (2, 30), (10, 100), (4, 16), (1, 64)])
def test_packing(spark, bits, n):
    rng = np.random.default_rng(bits * n)
    rows = [(rng.integers(0, 1 << bits, n).tolist(),) for _ in range(5)]
    p = rng.permutation(n).tolist()
    words = [F.col(f"w{k}") for k in range((n * bits + 63) // 64)]
    df = spark.createDataFrame(rows, "state array<bigint>").select("state", *(w.alias(f"w{k}") for k, w in enumerate(C.packed(F.col("state"), bits, n))))
    for r in df.select("state", C.unpacked(words, bits, n).alias("same"), C.unpacked(C.permuted_packed(p, words, bits), bits, n).alias("moved")).collect():
        assert r["same"] == r["state"] and r["moved"] == [r["state"][i] for i in p]


def test_save_and_load(spark, tmp_path):
    graph = L.heisenberg(3, 4)
    save_layers(bfs(spark, graph, max_layer_size_to_store=None).layers(), graph, f"file://{tmp_path}/g")
    layers, again = load_layers(spark, f"file://{tmp_path}/g")
    assert again == graph and [r["count"] for r in layers.groupBy("layer").count().orderBy("layer").collect()] == bfs(spark, graph).sizes


def test_ranks_beyond_doubles(spark):
    from orbita.functions import perm

    ranks = [0, 1, 6_402_373_705_727_999, 2_432_902_008_176_639_998]
    got = spark.createDataFrame([(r,) for r in ranks], "r bigint").select("r", C.unranked(F.col("r"), 20).alias("p")).collect()
    assert all(x["p"] == perm.unrank(x["r"], 20) for x in got)
    assert [x[0] for x in spark.createDataFrame([(x["p"],) for x in got], "p array<bigint>").select(C.ranked(F.col("p"), 20)).collect()] == ranks
