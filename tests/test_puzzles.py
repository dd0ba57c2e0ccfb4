"""Puzzles, and the searches that differ from the plain one, against its layers."""

from __future__ import annotations

import pytest

from orbita.operators.analysis import undirected_graph, vertices
from orbita.operators.bfs import bfs, bfs_no_backtrack
from orbita.operators.bitmap import bfs_bitmap
from orbita.plans import library as L
from orbita.plans import puzzles
from orbita.plans.library import prepare_graph


@pytest.mark.parametrize(
    "name, first",
    [("pyraminx", [1, 16, 136, 896, 5456, 32528]), ("megaminx", [1, 24, 408, 6208]), ("picture_cube333", [1, 18])],
)
def test_first_layers(spark, name, first):
    graph = prepare_graph(name)
    assert graph.inverse_closed and bfs(spark, graph, max_diameter=len(first) - 1).sizes == first


def test_mini_pyramorphix(spark):
    graph = prepare_graph("mini_pyramorphix")
    found = bfs(spark, graph)
    assert graph.n_generators == 17 and graph.inverse_closed and found.completed and found.n_vertices == 288


def test_picture_cube_turns_centres():
    graph = puzzles.picture_cube333()
    turn = dict(zip(graph.names, graph.generators, strict=True))["f0"]
    assert turn[:15] == (2, 8, 11, 1, 5, 7, 4, 6, 10, 0, 3, 9, 48, 49, 50)
    for g in graph.generators:
        state = tuple(range(72))
        for _ in range(4):
            state = tuple(state[i] for i in g)
        assert state == tuple(range(72))


def test_gap_folder(tmp_path):
    (tmp_path / "two.gap").write_text("M_A:=(1,2,3);\nM_B:=(3,4);\nGen:=[M_A,M_B];\n")
    (tmp_path / "other.txt").write_text("")
    assert puzzles.list_puzzles(str(tmp_path)) == ["two"]
    assert puzzles.gap_puzzle("two", str(tmp_path)).n_generators == 3
    assert puzzles.gap_puzzle("two", str(tmp_path), False).n_generators == 2
    with pytest.raises(ValueError, match="two"):
        puzzles.gap_puzzle("three", str(tmp_path))


def test_other_searches(spark):
    for graph in (L.lrx(6), L.pancake(5)):
        sizes = bfs(spark, graph).sizes
        assert bfs_no_backtrack(spark, graph) == sizes
    assert bfs_bitmap(spark, L.lx(5)) == bfs(spark, L.lx(5)).sizes
    assert bfs_bitmap(spark, L.lrx(8), 4) == bfs(spark, L.lrx(8), max_diameter=4).sizes
    for graph, search in ((L.lx(5), bfs_no_backtrack), (L.lrx(5).with_central("00011"), bfs_bitmap)):
        with pytest.raises(ValueError):
            search(spark, graph)


def test_packed_states(spark):
    """States of two words, of one bit an element, and start states with elements that the centre lacks."""
    cases = [(L.lrx(22), None), (L.lrx(10).with_central("0000011111"), None), (L.lrx(6).with_central("000111"), ["012345"]), (L.lx(5), None)]
    for graph, starts in cases:
        near, far = (bfs(spark, graph, starts, None, max_diameter=4, local_states=n) for n in (10**6, 1))
        assert near.sizes == far.sizes and near.same_as(far)
        assert not near.same_as(bfs(spark, graph, starts, None, max_diameter=3))


def test_vertices_are_numbered_in_order(spark):
    found = bfs(spark, L.lrx(5), max_layer_size_to_store=None)
    rows = vertices(found.layers()).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: (r["layer"], r["state"]))] == list(range(120))
    numbered, pairs = undirected_graph(L.lrx(5), found.layers())
    assert numbered.count() == 120 and pairs.count() == (120 * 2 + 120) // 2
    with pytest.raises(ValueError):
        undirected_graph(L.lx(5), found.layers())
