"""Growth of every family against known layer sizes."""

from __future__ import annotations

import json
import re
from pathlib import Path

import pytest

from orbita.operators.bfs import InteractiveBfs, bfs, iterate_layers
from orbita.plans import library as L
from orbita.plans import puzzles as P
from orbita.plans.definition import create_graph

FULL = {name: json.loads(sizes) for name, sizes in re.findall(r"^\| (.+?) \| (\[[0-9, ]+\]) \|", (Path(__file__).resolve().parents[1] / "FIXTURES.md").read_text(), re.M)}
ROWS = {name.replace(" (directed)", ""): sizes for name, sizes in FULL.items()}
FAMILIES = sorted(k for k in ROWS if (m := re.match(r"(\w+)\(", k)) and m[1] in L.FAMILIES and k.endswith(")") and " " not in k)


def test_fixtures_are_read():
    assert len(FAMILIES) >= 28


@pytest.mark.parametrize("row", FAMILIES)
def test_families(spark, row):
    name, numbers = re.match(r"(\w+)\((.*)\)", row).groups()
    result = bfs(spark, L.FAMILIES[name](*(int(x.partition("=")[2] or x) for x in numbers.split(","))), max_layer_size_to_store=0)
    assert result.completed and result.sizes == ROWS[row]


GOLDEN = [
    (L.heisenberg(3, 10), "heisenberg(3) mod 10"),
    (L.sl_fundamental_roots(2, 6), "SL(2) fundamental roots mod 6"),
    (L.sl_root_weyl(2, 6), "SL(2) root+Weyl mod 6"),
    (L.lrx(4).with_central("0101"), "lrx coset 0101"),
    (L.top_spin(4).with_central("0011"), "top_spin coset 0011"),
    (P.globe_puzzle(1, 1), "globe(1,1)"),
    (P.hungarian_rings(2, 1, 7, 3), "hungarian_rings(2,1,7,3)"),
    (L.lrx(10).with_central("0110110110"), "lrx(10) coset 0110110110"),
]


@pytest.mark.parametrize("graph, row", GOLDEN, ids=[row for _, row in GOLDEN])
def test_growth(spark, graph, row):
    result = bfs(spark, graph, max_layer_size_to_store=0)
    assert result.completed and result.sizes == FULL[row]


def test_growth_without_modulo(spark):
    assert bfs(spark, L.heisenberg(3), max_diameter=15).sizes == FULL["heisenberg(3) modulo 0, depth 15"]


def test_cube_prefix(spark):
    for metric, row in (("fixed_QTM", "2x2x2 fixed corner QTM"), ("fixed_HTM", "2x2x2 fixed corner HTM")):
        assert bfs(spark, P.rubik_cube(2, metric), max_diameter=5).sizes == FULL[row][:6]


def test_cube_generators():
    assert [P.rubik_cube(2, m).n_generators for m in ("QSTM", "QTM", "HTM", "ATM")] == [12, 12, 18, 24]
    assert [P.rubik_cube(3, m).n_generators for m in ("QTM", "HTM", "ATM")] == [12, 18, 78]


def test_distributed_equals_local(spark):
    assert bfs(spark, L.pancake(5), local_states=10).sizes == bfs(spark, L.pancake(5)).sizes
    assert bfs(spark, L.lx(4), local_states=4).sizes == bfs(spark, L.lx(4)).sizes
    a, b = bfs(spark, L.heisenberg(3, 3), local_states=5), bfs(spark, L.heisenberg(3, 3))
    assert a.sizes == b.sizes and a.completed and b.completed


def test_kept_layers(spark):
    graph = L.lrx(10).with_central("0110110110")
    result = bfs(spark, graph, max_layer_size_to_store=10)
    assert sorted(result.stored) == [0, 1, 2, 3, 12, 13, 14, 15, 16, 17]
    with pytest.raises(KeyError):
        result.layer(5)
    cut = bfs(spark, graph, max_layer_size_to_explore=10)
    assert cut.sizes == [1, 3, 4, 6, 11] and not cut.completed


def test_steps(spark):
    search = InteractiveBfs(spark, L.lrx(3), ["012", "012"])
    assert [search.step(), search.step()] == [3, 2] and search.step() == 0
    assert [df.count() for _, df in iterate_layers(spark, L.lrx(3))] == [1, 3, 2]


def test_create_graph():
    assert create_graph(name="lx-9").n_generators == 2
    assert create_graph(generators_permutations=[[1, 2, 0]], make_inverse_closed=True).names == ("1,2,0", "1,2,0'")
    assert create_graph(name="lrx", n=5, central_state="01210").central == (0, 1, 2, 1, 0)
    with pytest.raises(ValueError):
        create_graph(name="nothing", n=3)
    with pytest.raises(ValueError):
        create_graph(generators_permutations=[[0, 0]])
    with pytest.raises(ValueError):
        create_graph(generators_permutations=[[1, 0]], width=3)
