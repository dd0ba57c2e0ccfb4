"""The catalogue of growth tables, and walks and paths that reuse what is there."""

from __future__ import annotations

from orbita.operators.paths import find_path, near_search
from orbita.operators.walks import not_back
from orbita.plans import library as L
from orbita.sources import datasets


def test_catalogue(spark, tmp_path):
    assert len(datasets.CATALOGUE) == 31
    folder = str(tmp_path)
    for name in ("lsl_cycles_cayley_growth", "sl_3_fund_roots_growth"):
        small = datasets.Table(datasets.CATALOGUE[name].keys[:2], datasets.CATALOGUE[name].graph)
        assert all(small.sizes(spark, k)[0] == 1 for k in small.keys)
    datasets.generate(spark, folder, ["all_transpositions_cayley_growth"])
    first = datasets.scan(spark, f"{folder}/all_transpositions_cayley_growth", "x").collect()
    assert len({r["key"] for r in first}) == 29 and sum(int(r["size"]) for r in first if r["key"] == "20") == 2432902008176640000
    datasets.generate(spark, folder, ["all_transpositions_cayley_growth"])
    assert sorted(map(str, datasets.scan(spark, f"{folder}/all_transpositions_cayley_growth", "x").collect())) == sorted(map(str, first))
    assert [datasets.CATALOGUE["coxeter_cayley_growth"].formula("4"), datasets.CATALOGUE["all_transpositions_cayley_growth"].formula("4")] == [[1, 3, 5, 6, 5, 3, 1], [1, 6, 11, 6]]


def test_one_near_search_serves_many(spark):
    graph = L.lrx(6)
    near = near_search(spark, graph, max_diameter=8)
    for start in ("543210", "102345"):
        path = find_path(spark, graph, start, near=near)
        assert graph.validate_path(start, path) and len(path) == len(find_path(spark, graph, start, max_diameter=8))
    one_way = L.lx(5)
    start = one_way.apply_path(one_way.central, [0, 1, 0])
    assert one_way.validate_path(start, find_path(spark, one_way, start, near=near_search(spark, one_way, max_diameter=12)))


def test_walks_that_do_not_go_back(spark):
    graph = L.lrx(5)
    rows = not_back(spark, graph, 7, 6, seed=3).collect()
    states = {(r["step"], r["walk_id"]): tuple(r["state"]) for r in rows}
    last = {r["step"]: r["y"] for r in rows}
    assert len(rows) == 42 and all(states[0, w] == graph.central for w in range(7))
    for k in range(1, 6):
        here, before = ({states[j, w] for w in range(7)} for j in (k, k - 1))
        assert last[k] == k and here <= {graph.apply(g, s) for s in before for g in range(graph.n_generators)}
        assert not here & {states[j, w] for j in range(max(0, k - 3), k) for w in range(7)}
