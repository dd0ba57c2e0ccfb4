"""Queries over state graphs and the driver's tables, with the SQL that gives the same rows.

Keys of tables become states by lexicographic rank: ``key % n!`` is the rank of a permutation. States are rendered as text, counts are 64-bit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions import columns as C
from orbita.functions import perm
from orbita.operators import analysis, paths, walks
from orbita.operators.beam import beam_search, beam_search_to, score, top_k
from orbita.operators.bfs import InteractiveBfs, bfs, bfs_no_backtrack
from orbita.operators.bitmap import bfs_bitmap
from orbita.plans import library as L
from orbita.plans import puzzles
from orbita.plans.definition import GraphDef
from orbita.sources import datasets
from orbita.sources.storage import load_layers, save_layers, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query: Query, columns: str, sql: str | None = None, ctes: str = "") -> None:
    """Registers a query. ``columns`` has names, with ``:i`` for 64-bit integers; both sides are cast alike."""
    spec = [c.partition(":") for c in columns.split()]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(spark, sf_dir)
        return out.select(*(F.col(c).cast("bigint").alias(c) if kind else F.col(c) for c, _, kind in spec))

    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = f"{ctes and 'WITH RECURSIVE ' + ctes} SELECT " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" if kind else c for c, _, kind in spec) + f" FROM ({sql})"


# ---- SQL that the oracles share


def _list(x: Sequence[int]) -> str:
    return "[" + ",".join(map(str, x)) + "]"


def _bfs_sql(graph: GraphDef, depth: int, starts: Sequence[Sequence[int]] | None = None, tag: str = "") -> str:
    """CTEs g (k, p) of generators, b of all walks' ends by length, and l (s, d) of states by distance."""
    gens = ", ".join(f"({k}, {_list(p)})" for k, p in enumerate(graph.generators))
    first = " UNION ".join(f"SELECT 0, {_list(s)}" for s in (starts or [graph.central]))
    return f"""g{tag}(k, p) AS (VALUES {gens}),
b{tag}(d, s) AS ({first} UNION SELECT d + 1, list_transform(g{tag}.p, lambda i: b{tag}.s[i + 1]) FROM b{tag}, g{tag} WHERE d < {depth}),
l{tag} AS (SELECT s, min(d) AS d FROM b{tag} GROUP BY s)"""


def _perms_sql(n: int) -> str:
    """CTE perms (s, r): permutations with their ranks."""
    names = [f"a{i}" for i in range(n)]
    apart = " AND ".join(f"{x} <> {y}" for i, x in enumerate(names) for y in names[i + 1 :])
    return f"perms AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r FROM (SELECT [{', '.join(names)}] AS s FROM {', '.join(f'range({n}) t{i}({x})' for i, x in enumerate(names))} WHERE {apart}))"


def _text(s: str) -> str:
    return f"array_to_string({s}, '')"


_P6 = _perms_sql(6)
_KEYED = "keyed AS (SELECT o_orderkey AS key, s FROM orders JOIN perms ON r = o_orderkey % 720)"


# ---- frames that the queries share


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, state): a permutation of 6 for each order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("key"), C.unranked(F.col("o_orderkey") % 720, 6).alias("state"))


def _layers(spark: SparkSession, graph: GraphDef, **options) -> DataFrame:
    return bfs(spark, graph, max_layer_size_to_store=None, **options).layers()


def _text_of(column: str = "state") -> Column:
    return C.named(F.col(column))


_LRX4, _LRX6, _LX5, _PANCAKE6 = L.lrx(4), L.lrx(6), L.lx(5), L.pancake(6)


# ---- growth and search


def _growth(graph: GraphDef, **options) -> Query:
    return lambda spark, _: bfs(spark, graph, **options).growth()


def _growth_sql(graph: GraphDef, depth: int) -> tuple[str, str]:
    return "SELECT d AS layer, count(*) AS size FROM l GROUP BY d", _bfs_sql(graph, depth)


def _distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", (F.col("p_partkey") % 720).alias("r"))
    table = _layers(spark, _LRX6).select(C.ranked(F.col("state"), 6).alias("r"), "layer")
    return parts.join(F.broadcast(table), "r").groupBy(F.col("layer").alias("distance")).agg(F.count(F.lit(1)).alias("parts"), F.sum("p_size").alias("total_size"))  # 720 rows


_add(
    "distance_histogram",
    _distance_histogram,
    "distance:i parts:i total_size:i",
    "SELECT d AS distance, count(*) AS parts, sum(p_size) AS total_size FROM part JOIN perms ON r = p_partkey % 720 JOIN l ON l.s = perms.s GROUP BY d",
    f"{_P6}, {_bfs_sql(_LRX6, 15)}",
)

for _name, _graph, _depth in (
    ("lrx", _LRX6, 15), ("lx", _LX5, 11), ("top_spin", L.top_spin(6), 12), ("pancake", _PANCAKE6, 7), ("coset", L.lrx(10).with_central("0110110110"), 17),
    ("lx_ic", L.lx(5).make_inverse_closed(), 10), ("burnt_pancake", L.burnt_pancake(4), 10), ("hungarian_rings", puzzles.hungarian_rings(3, 1, 4, 1), 12), ("globe", puzzles.globe_puzzle(1, 1), 4),
):
    _add(f"bfs_growth_{_name}", _growth(_graph), "layer:i size:i", *_growth_sql(_graph, _depth))

_HEISENBERG = """b(d, x, y, z) AS (SELECT 0, 0, 0, 0 UNION SELECT d + 1, (x + gx + 10) % 10, (y + gy + 10) % 10, (z + gx * y + 10) % 10 FROM b, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) g(gx, gy) WHERE d < 10),
l AS (SELECT x, y, z, min(d) AS d FROM b GROUP BY ALL)"""
_add("bfs_growth_heisenberg", _growth(L.heisenberg(3, 10)), "layer:i size:i", "SELECT d AS layer, count(*) AS size FROM l GROUP BY d", _HEISENBERG)
_SL2 = """b(d, p, q, r, s) AS (SELECT 0, 1, 0, 0, 1 UNION SELECT d + 1, (a * p + b1 * r) % 6, (a * q + b1 * s) % 6, (c * p + e * r) % 6, (c * q + e * s) % 6
 FROM b, (VALUES (1, 1, 0, 1), (1, 5, 0, 1), (1, 0, 1, 1), (1, 0, 5, 1)) g(a, b1, c, e) WHERE d < 7), l AS (SELECT p, q, r, s, min(d) AS d FROM b GROUP BY ALL)"""
_add("bfs_growth_sl2", _growth(L.sl_fundamental_roots(2, 6)), "layer:i size:i", "SELECT d AS layer, count(*) AS size FROM l GROUP BY d", _SL2)

#: Every permutation family at a size that recursion in SQL can take.
_SMALL: list[GraphDef] = [
    L.all_transpositions(5), L.transposons(5), L.block_interchange(5), L.full_reversals(5), L.signed_reversals(3), L.lrx(5), L.lx(5), L.top_spin(5), L.coxeter(5),
    L.cyclic_coxeter(5), L.pancake(5), L.cubic_pancake(5, 2), L.burnt_pancake(3), L.three_cycles(5), L.three_cycles_0ij(5), L.three_cycles_01i(5), L.derangements(4),
    L.involutive_derangements(4), L.stars(5), L.generalized_stars(5, 2), L.rapaport_m1(5), L.rapaport_m2(5), L.all_cycles(4), L.lsl_cycles(5), L.wrapped_k_cycles(5, 3),
    L.larx(5), L.increasing_k_cycles(5, 3), L.sheveleva2(5, 2), L.koltsov3(5), L.consecutive_k_cycles(5, 3), L.conjugacy_classes(5, {(3,): None}), L.down_cycles(5), L.prefix_cycles(5),
]


def _family(graph: GraphDef, k: int) -> str:
    return graph.name or f"family-{k}"


def _all_growth(spark: SparkSession, _: str) -> DataFrame:
    rows = [(_family(g, k), layer, size) for k, g in enumerate(_SMALL) for layer, size in enumerate(bfs(spark, g, max_layer_size_to_store=0).sizes)]
    return spark.createDataFrame(rows, "family string, layer bigint, size bigint")


_add(
    "bfs_growth_families",
    _all_growth,
    "family layer:i size:i",
    " UNION ALL ".join(f"SELECT '{_family(g, k)}' AS family, d AS layer, count(*) AS size FROM l{k} GROUP BY d" for k, g in enumerate(_SMALL)),
    ", ".join(_bfs_sql(g, 16, tag=str(k)) for k, g in enumerate(_SMALL)),
)

_add("bfs_layer_states", lambda s, _: _layers(s, _PANCAKE6).select("layer", _text_of().alias("state")), "layer:i state", f"SELECT d AS layer, {_text('s')} AS state FROM l", _bfs_sql(_PANCAKE6, 7))
_add("bfs_last_layer", lambda s, _: bfs(s, _LRX6).last_layer().select(_text_of().alias("state")), "state", f"SELECT {_text('s')} AS state FROM l WHERE d = (SELECT max(d) FROM l)", _bfs_sql(_LRX6, 15))
_STARTS = ["01210", "10201", "01120"]
_MULTI = L.lrx(5).with_central("01210")
_add("bfs_multi_start", lambda s, _: bfs(s, _MULTI, _STARTS).growth(), "layer:i size:i", "SELECT d AS layer, count(*) AS size FROM l GROUP BY d", _bfs_sql(_MULTI, 6, [list(map(int, x)) for x in _STARTS]))
_add("bfs_max_diameter", _growth(_LRX6, max_diameter=4), "layer:i size:i", *_growth_sql(_LRX6, 4))
_add("bfs_max_explore", _growth(_LRX6, max_layer_size_to_explore=50), "layer:i size:i", "SELECT layer, size FROM (SELECT *, coalesce(max(size) OVER (ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT d AS layer, count(*) AS size FROM l GROUP BY d)) WHERE before < 50", _bfs_sql(_LRX6, 15))
_STOP = [5, 4, 3, 2, 1, 0]
_add(
    "bfs_stop_condition",
    lambda s, _: bfs(s, _LRX6, stop_condition=lambda k, layer: layer.filter(F.col("state") == C.literal_state(_STOP)).count() > 0).growth(),
    "layer:i size:i",
    f"SELECT d AS layer, count(*) AS size FROM l WHERE d <= (SELECT d FROM l WHERE s = {_list(_STOP)}) GROUP BY d",
    _bfs_sql(_LRX6, 15),
)


def _distributed_growth(spark: SparkSession, _: str) -> DataFrame:
    return bfs(spark, _PANCAKE6, local_states=100).growth()


_add("bfs_growth_distributed", _distributed_growth, "layer:i size:i", *_growth_sql(_PANCAKE6, 7))


def _interactive(spark: SparkSession, _: str) -> DataFrame:
    search = InteractiveBfs(spark, _PANCAKE6)
    for _k in range(3):
        search.step()
    return spark.createDataFrame(list(enumerate(search.sizes)), "layer int, size bigint")


_add("interactive_bfs_steps", _interactive, "layer:i size:i", *_growth_sql(_PANCAKE6, 3))
_add(
    "bfs_no_backtrack",
    lambda s, _: s.createDataFrame(list(enumerate(bfs_no_backtrack(s, _LRX6))), "layer int, size bigint").filter("layer > 0"),
    "layer:i size:i",
    "SELECT d AS layer, count(*) AS size FROM l WHERE d > 0 GROUP BY d",
    _bfs_sql(_LRX6, 15),
)

_LX6 = L.lx(6)
_add("bfs_bitmap", lambda s, _: s.createDataFrame(list(enumerate(bfs_bitmap(s, _LX6, 9))), "layer int, size bigint"), "layer:i size:i", *_growth_sql(_LX6, 9))

#: Binary strings with 13 ones: C(26, 13) states.
_BINARY26 = L.lrx(26).with_central("0" * 13 + "1" * 13)
_COSET12 = L.lrx(12).with_central("000000111111")
_add("bfs_growth_coset", lambda s, _: bfs(s, _COSET12, local_states=16).growth(), "layer:i size:i", *_growth_sql(_COSET12, 40))


def binary_coset(spark: SparkSession, _: str) -> DataFrame:
    """Growth of all strings of 13 zeros and 13 ones: 10,400,600 states."""
    return bfs(spark, _BINARY26).growth()


for _puzzle, _depth in ((puzzles.mini_pyramorphix(), 6), (puzzles.pyraminx(), 3), (puzzles.megaminx(), 2), (puzzles.picture_cube333(), 2), (puzzles.rubik_cube(2, "fixed_QTM"), 4), (puzzles.rubik_cube(2, "fixed_HTM"), 3), (puzzles.rubik_cube(3, "QTM"), 3), (puzzles.rubik_cube(3, "HTM"), 2), (puzzles.rubik_cube(2, "ATM"), 2), (puzzles.rubik_cube(3, "QSTM"), 2)):
    _add("bfs_growth_" + re.sub(r"\W+", "_", _puzzle.name), _growth(_puzzle, max_diameter=_depth), "layer:i size:i", *_growth_sql(_puzzle, _depth))

# ---- projections


def _project(column: Callable[[], Column]) -> Query:
    return lambda s, d: _keyed(s, d).select("key", column().alias("out"))


def _per_key(sql: str) -> str:
    return f"SELECT key, {sql} AS out FROM keyed"


_CTES = f"{_P6}, {_KEYED}"
_SHUFFLE = [3, 0, 5, 1, 4, 2]
_PATH = [0, 2, 0, 0, 2, 1, 2]


def _moved(p: Sequence[int], s: str = "s") -> str:
    return f"list_transform({_list(p)}, lambda i: {s}[i + 1])"


_OR = " | ".join(f"(CAST(s[{i + 1}] AS BIGINT) << {3 * i})" for i in range(6))
_WHOLE = perm.identity(6)
for _k in _PATH:
    _WHOLE = [_WHOLE[i] for i in _LRX6.generators[_k]]

_add("apply_generator", _project(lambda: C.named(C.permuted(_SHUFFLE, F.col("state")))), "key:i out", _per_key(_text(_moved(_SHUFFLE))), _CTES)
_add("encode_pack", _project(lambda: C.packed(F.col("state"), 3, 6)[0]), "key:i out:i", _per_key(_OR), _CTES)
_add("decode_unpack", _project(lambda: C.named(C.unpacked(C.packed(F.col("state"), 3, 6), 3, 6))), "key:i out", _per_key(_text("s")), _CTES)
_add(
    "apply_generator_packed",
    _project(lambda: C.named(C.unpacked(C.permuted_packed(_SHUFFLE, C.packed(F.col("state"), 3, 6), 3), 3, 6))),
    "key:i out",
    _per_key(_text(_moved(_SHUFFLE))),
    _CTES,
)
_add(
    "neighbors",
    lambda s, d: _keyed(s, d).select("key", F.posexplode(C.neighbours(_LRX6, F.col("state"))).alias("gen_id", "n")).select("key", "gen_id", C.named(F.col("n")).alias("state")),
    "key:i gen_id:i state",
    f"SELECT key, k AS gen_id, {_text('list_transform(p, lambda i: s[i + 1])')} AS state FROM keyed, g",
    f"{_CTES}, g(k, p) AS (VALUES {', '.join(f'({k}, {_list(p)})' for k, p in enumerate(_LRX6.generators))})",
)
_add("apply_path", _project(lambda: C.named(C.along(_LRX6, _PATH, F.col("state")))), "key:i out", _per_key(_text(_moved(_WHOLE))), _CTES)


def _own_path(key: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.pmod(F.floor(key / F.pow(F.lit(3), i)), F.lit(3)).cast("int"))


_STEPS = "list_transform(range(5), lambda j: (key // CAST(pow(3, j) AS BIGINT)) % 3)"
_NESTED = "s"
for _j in range(5):
    _NESTED = f"list_transform([{', '.join(_list(p) for p in _LRX6.generators)}][(key // {3**_j}) % 3 + 1], lambda i{_j}: ({_NESTED})[i{_j} + 1])"
_add("apply_path_each", lambda s, d: _keyed(s, d).select("key", C.named(C.along_each(_LRX6, _own_path(F.col("key")), F.col("state"))).alias("out")), "key:i out", _per_key(_text(f"({_NESTED})")), _CTES)


def _path_states(spark: SparkSession, _: str) -> DataFrame:
    rows = [(k, s) for k, s in enumerate(_LRX6.path_states(_LRX6.central, _PATH))]
    return spark.createDataFrame(rows, "step int, state array<bigint>").select("step", _text_of().alias("state"))


_add(
    "path_states",
    _path_states,
    "step:i state",
    f"SELECT step, {_text('s')} AS state FROM w",
    f"w(step, s) AS (SELECT 0, {_list(range(6))} UNION ALL SELECT step + 1, list_transform([{', '.join(_list(p) for p in _LRX6.generators)}][{_list(_PATH)}[step + 1] + 1], lambda i: w.s[i + 1]) FROM w WHERE step < {len(_PATH)})",
)
_add("validate_path", _project(lambda: (C.along(_LRX6, _PATH, F.col("state")) == C.literal_state(range(6))).cast("int")), "key:i out:i", _per_key(f"CAST({_moved(_WHOLE)} = {_list(range(6))} AS INT)"), _CTES)
_NAMES = "['L','R','X']"
_add(
    "path_to_string",
    lambda s, d: _keyed(s, d).select("key", F.array_join(F.transform(_own_path(F.col("key")), lambda k: F.get(F.array(F.lit("L"), F.lit("R"), F.lit("X")), k)), ".").alias("out")),
    "key:i out",
    _per_key(f"array_to_string(list_transform({_STEPS}, lambda k: {_NAMES}[k + 1]), '.')"),
    _CTES,
)
_add(
    "revert_path",
    lambda s, d: _keyed(s, d).select("key", F.array_join(F.transform(F.reverse(_own_path(F.col("key"))), lambda k: F.get(F.array(*(F.lit(i) for i in _LRX6.inverse_map())), k)).cast("array<string>"), ".").alias("out")),
    "key:i out",
    _per_key(f"array_to_string(list_transform(list_reverse({_STEPS}), lambda k: [1,0,2][k + 1]), '.')"),
    _CTES,
)
_add("hamming_score", _project(lambda: C.hamming(F.col("state"), C.literal_state(_STOP))), "key:i out:i", _per_key(" + ".join(f"CAST(s[{i + 1}] <> {x} AS INT)" for i, x in enumerate(_STOP))), _CTES)
_add("vertex_names", _project(lambda: C.named(F.transform(F.col("state"), lambda x: x * 3))), "key:i out", _per_key("array_to_string(list_transform(s, lambda x: x * 3), ',')"), _CTES)
_add("perm_apply", _project(lambda: C.named(C.composed(F.col("state"), F.col("state")))), "key:i out", _per_key(_text("list_transform(s, lambda i: s[i + 1])")), _CTES)
_add("perm_compose", _project(lambda: C.named(C.composed(F.col("state"), C.literal_state(_SHUFFLE)))), "key:i out", _per_key(_text(f"list_transform(s, lambda i: {_list(_SHUFFLE)}[i + 1])")), _CTES)
_add("perm_inverse", _project(lambda: C.named(C.inverse(F.col("state")))), "key:i out", _per_key(_text("list_transform(range(6), lambda i: list_position(s, i) - 1)")), _CTES)
_add("permutation_rank", _project(lambda: C.ranked(F.col("state"), 6)), "key:i out:i", "SELECT key, r AS out FROM keyed JOIN perms ON perms.s = keyed.s", _CTES)
_add(
    "is_permutation",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), C.is_permutation(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.floor(F.col("o_orderkey") / F.pow(F.lit(4), i)) % 4).cast("bigint"))).cast("int").alias("out")),
    "key:i out:i",
    "SELECT o_orderkey AS key, CAST(list_sort(list_transform(range(4), lambda i: (o_orderkey // CAST(pow(4, i) AS BIGINT)) % 4)) = [0,1,2,3] AS INT) AS out FROM orders",
)
_add("perm_identity", lambda s, _: s.createDataFrame([(n, ",".join(map(str, perm.identity(n)))) for n in range(1, 8)], "n int, p string"), "n:i p", "SELECT n, array_to_string(range(n), ',') AS p FROM range(1, 8) t(n)")
_add(
    "perm_transposition",
    lambda s, _: s.createDataFrame([(i, j, "".join(map(str, perm.transposition(6, i, j)))) for i in range(6) for j in range(i + 1, 6)], "i int, j int, p string"),
    "i:i j:i p",
    "SELECT i, j, array_to_string(list_transform(range(6), lambda x: CASE x WHEN i THEN j WHEN j THEN i ELSE x END), '') AS p FROM range(6) a(i), range(6) b(j) WHERE i < j",
)
_add(
    "perm_by_cycle_type",
    lambda s, _: s.createDataFrame([("".join(map(str, p)),) for p in perm.by_cycle_type(5, [2, 2])], "p string"),
    "p",
    f"SELECT {_text('s')} AS p FROM perms WHERE len(list_filter(range(5), lambda i: s[i + 1] = i)) = 1 AND len(list_filter(range(5), lambda i: s[s[i + 1] + 1] = i)) = 5",
    _perms_sql(5),
)
_add(
    "generator_inverse_map",
    lambda s, _: s.createDataFrame(list(enumerate(L.three_cycles_0ij(5).inverse_map())), "gen_id int, inverse_id int"),
    "gen_id:i inverse_id:i",
    "SELECT x.k AS gen_id, y.k AS inverse_id FROM g x JOIN g y ON list_transform(x.p, lambda i: y.p[i + 1]) = [0,1,2,3,4]",
    f"g(k, p) AS (VALUES {', '.join(f'({k}, {_list(p)})' for k, p in enumerate(L.three_cycles_0ij(5).generators))})",
)


def _matrix_apply(modulo: int) -> Query:
    graph = L.heisenberg(3, modulo)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("key"), "l_linenumber", F.array(*(F.pmod(F.col("l_partkey") * (i + 1) + F.col("l_suppkey"), F.lit(modulo or 1000)) for i in range(3))).alias("v"))
        state = F.flatten(F.transform(F.col("v"), lambda x: F.array(x)))
        column = GraphDef.matrices(graph.generators, graph.names, [0, 0, 1])
        return li.select("key", "l_linenumber", F.array_join(C.applied(column, 0, state).cast("array<string>"), ",").alias("out"))

    return run


for _m in (10, 0):
    _v = [f"((l_partkey * {i + 1} + l_suppkey) % {_m or 1000})" for i in range(3)]
    _first = f"({_v[0]} + {_v[1]})" + (f" % {_m}" if _m else "")
    _add("apply_matrix" + "_mod" * bool(_m), _matrix_apply(_m), "key:i l_linenumber:i out", f"SELECT l_orderkey AS key, l_linenumber, concat_ws(',', {_first}, {_v[1]}, {_v[2]}) AS out FROM lineitem")

# ---- sets, top-k and windows


def _two(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    r = _layers(spark, _PANCAKE6)
    s = _layers(spark, _LRX6)
    return r.filter("layer = 3").select("state"), s.filter("layer = 5").select("state")


_TWO = f"{_bfs_sql(_PANCAKE6, 7, tag='p')}, {_bfs_sql(_LRX6, 15, tag='q')}, x AS (SELECT s FROM lp WHERE d = 3), y AS (SELECT s FROM lq WHERE d = 5)"
for _name, _op, _sql in (("union", lambda a, b: a.unionByName(b).distinct(), "UNION"), ("except", lambda a, b: a.join(b, "state", "left_anti"), "EXCEPT"), ("intersect", lambda a, b: a.join(b, "state", "left_semi"), "INTERSECT")):
    _add(f"layer_{_name}", lambda s, _d, op=_op: op(*_two(s)).select(_text_of().alias("state")), "state", f"SELECT {_text('s')} AS state FROM (SELECT s FROM x {_sql} SELECT s FROM y)", _TWO)
_add("distinct_states", lambda s, d: _keyed(s, d).select(F.explode(C.neighbours(_LRX6, F.col("state"))).alias("state")).distinct().select(_text_of().alias("state")), "state", f"SELECT DISTINCT {_text('list_transform(p, lambda i: s[i + 1])')} AS state FROM keyed, g", f"{_CTES}, g(p) AS (VALUES {', '.join(f'({_list(p)})' for p in _LRX6.generators)})")
_SCORED = " + ".join(f"CAST(s[{i + 1}] <> {i} AS INT)" for i in range(6))
_add("beam_topk", lambda s, d: top_k(_keyed(s, d).select("state", score(_LRX6, "hamming", F.col("state")).alias("score")).distinct(), 50).select(_text_of().alias("state"), "score"), "state score:i", f"SELECT {_text('s')} AS state, score FROM (SELECT DISTINCT s, {_SCORED} AS score FROM keyed) ORDER BY score, s LIMIT 50", _CTES)
_add("beam_scores", lambda s, d: _layers(s, _LRX6).groupBy("layer").agg(F.min(score(_LRX6, "hamming", F.col("state"))).alias("best")), "layer:i best:i", f"SELECT d AS layer, min({_SCORED}) AS best FROM l GROUP BY d", _bfs_sql(_LRX6, 15))
_add(
    "bitmap_layer_count",
    lambda s, _: _layers(s, _LRX6).filter("layer = 7").select(C.ranked(F.col("state"), 6).alias("rank")).transform(lambda r: analysis.bitmap(r, 256)).groupBy("chunk").agg(F.sum(F.bit_count("bits")).alias("states")),
    "chunk:i states:i",
    "SELECT r // 256 AS chunk, count(*) AS states FROM l JOIN perms ON perms.s = l.s WHERE d = 7 GROUP BY 1",
    f"{_P6}, {_bfs_sql(_LRX6, 15)}",
)

# ---- explicit graphs

_V4 = "v AS (SELECT s, d, row_number() OVER (ORDER BY d, s) - 1 AS id FROM l)"
_E4 = "e AS (SELECT a.id AS src, c.id AS dst, k AS gen_id FROM v a, g JOIN v c ON c.s = list_transform(p, lambda i: a.s[i + 1]))"
_G4 = f"{_bfs_sql(_LRX4, 6)}, {_V4}, {_E4}"


def _vertices(spark: SparkSession) -> DataFrame:
    return analysis.vertices(_layers(spark, _LRX4))


def _numbered(spark: SparkSession) -> DataFrame:
    return analysis.indexed_edges(_LRX4, _vertices(spark))


_add("graph_vertices", lambda s, _: _vertices(s), "id:i layer:i name", f"SELECT id, d AS layer, {_text('s')} AS name FROM v", _G4)
_add("vertex_index", lambda s, _: _vertices(s).select("id", "name"), "id:i name", f"SELECT id, {_text('s')} AS name FROM v", _G4)
_add("graph_edges", lambda s, _: analysis.edges(_LRX4, _layers(s, _LRX4).select("state")).select("gen_id", _text_of("src").alias("src"), _text_of("dst").alias("dst")), "gen_id:i src dst", f"SELECT k AS gen_id, {_text('s')} AS src, {_text('list_transform(p, lambda i: s[i + 1])')} AS dst FROM l, g", _G4)
_add("edges_indexed", lambda s, _: _numbered(s), "src:i dst:i gen_id:i", "SELECT * FROM e", _G4)
_COSET = L.lrx(5).with_central("00101")
_add(
    "undirected_edges",
    lambda s, _: analysis.undirected(analysis.edges(_COSET, _layers(s, _COSET).select("state")).select(_text_of("src").alias("src"), _text_of("dst").alias("dst"))),
    "a b",
    f"SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT {_text('s')} AS x, {_text('list_transform(p, lambda i: s[i + 1])')} AS y FROM l, g)",
    _bfs_sql(_COSET, 12),
)
_add(
    "edge_names",
    lambda s, _: analysis.edge_names(_COSET, _layers(s, _COSET).select("state")).select(_text_of("src").alias("src"), _text_of("dst").alias("dst"), "gen_id", "name"),
    "src dst gen_id:i name",
    f"SELECT src, dst, gen_id, {_NAMES}[gen_id + 1] AS name FROM (SELECT {_text('s')} AS src, {_text('list_transform(p, lambda i: s[i + 1])')} AS dst, min(k) AS gen_id FROM l, g GROUP BY 1, 2)",
    _bfs_sql(_COSET, 12),
)
_add("adjacency_coo", lambda s, _: analysis.adjacency(_numbered(s)), "row:i col:i value:i", 'SELECT DISTINCT src AS row, dst AS col, 1 AS value FROM e', _G4)
_add("adjacency_multi", lambda s, _: analysis.adjacency(_numbered(s), True), "row:i col:i value:i", "SELECT src AS row, dst AS col, 1 AS value FROM e", _G4)
_add(
    "laplacian",
    lambda s, _: analysis.laplacian(analysis.adjacency(_numbered(s))),
    "row:i col:i value:i",
    "SELECT row, col, sum(value) AS value FROM (SELECT src AS row, src AS col, count(DISTINCT dst) AS value FROM e GROUP BY src UNION ALL SELECT DISTINCT src, dst, -1 FROM e) GROUP BY row, col HAVING sum(value) <> 0",
    _G4,
)
_add("graph_summary", lambda s, _: analysis.summary(_layers(s, _LRX6)), "n_vertices:i diameter:i", "SELECT count(*) AS n_vertices, max(d) AS diameter FROM l", _bfs_sql(_LRX6, 15))
_add(
    "edges_truncated",
    lambda s, _: analysis.truncated_edges(_LRX6, _layers(s, _LRX6, max_diameter=3)).select("gen_id", _text_of("src").alias("src"), _text_of("dst").alias("dst")),
    "gen_id:i src dst",
    "SELECT gen_id, src, dst FROM f UNION ALL SELECT gen_id, dst, src FROM f WHERE d = 2",
    f"{_bfs_sql(_LRX6, 3)}, f AS (SELECT k AS gen_id, d, {_text('s')} AS src, {_text('list_transform(p, lambda i: s[i + 1])')} AS dst FROM l, g WHERE d < 3)",
)


def _round_trip(spark: SparkSession, _: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    save_layers(_layers(spark, _PANCAKE6), _PANCAKE6, path)
    layers, graph = load_layers(spark, path)
    if graph != _PANCAKE6:
        raise AssertionError("the definition changed")
    return layers.groupBy("layer").agg(F.count(F.lit(1)).alias("size"))


_add("bfs_roundtrip", _round_trip, "layer:i size:i", *_growth_sql(_PANCAKE6, 7))
_add("create_graph_matrix", lambda s, _: bfs(s, GraphDef.matrices([L._elementary(2, 0, 1, 10), L._elementary(2, 0, 1, 10).inverse()], None, [[1, 2], [0, 1]])).growth(), "layer:i size:i", "SELECT d AS layer, count(*) AS size FROM (SELECT min(d) AS d FROM b GROUP BY x) GROUP BY d", "b(d, x) AS (SELECT 0, 2 UNION SELECT d + 1, (x + g) % 10 FROM b, (VALUES (1), (9)) t(g) WHERE d < 5)")

# ---- lookups and paths


def _distance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.distances(_layers(spark, _LRX6), _keyed(spark, sf_dir)).select("key", "distance")


_add("distance_lookup", _distance_lookup, "key:i distance:i", "SELECT key, d AS distance FROM keyed JOIN l ON l.s = keyed.s", f"{_CTES}, {_bfs_sql(_LRX6, 15)}")


def _region_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(t):
        return spark.read.parquet(f"{sf_dir}/{t}.parquet")

    c = read("customer").select("c_nationkey", (F.col("c_custkey") % 720).alias("r"))
    table = _layers(spark, _LRX6).select(C.ranked(F.col("state"), 6).alias("r"), "layer")
    per = c.join(F.broadcast(table), "r").groupBy("c_nationkey").agg(F.sum("layer").alias("total"), F.count(F.lit(1)).alias("n"))  # 720 rows
    n, r = read("nation"), read("region")
    return per.join(n, per.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.sum("total").alias("total_distance"), F.sum("n").alias("customers"))


_add("region_distance", _region_distance, "r_name total_distance:i customers:i", "SELECT r_name, sum(d) AS total_distance, count(*) AS customers FROM customer JOIN perms ON r = c_custkey % 720 JOIN l ON l.s = perms.s JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name", f"{_P6}, {_bfs_sql(_LRX6, 15)}")
_TARGETS = [[0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0], [1, 0, 3, 2, 5, 4], [2, 3, 4, 5, 0, 1], [0, 2, 1, 4, 3, 5], [3, 1, 4, 0, 5, 2]]
_TARGET_SQL = f"SELECT {_text('s')} AS state, d AS length FROM l WHERE s IN ({', '.join(map(_list, _TARGETS))})"


def _found(find: Callable[[SparkSession], Callable[[Sequence[int]], tuple[Sequence[int], list[int] | None]]], targets: Sequence[Sequence[int]] = _TARGETS) -> Query:
    """(state, length, valid) of paths; ``valid`` is 1 where the path leads where it should."""

    def run(spark: SparkSession, _: str) -> DataFrame:
        one = find(spark)
        rows = []
        for t in targets:
            ok, path = one(t)
            rows.append(("".join(map(str, t)), len(path), int(ok)))
        return spark.createDataFrame(rows, "state string, length int, valid int")

    return run


def _to(spark: SparkSession):
    near = bfs(spark, _LRX6, None, None)

    def one(t):
        p = paths.find_path_to(near, t)
        return _LRX6.apply_path(_LRX6.central, p) == tuple(t), p

    return one


def _from(spark: SparkSession):
    near = bfs(spark, _LRX6, None, None)

    def one(t):
        p = paths.find_path_from(near, t)
        return _LRX6.validate_path(t, p), p

    return one


def _meet(spark: SparkSession):
    near = bfs(spark, _LRX6, None, None, max_diameter=8)

    def one(t):
        p = paths.meet_from(spark, _LRX6, t, near)
        return _LRX6.validate_path(t, p), p

    return one


def _auto(spark: SparkSession):
    def one(t):
        p = paths.find_path(spark, _LRX6, t)
        return _LRX6.validate_path(t, p), p

    return one


def _restored(spark: SparkSession):
    near = bfs(spark, _PANCAKE6, None, None)

    def one(t):
        p = paths.restore_path(near, t)
        return _PANCAKE6.apply_path(_PANCAKE6.central, p) == tuple(t), p

    return one


for _name, _find in (("find_path_to", _to), ("find_path_from", _from), ("mitm_length", _meet), ("find_path_auto", _auto)):
    _add(_name, _found(_find), "state length:i valid:i", f"SELECT *, 1 AS valid FROM ({_TARGET_SQL})", _bfs_sql(_LRX6, 15))
_add("restore_path", _found(_restored), "state length:i valid:i", f"SELECT *, 1 AS valid FROM ({_TARGET_SQL})", _bfs_sql(_PANCAKE6, 7))
_add(
    "mitm_meeting_states",
    lambda s, _: (lambda a, b: a.join(b, "state", "left_semi").select(_text_of().alias("state")))(bfs(s, _LRX6, None, None, max_diameter=6).layer(6), bfs(s, _LRX6, [_STOP], None, max_diameter=9).layer(9)),
    "state",
    f"SELECT {_text('lp.s')} AS state FROM lp JOIN lq ON lp.s = lq.s WHERE lp.d = 6 AND lq.d = 9",
    f"{_bfs_sql(_LRX6, 6, tag='p')}, {_bfs_sql(_LRX6, 9, [_STOP], tag='q')}",
)


def _between(spark: SparkSession, _: str) -> DataFrame:
    found = paths.meet_between(spark, _LRX6, [[0, 1, 2, 3, 4, 5]], [[5, 4, 3, 2, 1, 0], [3, 1, 4, 0, 5, 2]], 10)
    start, path = found
    end = _LRX6.apply_path(start, path)
    return spark.createDataFrame([(len(path), int(list(end) in [[5, 4, 3, 2, 1, 0], [3, 1, 4, 0, 5, 2]]))], "length int, valid int")


_add("mitm_between", _between, "length:i valid:i", "SELECT min(d) AS length, 1 AS valid FROM l WHERE s IN ([5,4,3,2,1,0], [3,1,4,0,5,2])", _bfs_sql(_LRX6, 15))


def _beam(spark: SparkSession, _: str) -> DataFrame:
    rows = []
    for start in ([1, 0, 2, 3, 4], [4, 1, 0, 2, 3]):
        r = beam_search(spark, L.lrx(5), start, beam_width=10**4, return_path=True, predictor="zero")
        rows.append(("".join(map(str, start)), r.length, int(L.lrx(5).validate_path(start, r.path))))
    return spark.createDataFrame(rows, "state string, length int, valid int")


def _beam_to(spark: SparkSession, _: str) -> DataFrame:
    rows = []
    for start in ([1, 0, 2, 3, 4], [4, 1, 0, 2, 3]):
        r = beam_search_to(spark, L.lrx(5), start, beam_width=10**4, history_depth=3, predictor="hamming")
        rows.append(("".join(map(str, start)), r.length, int(r.found)))
    return spark.createDataFrame(rows, "state string, length int, valid int")


# a beam as wide as every layer is a breadth-first search, so lengths are distances
_BEAM_SQL = (f"SELECT {_text('s')} AS state, d AS length, 1 AS valid FROM l WHERE s IN ([1,0,2,3,4], [4,1,0,2,3])", _bfs_sql(L.lrx(5), 10))
_add("beam_simple", _beam, "state length:i valid:i", *_BEAM_SQL)
_add("beam_advanced", _beam_to, "state length:i valid:i", *_BEAM_SQL)
_add("beam_mitm", lambda s, d: (lambda near: s.createDataFrame([(beam_search(s, L.lrx(5), [4, 3, 2, 1, 0], 10**4, predictor="zero", bfs_result=near).length,)], "length int"))(bfs(s, L.lrx(5), None, None, max_diameter=4)), "length:i", "SELECT d AS length FROM l WHERE s = [4,3,2,1,0]", _bfs_sql(L.lrx(5), 10))

# ---- walks: random, so without SQL, but for widths that leave nothing to chance
_add("walks_classic", lambda s, _: walks.classic(s, L.lrx(8), 1000, 20).select("walk_id", "step", _text_of().alias("state"), "y"), "walk_id:i step:i state y:i")
_add("walks_classic_shape", lambda s, _: walks.classic(s, L.lrx(8), 1000, 20).groupBy("step").agg(F.count(F.lit(1)).alias("rows"), F.min("y").alias("least_y"), F.max("y").alias("most_y")), "step:i rows:i least_y:i most_y:i", "SELECT step, 1000 AS rows, step AS least_y, step AS most_y FROM range(20) t(step)")
_add("walks_bfs", lambda s, _: walks.by_layers(s, _LRX4, 50, 100).groupBy("y").agg(F.count(F.lit(1)).alias("rows")), "y:i rows:i", "SELECT d AS y, count(*) AS rows FROM l GROUP BY d", _bfs_sql(_LRX4, 6))
_add("walks_nbt", lambda s, _: walks.not_back(s, _LRX6, 20, 5).select("walk_id", "step", _text_of().alias("state"), "y"), "walk_id:i step:i state y:i")

# ---- data sets and puzzle definitions


def _closed_forms(growth: Callable[[int], list[int]]) -> Query:
    return lambda s, _: s.createDataFrame([(n, k, size) for n in range(2, 7) for k, size in enumerate(growth(n))], "n int, layer int, size bigint")


_add(
    "growth_stirling",
    _closed_forms(perm.stirling_growth),
    "n:i layer:i size:i",
    " UNION ALL ".join(f"SELECT {n} AS n, d AS layer, count(*) AS size FROM l{n} GROUP BY d" for n in range(2, 7)),
    ", ".join(_bfs_sql(L.all_transpositions(n), n, tag=str(n)) for n in range(2, 7)),
)
_add(
    "growth_mahonian",
    _closed_forms(perm.mahonian_growth),
    "n:i layer:i size:i",
    " UNION ALL ".join(f"SELECT {n} AS n, d AS layer, count(*) AS size FROM l{n} GROUP BY d" for n in range(2, 7)),
    ", ".join(_bfs_sql(L.coxeter(n), 15, tag=str(n)) for n in range(2, 7)),
)
_add("dataset_key_grid", lambda s, _: datasets.key_grid(s, 3, 9, 2, 5), "key n:i k:i", "SELECT n || ',' || k AS key, n, k FROM range(3, 10) a(n), range(2, 6) b(k) WHERE k <= n")
_add("dataset_missing_keys", lambda s, _: datasets.missing_keys(datasets.key_grid(s, 3, 9, 2, 5), datasets.key_grid(s, 3, 6, 2, 4)), "key n:i k:i", "SELECT n || ',' || k AS key, n, k FROM range(3, 10) a(n), range(2, 6) b(k) WHERE k <= n AND NOT (n <= 6 AND k <= 4)")


def _catalogue(spark: SparkSession, _: str) -> DataFrame:
    return spark.createDataFrame([(name, key) for name, t in datasets.CATALOGUE.items() if name != "hungarian_rings_growth" for key in t.keys], "dataset string, key string")


_RANGES = {"lrx lx stars": (3, 12), "top_spin": (4, 12), "transposons pancake full_reversals cyclic_coxeter rapaport_m1 rapaport_m2 down_cycles prefix_cycles": (2, 11), "all_transpositions coxeter": (2, 31), "burnt_pancake signed_reversals": (1, 8), "all_cycles larx": (2, 8), "block_interchange": (3, 10), "lsl_cycles": (4, 8)}
_KEYS_SQL = [f"SELECT '{f}_cayley_growth' AS dataset, CAST(n AS VARCHAR) AS key FROM range({a}, {b}) t(n)" for names, (a, b) in _RANGES.items() for f in names.split()]
_KEYS_SQL += [f"SELECT 'sl_{k}_{f}_growth', CAST(n AS VARCHAR) FROM range(2, {b}) t(n)" for k, b in ((2, 11), (3, 6)) for f in ("fund_roots", "root_weyl")]
_KEYS_SQL += [f"SELECT '{f}_k_cycles_cayley_growth', n || ',' || k FROM range({a}, 10) t(n), range(2, 10) u(k) WHERE k <= least(n, {m})" for f, a, m in (("wrapped", 2, 9), ("increasing", 3, 5), ("consecutive", 3, 5))]
_KEYS_SQL += ["SELECT 'heisenberg_growth', n || ',' || m FROM range(3, 11) t(n), range(2, 51) u(m) WHERE pow(m, 2 * n - 3) <= 2000000"]
for _f, _a in (("lrx", 3), ("top_spin", 4)):
    _KEYS_SQL += [f"SELECT '{_f}_coset_growth', repeat('01', n // 2) || repeat('0', n % 2) FROM range({_a}, 30) t(n)", f"SELECT '{_f}_coset_growth', repeat('0', n - n // 2) || repeat('1', n // 2) FROM range({_a}, 30) t(n)"]
_add("dataset_catalogue", _catalogue, "dataset key", " UNION ALL ".join(_KEYS_SQL))


def _dataset_scan(spark: SparkSession, _: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/growth-{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], "key string, layer int, size decimal(38,0)")
    wanted = spark.createDataFrame([(str(n),) for n in range(2, 6)], "key string")
    datasets.write(datasets.upsert(empty, wanted, lambda k: bfs(spark, L.pancake(int(k)), max_layer_size_to_store=0).sizes), path)
    return datasets.scan(spark, path, "pancake")


_add("dataset_scan", _dataset_scan, "dataset key layer:i size:i", " UNION ALL ".join(f"SELECT 'pancake' AS dataset, '{n}' AS key, d AS layer, count(*) AS size FROM l{n} GROUP BY d" for n in range(2, 6)), ", ".join(_bfs_sql(L.pancake(n), 6, tag=str(n)) for n in range(2, 6)))
_GAP = "M_A:=(1,2,3)(4,5);\nM_B:=(2,6);\nip:=[[1,4],[2],[3,6],[5]];"


def _gap(spark: SparkSession, _: str) -> DataFrame:
    g = puzzles.parse_gap(_GAP, "small.gap", make_inverse_closed=False)
    return spark.createDataFrame([(n, "".join(map(str, p))) for n, p in zip(g.names, g.generators, strict=True)], "name string, p string")


_add(
    "gap_parse",
    _gap,
    "name p",
    "SELECT name, array_to_string(list_transform(range(1, 7), lambda i: coalesce(list_filter(list_transform(c, lambda x: CASE WHEN list_position(x, i) IS NULL OR list_position(x, i) = 0 THEN -1 ELSE x[list_position(x, i) % len(x) + 1] - 1 END), lambda y: y >= 0)[1], i - 1)), '') AS p FROM (VALUES ('A', [[1,2,3],[4,5]]), ('B', [[2,6]])) t(name, c)",
)
_add("gap_ip_colors", lambda s, _: s.createDataFrame(list(enumerate(puzzles.colors_of(6, [[1, 4], [2], [3, 6], [5]]))), "point int, color int"), "point:i color:i", "SELECT p - 1 AS point, dense_rank() OVER (ORDER BY first) - 1 AS color FROM (SELECT p, min(p) OVER (PARTITION BY c) AS first FROM (VALUES (1, 1), (4, 1), (2, 2), (3, 3), (6, 3), (5, 4)) t(p, c))")
_add(
    "rings_grid",
    lambda s, _: s.createDataFrame(puzzles.ring_variants(12), "left_size int, left_index int, right_size int, right_index int"),
    "left_size:i left_index:i right_size:i right_index:i",
    "SELECT k AS left_size, 0 AS left_index, 13 - k AS right_size, 0 AS right_index FROM range(2, 7) t(k) UNION ALL SELECT k, i, 14 - k, j FROM range(2, 8) t(k), range(1, 8) a(i), range(1, 8) b(j) WHERE i <= k // 2 AND j <= (14 - k) // 2 AND (k <> 14 - k OR i <= j)",
)
_add("events_top_users", lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(_layers(s, _LRX6).select(C.ranked(F.col("state"), 6).alias("r"), "layer")), F.col("user_id") % 720 == F.col("r")).groupBy("layer").agg(F.sum("n").alias("events")), "layer:i events:i", "SELECT d AS layer, count(*) AS events FROM events JOIN perms ON r = user_id % 720 JOIN l ON l.s = perms.s GROUP BY d", f"{_P6}, {_bfs_sql(_LRX6, 15)}")


def _walk_edges(mode: str) -> Query:
    """How many of 100 walks took an edge at each step."""

    def run(spark: SparkSession, _: str) -> DataFrame:
        rows = walks.random_walks(spark, _LRX6, 100, 8, mode, seed=5)
        before = rows.select("walk_id", (F.col("step") + 1).alias("step"), F.col("state").alias("before"))
        near = F.array_contains(C.neighbours(_LRX6, F.col("before")), F.col("state"))
        return rows.join(before, ["walk_id", "step"]).filter(near).groupBy("step").agg(F.count(F.lit(1)).alias("edges"))

    return run


_add("walks_classic_edges", _walk_edges("classic"), "step:i edges:i", "SELECT step, 100 AS edges FROM range(1, 8) t(step)")
