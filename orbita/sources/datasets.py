"""Growth tables: files of layer sizes by key, the catalogue of tables with the grids of keys to compute, and upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions import perm
from orbita.operators.bfs import bfs
from orbita.plans import library as L
from orbita.plans import puzzles
from orbita.plans.definition import GraphDef


def scan(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(dataset, key, layer, size) from a CSV of a key and a JSON list of sizes; sizes beyond 64 bits are exact."""
    rows = spark.read.schema("key string, value string").option("quote", '"').option("escape", '"').csv(path)
    return rows.select(F.lit(dataset).alias("dataset"), "key", F.posexplode(F.from_json("value", "array<decimal(38,0)>")).alias("layer", "size"))


def missing_keys(wanted: DataFrame, known: DataFrame) -> DataFrame:
    return wanted.join(known.select("key").distinct(), "key", "left_anti")


def upsert(known: DataFrame, wanted: DataFrame, compute: Callable[[str], list[int]]) -> DataFrame:
    """``known`` (key, layer, size) and the rows of keys that it lacks, computed on the driver, one by one: keys are graphs to explore, so they are few."""
    spark = known.sparkSession
    rows = [(r["key"], k, Decimal(size)) for r in missing_keys(wanted, known).orderBy("key").collect() for k, size in enumerate(compute(r["key"]))]
    more = spark.createDataFrame(rows, "key string, layer int, size decimal(38,0)")
    return known.select("key", "layer", F.col("size").cast("decimal(38,0)").alias("size")).unionByName(more)


def write(rows: DataFrame, path: str) -> None:
    """One line for each key, by length of key, then key."""
    lists = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("layer", "size"))).alias("s"))
    lists.select("key", F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["size"].cast("string")), ", "), F.lit("]")).alias("value")).orderBy(F.length("key"), "key").coalesce(1).write.mode("overwrite").csv(path)


def key_grid(spark: SparkSession, first: int, last: int, k_from: int, k_to: int) -> DataFrame:
    """Keys "n,k" with k up to n."""
    n = spark.range(first, last + 1).select(F.col("id").alias("n"))
    return n.select("n", F.explode(F.sequence(F.lit(k_from).cast("bigint"), F.least(F.lit(k_to).cast("bigint"), F.col("n")))).alias("k")).select(F.concat_ws(",", "n", "k").alias("key"), "n", "k")


@dataclass(frozen=True)
class Table:
    """A growth table: its keys, and for each the graph whose layers count, or the sizes themselves where a formula has them."""

    keys: tuple[str, ...]
    graph: Callable[[str], GraphDef] | None = None
    formula: Callable[[str], list[int]] | None = None

    def sizes(self, spark: SparkSession, key: str) -> list[int]:
        return self.formula(key) if self.formula else bfs(spark, self.graph(key), max_layer_size_to_store=0).sizes


def _numbers(first: int, last: int) -> tuple[str, ...]:
    return tuple(map(str, range(first, last + 1)))


def _pairs(ns: Iterable[int], most: int = 10**9) -> tuple[str, ...]:
    return tuple(f"{n},{k}" for n in ns for k in range(2, min(n, most) + 1))


def _by_n(family: Callable[[int], GraphDef]) -> Callable[[str], GraphDef]:
    return lambda key: family(int(key))


def _by_list(family: Callable[..., GraphDef]) -> Callable[[str], GraphDef]:
    return lambda key: family(*map(int, key.split(",")))


def _coset(family: Callable[[int], GraphDef]) -> Callable[[str], GraphDef]:
    return lambda key: family(len(key)).with_central(key)


#: Binary strings of 3 to 29 places, half of them ones: in turn, and sorted.
_STRINGS = tuple(s for n in range(3, 30) for s in ("01" * (n // 2) + "0" * (n % 2), "0" * (n - n // 2) + "1" * (n // 2)))
CATALOGUE: dict[str, Table] = {
    "lrx_coset_growth": Table(_STRINGS, _coset(L.lrx)),
    "top_spin_coset_growth": Table(tuple(s for s in _STRINGS if len(s) >= 4), _coset(L.top_spin)),
    "hungarian_rings_growth": Table(tuple(",".join(map(str, v)) for n in range(2, 10) for v in puzzles.ring_variants(n)), _by_list(puzzles.hungarian_rings)),
    "heisenberg_growth": Table(tuple(f"{n},{m}" for n in range(3, 11) for m in range(2, 51) if m ** (2 * n - 3) <= 2e6), _by_list(L.heisenberg)),
    "wrapped_k_cycles_cayley_growth": Table(_pairs(range(2, 10)), _by_list(L.wrapped_k_cycles)),
    "increasing_k_cycles_cayley_growth": Table(_pairs(range(3, 10), 5), _by_list(L.increasing_k_cycles)),
    "consecutive_k_cycles_cayley_growth": Table(_pairs(range(3, 10), 5), _by_list(L.consecutive_k_cycles)),
    "all_transpositions_cayley_growth": Table(_numbers(2, 30), formula=lambda key: perm.stirling_growth(int(key))),
    "coxeter_cayley_growth": Table(_numbers(2, 30), formula=lambda key: perm.mahonian_growth(int(key))),
}
for _names, _first, _last in (
    ("lrx lx stars", 3, 11),
    ("top_spin", 4, 11),
    ("transposons pancake full_reversals cyclic_coxeter rapaport_m1 rapaport_m2 down_cycles prefix_cycles", 2, 10),
    ("burnt_pancake signed_reversals", 1, 7),
    ("all_cycles larx", 2, 7),
    ("block_interchange", 3, 9),
    ("lsl_cycles", 4, 7),
):
    CATALOGUE |= {f"{f}_cayley_growth": Table(_numbers(_first, _last), _by_n(L.FAMILIES[f])) for f in _names.split()}
for _n, _last in ((2, 10), (3, 5)):
    for _name, _family in (("fund_roots", L.sl_fundamental_roots), ("root_weyl", L.sl_root_weyl)):
        CATALOGUE[f"sl_{_n}_{_name}_growth"] = Table(_numbers(2, _last), lambda key, n=_n, f=_family: f(n, modulo=int(key)))


def generate(spark: SparkSession, folder: str, names: Iterable[str] | None = None) -> None:
    """Brings the tables under ``folder`` (a path that Spark writes, a folder for each table) up to the catalogue: keys that a table lacks are computed, others stay as they are."""
    for name in names or CATALOGUE:
        table = CATALOGUE[name]
        wanted = spark.createDataFrame([(k,) for k in table.keys], "key string")
        known = scan(spark, f"{folder}/{name}", name) if Path(f"{folder}/{name}").is_dir() else spark.createDataFrame([], "key string, layer int, size decimal(38,0)")
        known = spark.createDataFrame(known.select("key", "layer", "size").collect(), "key string, layer int, size decimal(38,0)")  # a few numbers a key; the files are written anew
        write(upsert(known, wanted, lambda key, t=table: t.sizes(spark, key)), f"{folder}/{name}")
