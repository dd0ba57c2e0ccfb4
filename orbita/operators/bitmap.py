"""Breadth-first search over permutations as bitmaps: a bit for each rank, 64 ranks to a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions.columns import neighbours, ranked, unranked
from orbita.functions.perm import identity
from orbita.plans.definition import GraphDef, Kind
from orbita.sources.storage import LayerStore

SCHEMA = "word bigint, bits bigint"
#: 21! exceeds 64 bits.
MOST = 20


def words(ranks: DataFrame) -> DataFrame:
    """(word, bits) of a column ``rank``: its ranks' bits together, which partial aggregation joins before rows move."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("rank", F.lit(64)).cast("int"))
    return ranks.select(F.call_function("div", F.col("rank"), F.lit(64).cast("bigint")).alias("word"), bit.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def ranks(rows: DataFrame) -> DataFrame:
    """A column ``rank`` of the bits that are set."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    return rows.select(F.explode(F.transform(places, lambda i: F.col("word") * 64 + i)).alias("rank"))


def bfs_bitmap(spark: SparkSession, graph: GraphDef, max_diameter: int = 10**6) -> list[int]:
    """Sizes of the layers around the identity, of all permutations of at most MOST elements.

    What has been seen is a bitmap of n! bits at most, merged and written once for each layer; a layer's new states are its bits that the bitmap lacks. So states move as words of
    64 ranks, and graphs that aren't closed under inverses cost no more than others.
    """
    n = graph.state_size
    if graph.kind is not Kind.PERMUTATION or list(graph.central) != identity(n) or n > MOST:
        raise ValueError(f"a bitmap needs permutations of at most {MOST} elements, and the identity as the central state")
    store = LayerStore(spark, SCHEMA)
    first = words(spark.range(1).select(F.lit(0).cast("bigint").alias("rank")))
    store.put("new-0", first)
    store.put("seen-0", first)
    sizes = [1]
    while len(sizes) <= max_diameter:
        k = len(sizes)
        around = ranks(store.get(f"new-{k - 1}")).select(F.explode(neighbours(graph, unranked(F.col("rank"), n))).alias("state"))
        found = words(around.select(ranked(F.col("state"), n).alias("rank")))
        seen = store.get(f"seen-{k - 1}")
        fresh: Column = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("bigint"))))
        new = found.join(seen.withColumnRenamed("bits", "old"), "word", "left").select("word", fresh.alias("bits")).filter("bits <> 0")
        if not store.put(f"new-{k}", new):
            break
        sizes.append(store.get(f"new-{k}").agg(F.sum(F.bit_count("bits"))).first()[0])
        store.put(f"seen-{k}", seen.unionByName(store.get(f"new-{k}")).groupBy("word").agg(F.bit_or("bits").alias("bits")))
    return sizes
