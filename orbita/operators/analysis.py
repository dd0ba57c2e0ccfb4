"""Vertices, edges and matrices of explored graphs, as DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbita.functions.columns import named, neighbours
from orbita.plans.definition import GraphDef
from orbita.sources.storage import shared_dir


def vertices(layers: DataFrame) -> DataFrame:
    """(id, layer, state, name): numbered from 0 by layer, then state. Rows are dealt by ranges of (layer, state) and numbered inside each, so no task holds a layer."""
    spark = layers.sparkSession
    ordered = layers.repartitionByRange("layer", "state").sortWithinPartitions("layer", "state").withColumn("at", F.monotonically_increasing_id())
    path = f"{shared_dir(spark)}/vertices-{uuid.uuid4().hex}"
    ordered.write.parquet(path)  # ranges are drawn from a sample, so they are fixed once
    rows = spark.read.schema(ordered.schema).parquet(path).withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
    return rows.join(F.broadcast(before), "part").select((F.col("before") + place).alias("id"), "layer", "state", named(F.col("state")).alias("name"))


def undirected_graph(graph: GraphDef, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and numbered edges for export as an undirected graph; ValueError unless the generators are closed under inverses."""
    if not graph.inverse_closed:
        raise ValueError("only graphs closed under inverses are undirected")
    numbered = vertices(layers)
    pairs = indexed_edges(graph, numbered).select("src", "dst")
    return numbered, undirected(pairs)


def edges(graph: GraphDef, states: DataFrame) -> DataFrame:
    """(gen_id, src, dst): an edge for each state and generator, duplicates kept."""
    return states.select(F.col("state").alias("src"), F.posexplode(neighbours(graph, F.col("state"))).alias("gen_id", "dst")).select("gen_id", "src", "dst")


def truncated_edges(graph: GraphDef, layers: DataFrame) -> DataFrame:
    """Edges of a search that was cut off: from all layers but the last, and those into the last one reversed as well."""
    last = layers.agg(F.max("layer").alias("last"))
    inner = layers.join(F.broadcast(last), F.col("layer") < F.col("last"))
    forward = inner.select("layer", "last", F.col("state").alias("src"), F.posexplode(neighbours(graph, F.col("state"))).alias("gen_id", "dst"))
    back = forward.filter("layer = last - 1").select("gen_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return forward.select("gen_id", "src", "dst").unionByName(back)


def indexed_edges(graph: GraphDef, vertex: DataFrame) -> DataFrame:
    """(src, dst, gen_id) by vertex numbers; both joins are on exact states."""
    all_edges = edges(graph, vertex.select("state"))
    a = vertex.select(F.col("id").alias("src_id"), F.col("state").alias("src"))
    b = vertex.select(F.col("id").alias("dst_id"), F.col("state").alias("dst"))
    return all_edges.join(a, "src").join(b, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "gen_id")


def undirected(named_edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs of (src, dst); loops stay."""
    return named_edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def edge_names(graph: GraphDef, states: DataFrame) -> DataFrame:
    """(src, dst, gen_id, name): the first generator of each pair."""
    names = F.array(*(F.lit(n) for n in graph.names))
    return edges(graph, states).groupBy("src", "dst").agg(F.min("gen_id").alias("gen_id")).withColumn("name", F.get(names, F.col("gen_id")))


def adjacency(numbered: DataFrame, multiple: bool = False) -> DataFrame:
    """(row, col, value) with 1 for each pair, or for each edge if ``multiple``."""
    out = numbered.select(F.col("src").alias("row"), F.col("dst").alias("col"))
    return (out if multiple else out.distinct()).withColumn("value", F.lit(1))


def laplacian(matrix: DataFrame) -> DataFrame:
    """Row sums on the diagonal, less the matrix; zeros are left out."""
    diagonal = matrix.groupBy("row").agg(F.sum("value").alias("value")).select("row", F.col("row").alias("col"), "value")
    return diagonal.unionByName(matrix.select("row", "col", (-F.col("value")).alias("value"))).groupBy("row", "col").agg(F.sum("value").alias("value")).filter("value <> 0")


def summary(layers: DataFrame) -> DataFrame:
    return layers.agg(F.count(F.lit(1)).alias("n_vertices"), F.max("layer").cast("bigint").alias("diameter"))


def bitmap(ranks: DataFrame, chunk: int = 40320) -> DataFrame:
    """(chunk, bits): ranks as bitmaps of ``chunk`` each; sets are counted with bitmap_count."""
    bucket, place = F.floor(F.col("rank") / chunk), F.col("rank") % chunk
    return ranks.select(bucket.alias("chunk"), F.floor(place / 64).alias("word"), F.expr(f"shiftleft(1L, cast(rank % {chunk} % 64 as int))").alias("bit")).groupBy("chunk", "word").agg(F.bit_or("bit").alias("bits"))

