"""Shared storage for layers of a search: what one layer needs of earlier ones is read from files, so lineage stays short and executors may be lost."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.plans.definition import GraphDef, Matrix


_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which all machines share; it's removed when the application ends.

    Where that is unset, a temporary folder serves a session on one machine; on a cluster it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="orbita-")
        spark.conf.set("spark.checkpoint.dir", path)
    root = f"{path.rstrip('/')}/orbita-{spark.sparkContext.applicationId}"
    if root not in _made:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _made.add(root)
    return root


class LayerStore:
    """Layers as Parquet under one folder; several are read as one frame."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{shared_dir(spark)}/layers-{uuid.uuid4().hex}"

    def put(self, layer: int | str, df: DataFrame) -> int:
        """Writes a layer; returns its number of rows, counted from the files' footers."""
        df.write.parquet(f"{self.path}/{layer}")
        return self.get(layer).count()

    def get(self, *layers: int | str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{k}" for k in layers))


def save_definition(graph: GraphDef) -> str:
    """A graph's definition as JSON."""
    gens = [{"rows": g.rows, "modulo": g.modulo} if isinstance(g, Matrix) else list(g) for g in graph.generators]
    return json.dumps({"generators": gens, "names": graph.names, "central": graph.central, "name": graph.name})


def load_definition(text: str) -> GraphDef:
    d = json.loads(text)
    gens = tuple(Matrix(tuple(map(tuple, g["rows"])), g["modulo"]) if isinstance(g, dict) else tuple(g) for g in d["generators"])
    return GraphDef(gens, tuple(d["names"]), tuple(d["central"]), d["name"])


def save_layers(layers: DataFrame, graph: GraphDef, path: str) -> None:
    """(layer, state) by layer, and the definition, under ``path``."""
    layers.write.partitionBy("layer").parquet(f"{path}/layers")
    layers.sparkSession.createDataFrame([(save_definition(graph),)], "definition string").coalesce(1).write.text(f"{path}/definition")


def load_layers(spark: SparkSession, path: str) -> tuple[DataFrame, GraphDef]:
    graph = load_definition(spark.read.text(f"{path}/definition").first()["value"])
    return spark.read.schema("layer int, state array<bigint>").parquet(f"{path}/layers").select(F.col("layer").cast("int"), "state"), graph
