"""Distances of states that arrive as a stream, looked up in a static table of layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_distances(stream: DataFrame, layers: DataFrame) -> DataFrame:
    """A stream of (state, ...) with ``distance``: a stream-static join, so nothing of the stream is kept as state."""
    first = layers.groupBy("state").agg(F.min("layer").alias("distance"))
    return stream.join(first, "state", "left")
