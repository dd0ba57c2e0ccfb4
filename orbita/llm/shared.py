"""Shared storage: where lineage is cut and where files of more than one task live."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.sources.storage import shared_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: what follows survives lost executors and runs ``df`` once."""
    path = fresh_path(df.sparkSession, name)
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")  # once written, nothing reads this query's shuffle files again
    try:
        df.write.parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows without an id come after all others.
NO_ID = (1 << 63) - 1


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    own = F.col(f"`{id_col}`").cast("bigint")
    return F.coalesce(own, F.lit(NO_ID)), F.xxhash64(own, _text(text_col))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, th, text): only what an operator reads, so other columns can't clash. Null text becomes empty.

    (rid, th) tells rows apart that share an id, by 64 bits of their texts; only rows equal in id and text share it. Rows without an id have NO_ID as rid.
    Joins use both, so that an id that many rows share, or that they lack, spreads.
    """
    rid, th = _key(id_col, text_col)
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), rid.alias("rid"), th.alias("th"), _text(text_col).alias("text"))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to clash with no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with the key of :func:`keyed` in two more columns, and their names, which no column of ``docs`` has."""
    names = free_names(docs, "rid", "th")
    return docs.withColumns(dict(zip(names, _key(id_col, text_col), strict=True))), names


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, as (doc_id, text); null text becomes empty. Other columns can't clash."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
