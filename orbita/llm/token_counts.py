"""Exact counts of tokens: a histogram of encoded lengths, whose suffix sums answer totals, quantiles and truncated totals for every limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbita.llm.shared import cut, id_text

_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """One tiktoken encoding for each rank file and worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def encoded_lengths(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): the exact number of tokens of each whole text; strings of special tokens count as ordinary text. Null is empty: 0.

    A row for each row, whatever its id; an empty table gives an empty one. Other columns of ``docs`` aren't read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(count, "doc_id bigint, n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs), a row for each length that occurs: counted in each task first, so at most a row for each length and task moves. None for no documents."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = 4096) -> DataFrame:
    """Adds to each length L: docs_ge and tokens_ge (documents of at least L tokens, and their tokens), docs_lt, and
    truncated_total (tokens left if every document is cut to L tokens).

    An empty histogram gives an empty table. The histogram is written once, as its two readers would encode all texts twice. Sums run inside blocks of ``block`` lengths, and over the blocks' totals: as many of these as the longest document has blocks, whatever the number of documents.
    """
    h = cut(histogram, "histogram").withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / block))
    down = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = totals.select("block", F.coalesce(F.sum("d").over(down), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(down), F.lit(0)).alias("t_after"), F.sum("d").over(Window.partitionBy()).alias("all_docs"), F.sum("t").over(Window.partitionBy()).alias("all_tokens"))
    own = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    out = h.join(after, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(own) + F.col("d_after")).alias("docs_ge"),
        (F.sum("tokens").over(own) + F.col("t_after")).alias("tokens_ge"),
        "all_docs",
        "all_tokens",
    )
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("all_docs") - F.col("docs_ge")).alias("docs_lt"),
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
    )


def truncated_total(sums: DataFrame, limit: Column) -> Column:
    """The tokens left under any ``limit``, as an aggregate over :func:`suffix_sums`: lengths up to it count whole, longer ones as ``limit``."""
    return F.sum(F.least(F.col("n_tokens"), limit) * F.col("n_docs"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, total, truncated, lost, docs_over) for each context limit of a list, in one pass over the histogram."""
    per = [
        F.struct(
            F.lit(k).cast("bigint").alias("context"),
            F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("total"),
            F.coalesce(truncated_total(sums, F.lit(k)), F.lit(0)).alias("truncated"),
            F.coalesce(F.sum(F.greatest(F.col("n_tokens") - k, F.lit(0)) * F.col("n_docs")), F.lit(0)).alias("lost"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > k, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        )
        for k in limits
    ]
    return sums.agg(F.array(*per).alias("x")).select(F.inline("x"))


def quantiles(sums: DataFrame, qs: list[float]) -> DataFrame:
    """(q, n_tokens): the least length that at least q of the documents don't exceed. No rows where there are no documents."""
    n = F.col("docs_lt") + F.col("docs_ge")
    at_most = F.col("docs_lt") + F.col("n_docs")
    per = [F.struct(F.lit(q).cast("double").alias("q"), F.min(F.when(at_most >= F.ceil(F.lit(q) * n), F.col("n_tokens"))).alias("n_tokens")) for q in qs]
    return sums.agg(F.array(*per).alias("x")).select(F.inline("x")).filter("n_tokens is not null")
