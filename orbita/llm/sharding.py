"""Sharding by bytes with Karmarkar-Karp differencing over groups that stay whole."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbita.llm.shared import cut, id_text

#: Groups that one differencing run holds; runs are combined like groups.
CHUNK = 1 << 14
#: Groups to a bucket: so many while buckets are few, and so many at most, which a task holds at once.
FEW, MOST = 1 << 12, 1 << 18


def difference(tuples: list[tuple[int, ...]], k: int) -> tuple[tuple[int, ...], list[list[int]]]:
    """Combines partial partitions into k parts: the two of largest spread again and again, the largest parts of one with the smallest of the other.

    Each of ``tuples`` has k sums in descending order. Returns the sums in descending order, and for each input the part that each of its k places went to.
    """
    heap = [(t[-1] - t[0], i) for i, t in enumerate(tuples)]
    heapq.heapify(heap)
    nodes: list = [(t, None, None, None) for t in tuples]
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = nodes[a][0], nodes[b][0]
        sums = [x[i] + y[k - 1 - i] for i in range(k)]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        total = tuple(sums[i] for i in order)
        nodes.append((total, a, b, order))
        heapq.heappush(heap, (total[-1] - total[0], len(nodes) - 1))
    if not heap:
        return (0,) * k, []
    went: list = [None] * len(nodes)
    went[-1] = list(range(k))
    for n in range(len(nodes) - 1, len(tuples) - 1, -1):
        _, a, b, order = nodes[n]
        left, right = [0] * k, [0] * k
        for place, i in enumerate(order):
            left[i] = right[k - 1 - i] = went[n][place]
        went[a], went[b], went[n] = left, right, None
    return nodes[-1][0], went[: len(tuples)]


def _leaf(size: int, k: int) -> tuple[int, ...]:
    return (size, *[0] * (k - 1))


def _local(k: int):
    """Parts of the groups of each bucket: runs of CHUNK groups, then the runs' partial partitions among themselves. Rows (bucket, gkey, size) in order of bucket, falling size and key."""

    def solve(rows: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(rows)
        size = table.column(2).to_numpy()
        runs = max(1, -(-len(size) // CHUNK))
        part = np.zeros(len(size), np.int32)
        roots, members = [], []
        for r in range(runs):  # each run gets sizes of the whole range
            at = np.arange(r, len(size), runs)
            total, went = difference([_leaf(int(s), k) for s in size[at]], k)
            roots.append(total)
            members.append(at)
            part[at] = [w[0] for w in went]
        for at, w in zip(members, difference(roots, k)[1], strict=True):
            part[at] = np.array(w, np.int32)[part[at]]
        return table.append_column("part", pa.array(part)).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and hi > lo and held[-1].column(0)[0] != batch.column(0)[lo]:
                    yield from solve(held).to_batches(10_000)
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from solve(held).to_batches(10_000)

    return run


def n_buckets(groups: int) -> int:
    """Buckets for so many groups: a function of their number alone, so that the shards don't depend on the session."""
    return max(min(64, -(-groups // FEW)), -(-groups // MOST), 1)


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard): documents of equal text share a shard, and the shards' bytes are near equal.

    A document's size is the bytes of its text plus 1. Groups of equal texts are summed before they move, then dealt to ``buckets`` by hash, about MOST groups in one at most;
    each bucket is differenced into one partial partition of ``shards`` sums, and the driver differences those: ``shards`` numbers for each bucket.
    ``slot`` counts from 0 in each shard without a gap, and ``grown_shard`` is null.

    Null text is an empty one. Rows of one id, or of none, are rows of their own. Groups of one size go in order of a hash of their text, so the shards are a function of the
    texts and of ``buckets``; another number of buckets deals most groups otherwise, for sums as near. A group larger than a shard's share makes that shard as large as itself.
    An empty table gives an empty one. Other columns of ``docs`` aren't read.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col).select(
        "doc_id", (F.octet_length("text").cast("bigint") + 1).alias("size"), F.crc32("text").alias("text_crc32"), F.unhex(F.md5("text")).alias("gkey")
    )
    groups = cut(rows.groupBy("gkey").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies")), "sizes")
    held = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("copies").alias("rows")).first()
    n = buckets or n_buckets(held["groups"])
    in_order = groups.select(F.pmod(F.xxhash64("gkey"), F.lit(n)).cast("int").alias("bucket"), "gkey", "size").repartition(n, "bucket").sortWithinPartitions("bucket", F.desc("size"), "gkey")
    local = cut(in_order.mapInArrow(_local(shards), "bucket int, gkey binary, size bigint, part int"), "groups")
    sums: dict[int, list[int]] = {}
    for r in local.groupBy("bucket", "part").agg(F.sum("size").alias("size")).collect():
        sums.setdefault(r["bucket"], [0] * shards)[r["part"]] = r["size"]
    order = sorted(sums)
    ranked = {b: sorted(range(shards), key=sums[b].__getitem__, reverse=True) for b in order}
    _, went = difference([tuple(sums[b][p] for p in ranked[b]) for b in order], shards)
    deal = [(b, p, w[place]) for b, w in zip(order, went, strict=True) for place, p in enumerate(ranked[b])]
    where = spark.createDataFrame(deal, "bucket int, part int, shard int")  # buckets * shards rows: one for each 16,384 groups or more, beyond 64 buckets
    owned = cut(local.join(F.broadcast(where), ["bucket", "part"]).select("gkey", "shard"), "owned")  # joined as a written table, so that a large group can be split
    dealt = rows.join(owned, "gkey").select("doc_id", "size", "text_crc32", "shard")
    dealt = cut(dealt.withColumn("row", F.monotonically_increasing_id()), "dealt")
    slots = with_slots(dealt, max(n, -(-(held["rows"] or 0) // MOST)))
    return slots.select("doc_id", "size", "text_crc32", "shard", F.lit(None).cast("int").alias("grown_shard"), "slot")


def with_slots(dealt: DataFrame, salts: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard: counted in ``salts`` even pieces of every shard, so no task holds a whole shard. ``row`` numbers the rows."""
    salted = dealt.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # shards * salts rows
    place = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "row")).cast("bigint") - 1
    return salted.withColumn("place", place).join(F.broadcast(offsets), ["shard", "salt"]).withColumn("slot", F.col("before") + F.col("place")).drop("salt", "before", "place")
