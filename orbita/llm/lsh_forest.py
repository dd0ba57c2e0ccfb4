"""Near-duplicates by MinHash and an LSH forest.

A document's set is its distinct k-word shingles. Each tree of the forest orders all documents by a signature of its own; documents that
agree on a long prefix stand side by side. Candidates are neighbours with a common prefix of at least ``MIN_DEPTH`` values: all of them where
few documents share a prefix, else those that share a longer one, as deep as the region needs. Candidates are confirmed on full sets,
and links are joined into components without gathering them in one place.

A prefix that many documents share is crowded. It has a pivot, the document whose prefixes are the most crowded of all, and each document is
compared with the pivot that suits it best. Where documents of a crowded prefix then still are of different components, each is written as what it shares with
the pivot, a bit for each shingle, and what it has besides; that gives exact intersections of any two of them by products of matrices, in blocks
of bounded size. So all pairs that share a prefix in some tree are settled on full sets, unless their documents are in one component already.

Rows are known by (rid, th), see :func:`orbita.llm.shared.keyed`: rows of one id and different texts are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbita.llm.bytes_np import groups, mix, shingle_sets, utf8
from orbita.llm.shared import NO_ID, cut, keyed, width, with_keys

TREES = 20
DEPTH = 8
#: At a similarity of 0.85 a pair shares 4 values of a tree with probability 0.52, and of none of 20 trees with 4e-7; at 0.8, 3e-5.
MIN_DEPTH = 4
#: A prefix that more documents share is followed to greater depth, and is crowded.
REGION = 8
#: Neighbours of each document that are candidates however many share its prefix.
NEAREST = 2
#: Documents of a crowded prefix are compared in blocks of about so many, or so many bytes, of one side and of the other.
BLOCK, OTHER_BLOCK, BLOCK_BYTES = 512, 2048, 8 << 20
#: Columns of a matrix at once.
COLUMNS = 2048

_rng = np.random.default_rng(85_16_20)
_A = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def signature(values: np.ndarray) -> bytes:
    """TREES * DEPTH minima, 16 bits of each, big-endian, so that their bytes order as they do."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        np.minimum(low, (values[None, at : at + 2048] * _A[:, None] + _C[:, None]).min(axis=1), out=low)
    return (mix(low) >> np.uint64(48)).astype(">u2").tobytes()


def sketches(texts: DataFrame, k: int) -> DataFrame:
    """(doc_id, rid, th, n_shingles, set_key, signature) of keyed texts: the set's size, 128 bits of its content, and its minima. Empty sets have keys of their own and no signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(3))
            own = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            size, key, sig = [], [], []
            for lo, hi in groups(offsets):
                for i, s in enumerate(shingle_sets(offsets[lo : hi + 1], data, k), lo):
                    size.append(len(s))
                    key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"empty:%d:%d" % own[i])
                    sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "rid", "th", "n_shingles", "set_key", "signature"])

    return texts.mapInArrow(run, "doc_id bigint, rid bigint, th bigint, n_shingles bigint, set_key binary, signature binary")


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows, in values; 0 for rows of different trees (column 0)."""
    same = np.logical_and.accumulate(x == y, axis=1)
    return np.where(same[:, 0], same.sum(axis=1) - 1, 0)


def neighbours(keys: np.ndarray, sizes: np.ndarray, new: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of sorted rows, as places, of which the first ``new`` only are partners of later ones. Pairs whose sizes exclude the similarity are left out."""
    n = len(sizes)
    depth = np.full((REGION + 1, n), 0, np.int8)
    for o in range(1, REGION + 1):
        if n > o:
            depth[o, o:] = _common(keys[o:], keys[:-o])
    # how many of the rows before share MIN_DEPTH, MIN_DEPTH + 1, ... values; the depth at which they are few enough
    need = np.full(n, MIN_DEPTH, np.int8)
    crowd = depth[REGION] >= MIN_DEPTH
    need[crowd] = np.minimum(depth[REGION][crowd] + 1, DEPTH)
    left, right = [], []
    for o in range(1, REGION + 1):
        take = depth[o] >= (MIN_DEPTH if o <= NEAREST else need)
        take[:new] = False
        at = np.flatnonzero(take)
        small, large = np.minimum(sizes[at], sizes[at - o]), np.maximum(sizes[at], sizes[at - o])
        at = at[small >= least * large]
        left.append(at - o)
        right.append(at)
    return np.concatenate(left), np.concatenate(right)


_ROW = ["key", "rid", "th", "n_shingles"]
_EDGE = ["a", "a2", "b", "b2"]
_EDGE_KIND = ", ".join(f"{c} bigint" for c in _EDGE)


def _pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (tree and signature, rid, th, n_shingles) in order. Also gives the outermost rows back, as neighbours may lie in the next task."""
        kept = None
        first: list = []
        for batch in batches:
            rows = [np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u2").reshape(batch.num_rows, DEPTH + 1), *(batch.column(c).to_numpy() for c in (1, 2, 3))]
            if len(first) < REGION:
                first += _listed([x[: REGION - len(first)] for x in rows])
            new = 0
            if kept is not None:
                new = len(kept[1])
                rows = [np.concatenate([x, y]) for x, y in zip(kept, rows, strict=True)]
            x, y = neighbours(rows[0], rows[3], new, percent / 100)
            kept = [r[-REGION:] for r in rows]
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[c][at]) for at in (x, y) for c in (1, 2)), pa.nulls(len(x), pa.binary()), none, none, none], names=_EDGE + _ROW)
        if kept is not None:
            key, *rest = zip(*dict.fromkeys([*first, *_listed(kept)]), strict=True)
            none = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(key, pa.binary()), *(pa.array(c, pa.int64()) for c in rest)], names=_EDGE + _ROW)

    return run


def _listed(rows: list[np.ndarray]) -> list[tuple]:
    return [(rows[0][i].tobytes(), *(int(c[i]) for c in rows[1:])) for i in range(len(rows[1]))]


def candidates(representatives: DataFrame, percent: int) -> DataFrame:
    """(a, a2, b, b2), distinct: neighbours in some tree's order. Rows are dealt by range, so a prefix that many share spreads over tasks."""
    n = width(representatives.sparkSession)
    trees = representatives.select(F.explode(F.array(*(F.concat(F.unhex(F.lit(f"{t:04x}")), F.substring("signature", 1 + 2 * DEPTH * t, 2 * DEPTH)) for t in range(TREES)))).alias("key"), *_ROW[1:])
    kind = f"{_EDGE_KIND}, key binary, rid bigint, th bigint, n_shingles bigint"
    # the tree's number opens the key as one 16-bit value
    ordered = trees.repartitionByRange(n, *_ROW[:3]).sortWithinPartitions(*_ROW[:3])
    found = cut(ordered.mapInArrow(_pairs(percent), kind), "candidates")
    # the ends of the tasks' ranges, at most 2 * REGION rows of each task, in one order again
    ends = found.filter("key is not null").select(*_ROW).coalesce(1).sortWithinPartitions(*_ROW[:3]).mapInArrow(_pairs(percent), kind)
    return _ordered(found.filter("a is not null").select(*_EDGE).unionByName(ends.filter("a is not null").select(*_EDGE))).distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair of different rows with the lesser one first."""
    one, two = F.struct("a", "a2"), F.struct("b", "b2")
    flip = one > two
    return pairs.filter(one != two).select(*(F.when(flip, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("a2", "b2"), ("b", "a"), ("b2", "a2"))))


def texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(rid, th, text) of the rows that pairs name, one for each."""
    names = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("rid"), F.col("a2").alias("th")), F.struct(F.col("b").alias("rid"), F.col("b2").alias("th")))).alias("x"))
    names = cut(names.select("x.*").distinct(), "named")
    # shuffled at every size, so that disk grows as the input does
    some = cut(texts.select("rid", "th", "text").join(names.hint("merge"), ["rid", "th"], "left_semi"), "some_texts")
    # rows equal in id and text come more than once; they are only put together where there are any
    return some if some.count() == names.count() else cut(some.dropDuplicates(["rid", "th"]), "some_texts")


_COMPARED = "linked boolean, n bigint, shared bigint, bits binary, extra binary"


def compared(pairs: DataFrame, texts: DataFrame, k: int, percent: int, parts: bool = False) -> DataFrame:
    """Pairs with ``linked``: whether their full sets meet the similarity. With ``parts``, a as seen from b: its size, what they share,
    a bit for each of b's shingles that says whether a has it, and a's other shingles (64 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                linked = np.zeros(batch.num_rows, bool)
                more: list[tuple] = []
                sides = []
                for c in (4, 5):
                    offsets, data = utf8(batch.column(c))
                    sides.append([s for x, y in groups(offsets) for s in shingle_sets(offsets[x : y + 1], data, k)])
                for i, (x, y) in enumerate(zip(*sides, strict=True)):
                    has = np.isin(y, x, assume_unique=True)
                    both = int(has.sum())
                    linked[i] = both and 100 * both >= percent * (len(x) + len(y) - both)
                    if parts:
                        more.append((len(x), both, np.packbits(has).tobytes(), np.setdiff1d(x, y, assume_unique=True).tobytes()))
                columns = zip(*more, strict=True) if parts else [[None] * batch.num_rows] * 4
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(linked), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*_EDGE, "linked", "n", "shared", "bits", "extra"])

    one = pairs.join(texts.select(F.col("rid").alias("a"), F.col("th").alias("a2"), F.col("text").alias("text_a")), ["a", "a2"])
    two = one.join(texts.select(F.col("rid").alias("b"), F.col("th").alias("b2"), F.col("text").alias("text_b")), ["b", "b2"])
    return two.select(*_EDGE, "text_a", "text_b").mapInArrow(run, f"{_EDGE_KIND}, {_COMPARED}")


def crowded(representatives: DataFrame) -> DataFrame:
    """(tree, bucket, rid, th, pivot, pivot2, weight): rows of the prefixes that more than REGION + 1 documents share.

    A document's weight is the number of documents under its crowded prefixes, over all trees. The pivot of a prefix is its document of greatest weight: one that many
    others are copies of has their most frequent prefix in each tree.
    """
    rows = representatives.select(F.posexplode(F.array(*(F.substring("signature", 1 + 2 * DEPTH * t, 2 * MIN_DEPTH) for t in range(TREES)))).alias("tree", "bucket"), "rid", "th")
    many = cut(rows.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > REGION + 1), "crowded")
    crowd = cut(rows.join(many, ["tree", "bucket"]), "crowd")
    weights = cut(crowd.groupBy("rid", "th").agg(F.sum("held").alias("weight")), "weights")
    crowd = cut(crowd.drop("held").join(weights, ["rid", "th"]), "crowd")
    pivots = crowd.groupBy("tree", "bucket").agg(F.min(F.struct((-F.col("weight")).alias("weight"), F.col("rid").alias("pivot"), F.col("th").alias("pivot2"))).alias("p"))
    pivots = cut(pivots.select("tree", "bucket", "p.pivot", "p.pivot2", (-F.col("p.weight")).alias("top")), "pivots")
    return cut(crowd.drop("weight").join(pivots, ["tree", "bucket"]), "crowd")


def _matrix(owner: np.ndarray, column: np.ndarray, rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns), np.float32)
    out[owner, column] = 1
    return out


def _shared_extras(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each array of ``left`` has in common with each of ``right``; values are distinct in each array."""
    total = np.zeros((len(left), len(right)), np.float32)
    x, y = (np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (left, right))
    both = np.intersect1d(x, y)
    sides = []
    for values, arrays in ((x, left), (y, right)):
        owner = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
        at = np.searchsorted(both, values)
        good = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == values) if len(both) else np.zeros(0, np.int64)
        order = good[np.argsort(at[good], kind="stable")]
        sides.append((owner[order], at[order]))
    for lo in range(0, len(both), COLUMNS):
        hi = min(lo + COLUMNS, len(both))
        parts = []
        for owner, at in sides:
            a, b = np.searchsorted(at, (lo, hi))
            parts.append(_matrix(owner[a:b], at[a:b] - lo, len(left) if owner is sides[0][0] else len(right), hi - lo))
        total += parts[0] @ parts[1].T
    return total


def _across(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links across components of two blocks of one pivot: for each row of one, one row at most of each component of the other."""
        ids, ids2, sizes = (table.column(c).to_numpy() for c in ("rid", "th", "n"))
        comps = np.unique(np.stack([table.column(c).to_numpy() for c in ("component", "component2")]), axis=1, return_inverse=True)[1].ravel()
        side = table.column("side").to_numpy(zero_copy_only=False)
        bits, extra = table.column("bits").to_pylist(), table.column("extra").to_pylist()
        within = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        left = np.arange(len(ids)) if within else np.flatnonzero(~side)
        right = left if within else np.flatnonzero(side)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(left) and len(right) and (comps[left].min() != comps[right].max() or comps[left].max() != comps[right].min()):
            common = _shared_extras(*([np.frombuffer(extra[i], np.uint64) for i in s] for s in (left, right)))
            packed = [np.frombuffer(b"".join(bits[i] for i in s), np.uint8).reshape(len(s), -1) for s in (left, right)]
            for lo in range(0, packed[0].shape[1], COLUMNS // 8):
                a, b = (np.unpackbits(p[:, lo : lo + COLUMNS // 8], axis=1).astype(np.float32) for p in packed)
                common += a @ b.T
            both = np.rint(common).astype(np.int64)
            take = (both > 0) & (100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)) & (comps[left][:, None] != comps[right][None, :])
            i, j = np.nonzero(take)
            _, once = np.unique(left[i] * (int(comps.max()) + 1) + comps[right[j]], return_index=True)
            found.append((left[i[once]], right[j[once]]))
        x, y = found[0] if found else (np.zeros(0, np.int64),) * 2
        return pa.table({name: pa.array(v[at], pa.int64()) for name, v, at in (("a", ids, x), ("a2", ids2, x), ("b", ids, y), ("b2", ids2, y))})

    return run


def across(parts: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between rows of one pivot that are of different components. ``parts`` has rows (b: the pivot, a: a document of it).

    The largest component of a pivot has blocks of its own, which only meet those of the others.
    """
    rows = _placed(parts.select(F.col("a").alias("rid"), F.col("a2").alias("th"), F.col("b").alias("pivot"), F.col("b2").alias("pivot2"), "n", "bits", "extra"), found)
    of = ["pivot", "pivot2"]
    weight = F.sum(F.octet_length("bits") + F.octet_length("extra") + F.lit(64))
    counts = rows.groupBy(*of, "component", "component2").agg(F.count(F.lit(1)).alias("n"), weight.alias("bytes"))
    big = F.max_by(F.struct("component", "component2", "n", "bytes"), F.struct("n", "component", "component2"))
    sums = counts.groupBy(*of).agg(big.alias("big"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).filter(F.col("n") > F.col("big.n"))

    def blocks(n: Column, size: Column, most: int) -> Column:
        return F.greatest(F.ceil(n / most), F.ceil(size / BLOCK_BYTES)).cast("int")

    sums = sums.select(
        *of,
        F.col("big.component").alias("big"),
        F.col("big.component2").alias("big2"),
        blocks(F.col("n") - F.col("big.n"), F.col("bytes") - F.col("big.bytes"), BLOCK).alias("small_blocks"),
        blocks(F.col("big.n"), F.col("big.bytes"), OTHER_BLOCK).alias("big_blocks"),
    )
    rows = cut(rows, "parts").join(cut(sums, "sizes"), of)
    small = (F.col("component") != F.col("big")) | (F.col("component2") != F.col("big2"))
    rows = rows.withColumn("own", F.when(small, F.expr("pmod(th, small_blocks)")).otherwise(F.expr("small_blocks + pmod(th, big_blocks)")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(small, F.col("small_blocks") + F.col("big_blocks") - 1).otherwise(F.col("small_blocks") - 1))))
    rows = rows.select(*of, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("side"), "rid", "th", "n", "component", "component2", "bits", "extra")
    return _ordered(rows.groupBy(*of, "x", "y").applyInArrow(_across(percent), _EDGE_KIND)).distinct()


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds each row's component: its own (rid, th) where it has no link."""
    joined = rows.join(found, ["rid", "th"], "left")
    return joined.withColumns({"component": F.coalesce("component", "rid"), "component2": F.coalesce("component2", "th")})


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(rid, th, component, component2): the least row that each row of an undirected graph reaches, by alternating large and small stars.

    Each half round sends a node's neighbours to the least of them; the graph keeps its components and becomes stars. Every half round is written
    to the shared folder. Raises RuntimeError if ``rounds`` don't suffice, rather than returning parts of components.
    """

    def step(edges: DataFrame, large: bool) -> DataFrame:
        """Edges (u, v) with u > v."""
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = around.join(cut(least, "least"), "u")  # joined as a written table, so that the centre of a large star can be split
        if large:
            out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        return out.filter("u > v").distinct()

    node = lambda x, y: F.struct(F.col(x).alias("rid"), F.col(y).alias("th"))
    edges = links.select(node("a", "a2").alias("x"), node("b", "b2").alias("y"))
    edges = cut(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u > v").distinct(), "links")
    mark = None
    for _ in range(rounds):
        edges = cut(step(cut(step(edges, True), "links"), False), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            ends = edges.groupBy("u").agg(F.min("v").alias("v"))
            return ends.select("u.rid", "u.th", F.col("v.rid").alias("component"), F.col("v.th").alias("component2"))
        mark = now
    raise RuntimeError(f"components still change after {rounds} rounds")


def joined(representatives: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(rid, th, component, component2) of the rows that have links."""

    def with_links(found: DataFrame | None, links: DataFrame) -> DataFrame:
        links = links.select(*_EDGE)
        if found is not None:
            links = links.unionByName(found.select(F.col("rid").alias("a"), F.col("th").alias("a2"), F.col("component").alias("b"), F.col("component2").alias("b2")))
        return cut(components(links), "components")

    crowd = crowded(representatives)
    # first the neighbours, and for each row of a crowded prefix the best of its pivots
    best = crowd.groupBy("rid", "th").agg(F.max_by(F.struct("pivot", "pivot2"), F.struct("top", "pivot", "pivot2")).alias("p"))
    best = _ordered(best.select(F.col("rid").alias("a"), F.col("th").alias("a2"), F.col("p.pivot").alias("b"), F.col("p.pivot2").alias("b2")))
    pairs = cut(candidates(representatives, percent).unionByName(best).distinct(), "pairs")
    found = with_links(None, cut(compared(pairs, texts_of(pairs, texts), k, percent).filter("linked"), "confirmed"))
    # then what crowded prefixes leave in different components, as seen from their pivots
    place = _placed(crowd, found)
    own = F.struct("component", "component2")
    mixed = cut(place.groupBy("tree", "bucket").agg(F.min(own).alias("low"), F.max(own).alias("high")).filter("low < high").select("tree", "bucket"), "mixed")
    pairs = crowd.join(mixed, ["tree", "bucket"]).select(F.col("rid").alias("a"), F.col("th").alias("a2"), F.col("pivot").alias("b"), F.col("pivot2").alias("b2")).distinct()
    pairs = cut(pairs, "pairs")
    if pairs.isEmpty():
        return found
    parts = cut(compared(pairs, texts_of(pairs, texts), k, percent, parts=True), "compared")
    found = with_links(found, parts.filter("linked"))
    links = cut(across(parts, found, percent), "across")
    return found if links.isEmpty() else with_links(found, links)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked when 100 * intersection >= ``percent`` * union of their k-word shingle sets.

    A row for each row. ``component_id`` is the least id reachable over links, and rows of that id have ``kept``. Texts of fewer words are one shingle;
    null and empty texts have none and stay alone. Equal sets are one class and aren't compared pair by pair. Rows of one id and different texts are
    documents of their own, each with its own links; those equal in both are one. A row without an id comes after all that have one: its component may have an id, or null, and then one
    text of it has ``kept``. An empty table gives an empty one. Other columns of ``docs`` aren't read.
    """
    texts = keyed(docs, id_col, text_col)
    made = cut(sketches(texts.select("doc_id", "rid", "th", "text"), k), "sketches")
    owner = F.min(F.struct("rid", "th"))
    classes = cut(made.groupBy("set_key").agg(owner.alias("own"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")).select("set_key", "own.*", "n_shingles", "signature"), "classes")
    representatives = cut(classes.filter("signature is not null").select("rid", "th", "n_shingles", "signature"), "representatives")
    found = joined(representatives, texts, k, percent)
    owners = cut(_placed(classes.select("set_key", "rid", "th"), found).select("set_key", "component", "component2"), "owners")  # joined as a written table, so that a large class can be split
    out = made.select("doc_id", "rid", "th", "n_shingles", "set_key").join(owners, "set_key")
    lead = (F.col("rid") == F.col("component")) & (F.col("th") == F.col("component2"))
    component = F.when(F.col("component") == NO_ID, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, lead).alias("kept"), "rid", "th", lead.alias("lead"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of :func:`near_duplicates`, with all its columns: the least by id, then by the text's hash; of rows equal in id and text, any one.

    Null and empty texts, and rows without an id whose text is like no other, stay. An empty table stays empty. Columns may have any names.
    """
    marked, key = with_keys(docs, id_col, text_col)
    found = cut(near_duplicates(docs, k, percent, id_col, text_col), "found")
    gone = found.filter(~F.col("lead")).select(F.col("rid").alias(key[0]), F.col("th").alias(key[1])).distinct()
    left = marked.join(gone, key, "left_anti")
    again = cut(found.filter("lead").groupBy("rid", "th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("rid").alias(key[0]), F.col("th").alias(key[1])), "again")
    if not again.isEmpty():
        once = cut(left.join(again, key, "left_semi"), "again_rows").dropDuplicates(key)
        left = left.join(again, key, "left_anti").unionByName(once)
    return left.drop(*key)
