"""Removal of long strings that a corpus holds twice, by two-stage suffix sorting of the places where repeats begin and end.

Which ``length``-byte strings occur twice is first settled for whole runs of starts, by keys; what is left are the runs in which a repeat begins
or ends. There the suffixes are sorted: directly those smaller than their successor, the rest induced from them by scanning buckets of first
bytes; equal strings then are neighbours, found by their common prefix.

Every start belongs to the run of its anchor (see :mod:`suffix_anchors`), and equal strings have equal bytes around equal anchors. So a
run meets its like under a hash of the bytes that all its strings share, and is settled as a whole if all its bytes come twice. Else it's cut
into runs of at most ``FINE`` starts, which are settled alike; few are left for sorting. Sizes move in proportion to the input: no pair of
occurrences is formed, and counts are made before rows move.

Passages of many words can be shorter than ``length`` bytes. Those that come twice are found on request, by the same runs over words in place of
bytes; starts that whole runs leave open are settled by counted hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbita.llm.bytes_np import _TABLE, groups, utf8, words
from orbita.llm.shared import cut, keyed, width
from orbita.llm.suffix_anchors import GRAM, cells

FINE = 32
#: Bytes of text whose anchors are found at once; a longer document is taken whole.
ANCHOR_BYTES = 1 << 18
#: Bytes of text in one suffix sorting.
BLOCK_BYTES = 4 << 20
#: A key that more runs share than this is settled start by start with counted hashes, which needs no task to hold the key's runs.
MOST_SORTED = 4096


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def two_stage_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` positions in order of their suffixes' first ``depth`` bytes at least; suffixes that agree on these stand together.

    Only suffixes smaller than their successors are compared; larger ones follow from the order of their successors, bucket by bucket of first bytes.
    """
    n = len(text)
    raw = text.tobytes()
    step = np.sign(np.diff(text.astype(np.int16), append=-1))
    moves = np.flatnonzero(step)
    nearest = moves[np.searchsorted(moves, np.arange(n))]
    small = step[nearest] > 0  # smaller than its successor; the end counts as the least
    # from each wanted position on, up to the first small one
    smalls = np.flatnonzero(small)
    k = np.searchsorted(smalls, wanted)
    until = np.where(k < len(smalls), smalls[np.minimum(k, max(0, len(smalls) - 1))] if len(smalls) else n - 1, n - 1)
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, wanted, 1)
    np.add.at(mark, until + 1, -1)
    used = np.cumsum(mark[:n]) > 0
    direct = np.flatnonzero(used & small).tolist()
    direct.sort(key=lambda i: raw[i : i + depth])
    direct_at = np.array(direct, np.int64)
    induced = used & ~small
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and induced[n - 1]:
        buckets[text[n - 1]].append(np.array([n - 1]))
    by_byte = text[direct_at]
    bounds = np.searchsorted(by_byte, np.arange(257))
    out = []

    def place(found: np.ndarray, c: int) -> None:
        before = found[found > 0] - 1
        before = before[induced[before]]
        if len(before):
            b = text[before]
            for x in np.unique(b).tolist():
                buckets[x].append(before[b == x])

    for c in range(256):
        k = 0
        while k < len(buckets[c]):  # runs of one byte come back into their own bucket
            out.append(buckets[c][k])
            place(buckets[c][k], c)
            k += 1
        own = direct_at[bounds[c] : bounds[c + 1]]
        if len(own):
            out.append(own)
            place(own, c)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    is_wanted = np.zeros(n, bool)
    is_wanted[wanted] = True
    return order[is_wanted[order]]


def repeated_starts(text: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Those of ``wanted`` whose ``length`` bytes also start at another wanted position, by adjacent common prefixes in suffix order."""
    order = two_stage_order(text, wanted, length)
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    same = np.zeros(max(0, len(order) - 1), bool)
    for at in range(0, len(same), 20_000):
        stop = min(at + 20_000, len(same))
        same[at:stop] = (windows[order[at:stop]] == windows[order[at + 1 : stop + 1]]).all(axis=1)
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return order[twice]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the shuffles."""
    c = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.compress(t.encode()) for t in batch.column(3).to_pylist()], pa.binary())], names=["doc_id", *ROW, "packed"])


#: A row of the input, see :func:`orbita.llm.shared.keyed`.
ROW = ["rid", "th"]
_ROW_KIND = "rid bigint, th bigint"
_RUN = f"{_ROW_KIND}, first int, n int, off int, key bigint, content bigint"
_RUN_NAMES = [*ROW, "first", "n", "off", "key", "content"]


def _runs(ids: list[np.ndarray], at: np.ndarray, values: np.ndarray, raw: np.ndarray, length: int, core: int, gram: int, by_word: bool) -> pa.RecordBatch:
    """Runs of some texts, which begin ``at`` places of ``values`` and of ``raw``. Those over words have an ``off`` of -1."""
    row, first, last, anchor = cells(values, at, length, core, gram)
    h = xxhash.xxh3_64_intdigest
    u = raw.itemsize
    held = memoryview(raw.tobytes())
    off = anchor - first
    keys = [_signed(h(held[u * a : u * (a + core)])) for a in anchor.tolist()]
    content = [_signed(h(held[u * f : u * (e + length)], o)) for f, e, o in zip(first.tolist(), last.tolist(), off.tolist(), strict=True)]
    places = (first - at[row], last - first + 1, np.full(len(off), -1) if by_word else off)
    return pa.RecordBatch.from_arrays([*(pa.array(x[row]) for x in ids), *(pa.array(x, pa.int32()) for x in places), pa.array(keys, pa.int64()), pa.array(content, pa.int64())], names=_RUN_NAMES)


def _coarse(length: int, core: int, count: int | None):
    """Runs of starts of ``length``-byte strings that have one anchor and, with ``count``, of strings of so many words, with places and lengths in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            ids = [batch.column(c).to_numpy() for c in (0, 1)]
            for lo, hi in groups(offsets, ANCHOR_BYTES):
                own = [x[lo:hi] for x in ids]
                b = data[offsets[lo] : offsets[hi]]
                yield _runs(own, offsets[lo : hi + 1] - offsets[lo], _TABLE[b], b, length, core, GRAM, False)
                if count:
                    text, _, _, hashes = words(offsets[lo : hi + 1], data, lower=False)
                    word_core = max(1, count * 4 // 25)
                    yield _runs(own, np.searchsorted(text, np.arange(hi - lo + 1)), hashes, hashes, count, word_core, word_core, True)

    return run


def settle(runs: DataFrame) -> DataFrame:
    """Adds ``whole`` (all bytes of the run come twice), ``open`` (must be compared) and ``sharers`` to runs whose key comes twice; others are dropped.

    Of runs with equal bytes one is open, and stands for all, if others share the key.
    """
    keys = runs.groupBy("key").agg(F.count(F.lit(1)).alias("sharers"), F.min("content").alias("lo"), F.max("content").alias("hi")).filter("sharers > 1")
    keys = cut(keys, "keys")  # joins between written tables are ones that large keys can be split in
    shared = cut(runs.join(keys.select("key", "sharers", (F.col("lo") != F.col("hi")).alias("mixed")), "key"), "shared")
    mixed = shared.filter("mixed")
    kinds = mixed.groupBy("key", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*ROW, "first")).alias("speaker"))
    told = mixed.join(cut(kinds, "kinds"), ["key", "content"])
    plain = [*ROW, "first", "n", "off", "key", "sharers"]
    return shared.filter("not mixed").select(*plain, F.lit(True).alias("whole"), F.lit(False).alias("open")).unionByName(
        told.select(*plain, (F.col("copies") > 1).alias("whole"), (F.struct(*ROW, "first") == F.col("speaker")).alias("open"))
    )


def _lists(runs: DataFrame) -> DataFrame:
    """A row for each document, with its runs: as many at most as its text has bytes, however many rows are equal to it."""
    columns = ["first", "n", "off", "key", "large"]
    return runs.groupBy(*ROW).agg(F.collect_set(F.struct(*columns)).alias("runs")).select(*ROW, *(F.col(f"runs.{c}").alias(c) for c in columns))


def _with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes, zip]]:
    d = zstandard.ZstdDecompressor()
    for batch in batches:
        columns = [batch.column(c) for c in range(batch.num_columns)]
        for i in range(batch.num_rows):
            yield (columns[0][i].as_py(), columns[1][i].as_py()), d.decompress(columns[2][i].as_py()), zip(*(c[i].as_py() for c in columns[3:8]), strict=True)


def _fine(length: int, count: int | None):
    """Cuts runs at distances from the anchor that are multiples of FINE; a part's key is the bytes that all strings of its distances share.

    Of runs over words each start becomes a part, whose key and content are 128 bits of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        rows: list[tuple] = []
        owner: list[tuple[int, int]] = []
        starts: list[np.ndarray] = []
        digests: list[bytes] = []
        for doc, raw, runs in _with_texts(batches):
            hashes = None
            for first, n, off, key, _ in runs:
                if off < 0:
                    if hashes is None:
                        hashes = memoryview(words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), lower=False)[3].tobytes())
                    owner.append(doc)
                    starts.append(np.arange(first, first + n))
                    digests += [xxhash.xxh3_128_digest(hashes[8 * p : 8 * (p + count)]) for p in range(first, first + n)]
                    continue
                anchor, last = first + off, first + n - 1
                o = anchor - last
                while o <= off:
                    top = min(off, o // FINE * FINE + FINE - 1)
                    block = o // FINE
                    share = raw[anchor - block * FINE : anchor - block * FINE - FINE + 1 + length]
                    a, b = anchor - top, anchor - o
                    rows.append((*doc, a, b - a + 1, top, _signed(h(share, (key ^ block * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)), _signed(h(raw[a : b + length], top - o))))
                    o = top + 1
            if len(rows) >= 20_000:
                yield _table(rows)
                rows = []
            if len(digests) >= 50_000:
                yield _digests(owner, starts, digests)
                owner, starts, digests = [], [], []
        yield _table(rows)
        if digests:
            yield _digests(owner, starts, digests)

    return run


def _digests(owner: list[tuple[int, int]], starts: list[np.ndarray], digests: list[bytes]) -> pa.RecordBatch:
    who = np.repeat(np.array(owner, np.int64), [len(x) for x in starts], axis=0)
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    one = np.ones(len(halves), np.int32)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (who[:, 0], who[:, 1], np.concatenate(starts).astype(np.int32), one, -one, halves[:, 0], halves[:, 1])], names=_RUN_NAMES)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_RUN_NAMES)


def _strings(length: int):
    """The bytes of open runs for sorting; and of those with large keys, a hash for each start instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc, raw, runs in _with_texts(batches):
            for first, n, _, key, large in runs:
                if large:
                    rows += [(*doc, p, 1, key, xxhash.xxh3_128_digest(raw[p : p + length])) for p in range(first, first + n)]
                else:
                    rows.append((*doc, first, n, key, raw[first : first + n - 1 + length]))
            if len(rows) >= 5_000:
                yield _bytes(rows)
                rows = []
        yield _bytes(rows)

    return run


def _bytes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*ROW, "first", "n", "key", "bytes"])


def _sorted(length: int):
    """Rows in order of key. Keys are gathered into blocks of text, of which each is sorted; a key's runs stay in one block."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rid, th, first, counts = (np.array([r[c] for r in rows]) for c in range(4))
        text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        base = np.concatenate(([0], np.cumsum([len(r[5]) for r in rows])))
        owner = np.repeat(np.arange(len(rows)), counts)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        found = np.sort(repeated_starts(text, base[owner] + inner, length))
        who = np.searchsorted(base, found, "right") - 1
        return pa.RecordBatch.from_arrays([pa.array(rid[who]), pa.array(th[who]), pa.array(first[who] + found - base[who], pa.int32()), pa.array(np.ones(len(who)), pa.int32())], names=[*ROW, "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if held >= BLOCK_BYTES and rows[-1][4] != r[4]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[5])
        if rows:
            yield solve(rows)

    return run


def repeats(docs: DataFrame, packed: DataFrame, length: int, count: int | None = None) -> DataFrame:
    """(rid, th, first, n, by_word): runs of starts of ``length``-byte strings that also start elsewhere and, with ``count``, of strings of so many words, in words.

    ``packed`` has the documents' compressed texts.
    """
    core = max(GRAM, length * 9 // 25)
    n = width(docs.sparkSession)
    coarse = settle(cut(docs.mapInArrow(_coarse(length, core, count), _RUN), "runs"))
    coarse = cut(coarse.withColumn("large", F.lit(False)), "coarse")
    parts = packed.join(_lists(coarse.filter("open")), ROW).select(*ROW, "packed", "first", "n", "off", "key", "large")
    fine = settle(cut(parts.mapInArrow(_fine(length, count), _RUN), "parts"))
    fine = cut(fine.withColumn("large", F.col("sharers") > MOST_SORTED), "fine")
    strings = packed.join(_lists(fine.filter("open and off >= 0")), ROW).select(*ROW, "packed", "first", "n", "off", "key", "large")
    strings = cut(strings.mapInArrow(_strings(length), f"{_ROW_KIND}, first int, n int, key bigint, bytes binary").withColumn("hashed", F.octet_length("bytes") == 16), "strings")
    in_order = strings.filter("not hashed").select(*ROW, "first", "n", "key", "bytes").repartition(n, "key").sortWithinPartitions("key")
    by_sort = in_order.mapInArrow(_sorted(length), f"{_ROW_KIND}, first int, n int")
    hashes = strings.filter("hashed")
    twice = hashes.groupBy("key", "bytes").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    by_hash = hashes.join(twice, ["key", "bytes"], "left_semi").select(*ROW, "first", "n")
    plain = [*ROW, "first", "n", (F.col("off") < 0).alias("by_word")]
    # what stands for equal runs also answers for them
    whole = coarse.filter("whole").select(*plain).unionByName(fine.filter("whole").select(*plain))
    return whole.unionByName(by_sort.unionByName(by_hash).withColumn("by_word", F.lit(False)))


def _covered(first: list[int] | None, n: list[int] | None, count: int) -> int:
    """Words inside the strings of ``count`` words that start in some runs, each word once."""
    if not first:
        return 0
    begin = np.array(first, np.int64)
    order = np.argsort(begin)
    begin = begin[order]
    end = np.maximum.accumulate(begin + np.array(n, np.int64)[order] - 1 + count)
    return int((end - np.maximum(begin, np.concatenate(([0], end[:-1])))).sum())


def _remove(length: int, with_text: bool, count: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(lo, 256)
                for doc, packed, first, n, *at_words in zip(*(part.column(c).to_pylist() for c in range(part.num_columns)), strict=True):
                    raw = d.decompress(packed)
                    gone = np.zeros(len(raw) + 1, np.int32)
                    if first:
                        np.add.at(gone, first, 1)
                        np.add.at(gone, np.array(first) + np.array(n) - 1 + length, -1)
                    gone = np.cumsum(gone[: len(raw)]) > 0
                    left = np.frombuffer(raw, np.uint8)[~gone].tobytes() if first else raw
                    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    rows.append((doc, len(raw), len(raw) - len(left), len(edge) // 2, hashlib.sha256(left).hexdigest(), len(left) < len(raw), *([_covered(*at_words, count)] if count else ()), *((left.decode("utf-8", "ignore"), edge[::2].tolist(), edge[1::2].tolist()) if with_text else ())))
                columns = list(zip(*rows, strict=True))
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "changed", *["n_passage_words"] * bool(count), "kept", "span_starts", "span_ends"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * bool(count), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: len(columns)])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, passage_words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, changed[, n_passage_words][, kept, span_starts, span_ends]): each text, as UTF-8 bytes, without every byte that a
    ``length``-byte string covers which starts at two places or more, the same document included.

    Strings never cross documents and are judged on the input. ``kept`` leaves out bytes of characters that were cut in two; the hash is of all bytes left.
    With ``passage_words``, n_passage_words counts the words (runs of anything but ASCII white space, as written) inside a string of so many words that starts at two
    places or more, the same document included, whatever its bytes. It's a report: nothing is removed for it.
    A row for each row, with ids or without, and ids may come again: each row counts by itself, so a text of ``length`` bytes that two rows have goes from both.
    Null and empty texts have no bytes, and an empty table gives an empty one. Other columns of ``docs`` aren't read. ``length`` must be at least 64, so that anchors are sparse.
    """
    if length < 64:
        raise ValueError("length must be at least 64")
    if passage_words is not None and passage_words < 1:
        raise ValueError("passage_words must be at least 1")
    texts = keyed(docs, id_col, text_col)
    packed = texts.select("doc_id", *ROW, "text").mapInArrow(_pack, f"doc_id bigint, {_ROW_KIND}, packed binary")
    kinds = {"runs": ~F.col("by_word"), "word_runs": F.col("by_word")} if passage_words else {"runs": F.lit(True)}
    found = repeats(texts.select(*ROW, "text"), packed, length, passage_words).groupBy(*ROW)
    found = found.agg(*(F.collect_set(F.when(kind, F.struct("first", "n"))).alias(name) for name, kind in kinds.items()))
    lists = [F.col(f"{name}.{c}").alias(f"{name}_{c}") for name in kinds for c in ("first", "n")]
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, changed boolean" + ", n_passage_words bigint" * bool(passage_words) + ", kept string, span_starts array<bigint>, span_ends array<bigint>" * with_text
    return packed.join(found.select(*ROW, *lists), ROW, "left").drop(*ROW).mapInArrow(_remove(length, with_text, passage_words), schema)
