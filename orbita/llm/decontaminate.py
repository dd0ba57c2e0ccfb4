"""Benchmark decontamination: an Aho-Corasick automaton over the windows of all items, and one pass over the texts.

A benchmark of more than BLOCK_BYTES has an automaton for each block of so many bytes, as an automaton takes some 400 times that. Blocks are broadcast one by one, so
the driver holds one at a time; a task takes them in turn over each GROUP_BYTES of its texts, which are read once and keep their rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbita.llm.shared import free_names, id_text

#: Bytes of items in one automaton, but for an item that is longer by itself.
BLOCK_BYTES = 1 << 19
#: Bytes of texts that a task holds at once.
GROUP_BYTES = 16 << 20

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def normal_words(text: str) -> list[bytes]:
    """Words of a text: A-Z in lower case, ASCII signs and controls as gaps, everything from U+0080 on part of words."""
    return text.encode().translate(_NORMAL).split()


class Matcher:
    """Finds the windows of a set of items. Matches start and end at gaps, so a window never matches inside a word."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        import ahocorasick

        found: dict[str, set[str]] = {}
        for item, text in items:
            ws = normal_words(text)
            for k in range(max(1, len(ws) - size + 1) if ws else 0):
                found.setdefault(b" ".join([b"", *ws[k : k + size], b""]).decode("latin-1"), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, owners in found.items():
            self.automaton.add_word(window, (window.count(" ") - 1, frozenset(owners)))
        self.any = bool(found)
        if self.any:
            self.automaton.make_automaton()

    def find(self, flat: str, ranges: list[tuple[int, int]], owners: set[str]) -> None:
        """Adds the ranges of hit words, and the items with windows that occur, in words of a text with a space before and after each."""
        seen = word = 0
        for end, (n, who) in self.automaton.iter(flat) if self.any else ():
            word += flat.count(" ", seen, end)  # the gaps before the last one of the match: the word that the match ends with
            seen = end
            ranges.append((word - n, word))
            owners |= who


def maximal(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges joined where they touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_matchers: dict[bytes, Matcher] = {}


def matcher(items: list[tuple[str, str]], size: int) -> Matcher:
    """One automaton at a time for each worker."""
    key = hashlib.sha256(repr((size, items)).encode()).digest()
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, size)
    return _matchers[key]


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as code point offsets in the text as it was, end exclusive."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_UPPER))]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about ``block_bytes`` bytes, one at a time on the driver; at least one block. A null id counts as the empty string."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    block: list[tuple[str, str]] = []
    held = 0
    for item, text in items.toLocalIterator():
        if block and held + len(text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += len(text)
    yield block


Found = tuple[int, list[tuple[int, int]], list[str]]


def scanner(spark: SparkSession, benchmark: DataFrame, size: int, block_bytes: int) -> Callable[[list[str]], list[Found]]:
    """A function for the executors: number of words, maximal ranges of hit words, and sorted items of each text."""
    blocks = [spark.sparkContext.broadcast(items) for items in item_blocks(benchmark, block_bytes=block_bytes)]

    def scan_all(texts: list[str]) -> list[Found]:
        words = [normal_words(t) for t in texts]
        flat = [b" ".join([b"", *ws, b""]).decode("latin-1") for ws in words]
        found: list[tuple[list, set]] = [([], set()) for _ in texts]
        for block in blocks:
            m = matcher(block.value, size)
            for f, (ranges, owners) in zip(flat, found, strict=True):
                m.find(f, ranges, owners)
            if len(blocks) > 1:
                vars(block).pop("_value", None)  # else each worker would come to hold all items
        return [(len(ws), maximal(ranges), sorted(owners)) for ws, (ranges, owners) in zip(words, found, strict=True)]

    return scan_all


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Table, list[str]]]:
    """Rows of about GROUP_BYTES of text, or of one batch."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= GROUP_BYTES:
            yield _group(held, column)
            held, size = [], 0
    if held:
        yield _group(held, column)


def _group(held: list[pa.RecordBatch], column: int) -> tuple[pa.Table, list[str]]:
    table = pa.Table.from_batches(held)
    return table, [t or "" for t in table.column(column).to_pylist()]


_RANGES = "array<struct<start:bigint,end:bigint,char_start:bigint,char_end:bigint>>"


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, ranges, items): ranges of hit words with their places in the text as it was, and the items found.

    A window is ``size`` consecutive words of an item, or all of an item of fewer; items and texts without words have none. Null is without words.
    Repeated item ids act as one item of several texts; with no items, nothing is hit. A row for each row of ``docs``, each judged by its own text: ids may be null or come again.
    An empty table gives an empty one. Other columns of ``docs`` aren't read.
    """
    find = scanner(docs.sparkSession, benchmark, size, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "char_start", "char_end")]))
        for table, texts in _grouped(batches, 1):
            found = find(texts)
            ranges = [[{"start": x, "end": y, "char_start": u, "char_end": v} for (x, y), (u, v) in zip(b, original_spans(t, b), strict=True)] for t, (_, b, _) in zip(texts, found, strict=True)]
            columns = [table.column(0), pa.array([n for n, _, _ in found], pa.int64()), pa.array(ranges, kind), pa.array([c for _, _, c in found], pa.list_(pa.string()))]
            yield from pa.table(columns, names=["doc_id", "n_words", "ranges", "items"]).combine_chunks().to_batches()

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id bigint, n_words bigint, ranges {_RANGES}, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns, each judged by its own text; one pass, no shuffle.

    Null and empty texts stay, as do repeated rows; an empty table stays empty. Columns may have any names.
    """
    find = scanner(docs.sparkSession, benchmark, size, block_bytes)
    extra = free_names(docs, "scanned")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in _grouped(batches, -1):
            keep = pa.array([not ranges for _, ranges, _ in find(texts)], pa.bool_())
            yield from table.select(range(table.num_columns - 1)).filter(keep).to_batches()

    return docs.select("*", F.col(f"`{text_col}`").cast("string").alias(extra)).mapInArrow(run, T.StructType(docs.schema.fields))
