"""Token ids in Arrow stream files of fixed-size-list batches.

A file holds consecutive documents in ascending id order. Its ids, one after the other, are cut into rows of ``SEQ_LEN`` ids;
the last row is filled up, and a mask of equal shape marks what is real. As all rows have one length and all batches but the last
one number of rows, the place of any sequence follows from its number, and a memory-mapped reader hands it out without a copy.
``documents`` and ``lengths`` of each file stand in a side stream ``.idx``, which says where each document starts.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.llm.shared import cut, fresh_path, id_text, width

SEQ_LEN = 2048
ROWS_PER_BATCH = 256
#: Words whose ids a worker keeps; older ones go when it is full, so memory is bounded and results don't change.
CACHE_WORDS = 400_000

#: Ids take 16 bits, as vocabularies of up to 65,536 need; masks take one.
ID = np.dtype("<u2")
SCHEMA = pa.schema([pa.field("ids", pa.list_(pa.uint16(), SEQ_LEN)), pa.field("mask", pa.list_(pa.bool_(), SEQ_LEN))])
INDEX = pa.schema([pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64())])


#: Longer words are encoded each time: scripts without spaces have some as long as a text, and the cache's memory should not hang on them.
CACHED_CHARS = 64


class WordCache(dict):
    """Word to the bytes of its ids, filled on demand, in two generations of bounded size."""

    def __init__(self, encode, most: int = CACHE_WORDS):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, word):
        if len(word) > CACHED_CHARS:
            return self.encode(word)
        out = self.old.get(word)
        if out is None:
            out = self.encode(word)
        if len(self) >= self.most:
            self.old = {}  # gone before the copy, so that there are never three generations
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


class WordBpe:
    """Exactly the ids of a ``tokenizers`` file of the kind in question (NFC, white space dropped, lower case, byte-level pieces with
    an end-of-word mark), found word by word.

    A text splits at ASCII white space without changing any id: no piece and no added token has white space, and neither composition
    nor case reaches across it. Words of Latin letters, digits and signs go piece by piece through the same merges; any other word,
    and any that might hold an added token, goes through the library as a whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        model = json.loads(self.full.to_str())["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level pieces write as themselves
        char = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        back = {c: b for b, c in char.items()}

        def raw(token: str) -> bytes:
            """A token's bytes, with 0xFF, which no UTF-8 has, for the end-of-word mark."""
            tail = b"\xff" if token.endswith(end) else b""
            return bytes(back[c] for c in token.removesuffix(end)) + tail

        # ranks: bytes, bytes with the mark, then merges in order. A merge's result is found by its text, as each token has one origin.
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.ids: dict[int, int] = {b: vocab[char[b]] for b in range(256) if char[b] in vocab}
        for b in range(255):
            ranks[bytes([b, 255])] = 256 + b
            self.ids[256 + b] = vocab.get(char[b] + end, -1)
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            t = raw(a + b)
            if t not in ranks:
                ranks[t] = 1000 + k
                self.ids[1000 + k] = vocab[a + b]
        self.bpe = tiktoken.Encoding("word", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.split_ascii = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
        self.control = bytes([*range(33), 127])
        self.simple = regex.compile("[\\x21-\\x7e\\u00a1-\\u02ff--\\u0130]+", flags=regex.V1).fullmatch
        self.packed = {r: struct.pack("<I", i) for r, i in self.ids.items() if i >= 0}
        self.pieces = WordCache(self._piece, CACHE_WORDS // 2)
        self.words = WordCache(self._word)

    def _piece(self, piece: bytes) -> bytes:
        packed = self.packed
        return b"".join([packed[r] for r in self.bpe(piece + b"\xff")])

    def _word(self, word: bytes) -> bytes:
        low = word.lower()
        if low.isalpha():  # ASCII letters
            return self.pieces[low]
        if b"<|" not in word:
            if word.isascii():
                if len(word.translate(None, self.control)) == len(word):
                    return b"".join([self.pieces[p] for p in self.split_ascii(low)])
            elif self.simple(text := word.decode()):
                return b"".join([self.pieces[p.encode()] for p in self.split(text.lower())])
        ids = self.full.encode(word.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        words = self.words
        return b"".join([words[w] for w in text.encode().split()])


_encoders: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One encoder for each file and worker."""
    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    return _encoders[path]


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it, by the URI's scheme; a shared folder may be a mount or any store that pyarrow knows."""
    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """Writes one file and its index; both appear under their names only when whole, so that a task that runs again replaces nothing half."""

    def __init__(self, uri: str, name: str, attempt: int):
        self.store, path = filesystem(uri)
        self.store.create_dir(path, recursive=True)
        self.path, self.part = f"{path}/{name}", f"{path}/.{name}.{attempt}"
        self.sinks = [self.store.open_output_stream(self.part + x) for x in (".arrows", ".idx")]
        self.main, self.index = (ipc.new_stream(s, schema) for s, schema in zip(self.sinks, (SCHEMA, INDEX), strict=True))
        self.rest: list[np.ndarray] = [np.zeros(0, ID)]
        self.held = 0

    def add(self, doc_ids: list[int], tokens: list[bytes]) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([len(t) // 4 for t in tokens], pa.int64())], schema=INDEX))
        self.rest.append(np.frombuffer(b"".join(tokens), "<u4").astype(ID))
        self.held += len(self.rest[-1])
        block = SEQ_LEN * ROWS_PER_BATCH
        if self.held >= block:
            data = np.concatenate(self.rest)
            for at in range(0, len(data) - block + 1, block):
                self._rows(data[at : at + block], block)
            self.rest = [data[len(data) // block * block :]]
            self.held = len(self.rest[0])

    def _rows(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.main.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), SEQ_LEN), pa.FixedSizeListArray.from_arrays(pa.array(mask), SEQ_LEN)], schema=SCHEMA))

    def close(self) -> None:
        ids = np.concatenate(self.rest)
        if len(ids):
            self._rows(np.concatenate([ids, np.zeros(-len(ids) % SEQ_LEN, ID)]), len(ids))
        for w, s in zip((self.main, self.index), self.sinks, strict=True):
            w.close()
            s.close()
        for x in (".idx", ".arrows"):
            self.store.move(self.part + x, self.path + x)


def write_tokens(docs: DataFrame, tokenizer_path: str, uri: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes the ids under ``uri`` in ascending id order. Returns the manifest (file, n_docs, n_tokens).

    Raises ValueError for a vocabulary that 16 bits don't hold. Files are named by their place, so the dataset's ids are those of its files in order of name. Null text is empty and gives the end id
    alone. Repeated ids keep a sequence each, in order of a hash of their texts; null ids come first. An empty table gives files without rows.
    """

    if max(end_id, word_bpe(tokenizer_path).full.get_vocab_size() - 1) > np.iinfo(ID).max:
        raise ValueError("ids beyond 16 bits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}"
        encode, end = word_bpe(tokenizer_path).encode, struct.pack("<I", end_id)
        out, n_docs, n_tokens = FileWriter(uri, name, task.taskAttemptId()), 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                tokens = [encode(t) + end for t in part.column(1).to_pylist()]
                out.add(part.column(0).to_pylist(), tokens)
                n_docs += len(tokens)
                n_tokens += sum(map(len, tokens)) // 4
        out.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    rows = id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))  # texts of one id, or of none, are ranges of their own
    ordered = rows.repartitionByRange(partitions or width(docs.sparkSession), "doc_id", "th").sortWithinPartitions("doc_id", "th").drop("th")
    return cut(ordered.mapInArrow(write, "file string, n_docs bigint, n_tokens bigint"), "manifest")


def open_file(uri: str, name: str) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of each document of one file, in order; ids are views of the mapped file where they lie in one batch."""
    store, path = filesystem(uri)

    def source(suffix: str):
        return pa.memory_map(f"{path}/{name}{suffix}") if isinstance(store, fs.LocalFileSystem) else store.open_input_stream(f"{path}/{name}{suffix}")

    held, at = np.zeros(0, ID), 0
    with source(".idx") as i, source(".arrows") as m:
        blocks = iter(ipc.open_stream(m))
        for batch in ipc.open_stream(i):
            for doc, n in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy().tolist(), strict=True):
                while len(held) - at < n:
                    b = next(blocks)
                    ids, mask = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False)
                    ids = ids[: np.count_nonzero(mask)]
                    held, at = np.concatenate([held[at:], ids]) if at < len(held) else ids, 0
                yield doc, held[at : at + n]
                at += n


def sequences(uri: str, name: str) -> tuple[pa.Table, int]:
    """One file as a table over the mapped file: any sequence or mask by its number, without a copy; and the number of ids that are real."""
    store, path = filesystem(uri)
    table = ipc.open_stream(pa.memory_map(f"{path}/{name}.arrows") if isinstance(store, fs.LocalFileSystem) else store.open_input_stream(f"{path}/{name}.arrows")).read_all()
    return table, int(sum(np.count_nonzero(c.flatten().to_numpy(zero_copy_only=False)) for c in table.column("mask").chunks))


def read_tokens(spark: SparkSession, manifest: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document, read back from the files, a task for each file.

    ``start`` counts the ids of all files before, from the manifest (a row for each file, as many as there were partitions), and those before in the file.
    """
    before, starts = 0, {}
    for r in sorted(manifest.select("file", "n_tokens").collect()):
        starts[r["file"]] = before
        before += r["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                at, rows = starts[name], []
                for doc, ids in open_file(uri, name):
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), name))
                    at += len(ids)
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    files = spark.createDataFrame([(f,) for f in starts], "file string").repartition(max(1, len(starts)), F.col("file")) if starts else spark.createDataFrame([], "file string")
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])


def token_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes the token files of ``docs`` under the shared folder and reads every document back from them."""
    uri = fresh_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer_path, uri, end_id), uri)
