"""Encoding and decoding as the sentencepiece library does for BPE models, by a table of prefixes.

In merge-type tokenisation the last token of each prefix of a text is unique: it is the one token that ends the prefix and may stand
beside the last token of what precedes it. An automaton over all pieces gives the tokens that end at each place; a pair test tells whether two
tokens stay apart when their texts are encoded together. One pass fills the table of last tokens, and the ids follow from its end backwards.

Where no piece goes on past a space mark into which it didn't start, a text's words are encoded apart, and those that come again are looked up.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbita.llm.sentencepiece_model import BPE, BYTE, CONTROL, MARK, NORMAL, UNKNOWN, UNUSED, USER_DEFINED, Model
from orbita.llm.shared import id_text
from orbita.llm.token_files import WordCache

#: Words that a worker keeps, those without a space mark before them apart; twice as many at most, of some 300 bytes each.
CACHE_WORDS, CACHE_LATER = 120_000, 30_000
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
#: A word of normalised text with the marks before it.
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _little(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceBpe:
    """Encoder and decoder of one BPE model file, whatever its normalisation, symbols and fallback; raises ValueError for models of other kinds,
    and for those without a begin or an end piece, which the library refuses as well.

    ``plain`` models (identity normalisation, byte fallback, white space only as prefixes) take texts apart into words without normalising them.
    For all others the steps are the library's: normalise, cut out the user's symbols, fill the table for what lies between, replace what has no
    piece by its bytes or by the unknown piece, and decode from the ids. Models with unused pieces merge by agenda, see :meth:`by_agenda`.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.model = Model.read(sp.serialized_model_proto())
        if model.kind != BPE:
            raise ValueError("only BPE models are supported")
        if not all(i >= 0 and sp.is_control(i) for i in (sp.bos_id(), sp.eos_id())):
            raise ValueError("the model has no begin or no end piece")
        n = len(model.pieces)
        self.texts = [p for p, _, _ in model.pieces]
        self.kinds = [kind for _, _, kind in model.pieces]
        self.byte = {int(m[1], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE and (m := _BYTE.match(p))}
        self.value = {i: b for b, i in self.byte.items()}
        self.unk = sp.unk_id()
        self.ends = _little([sp.bos_id()]), _little([sp.eos_id()])
        self.score = {p: (s, i) for i, (p, s, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        own = sorted((p for p, _, kind in model.pieces if kind == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile(f"({'|'.join(map(re.escape, own))})") if own else None
        self.odd = UNUSED in self.kinds
        self.words = not any(MARK in p.lstrip(MARK) for p in self.score)
        self.chars = {p for p in self.score if len(p) == 1}
        self.plain = self.is_plain()
        self.pair: dict[int, bool] = {}
        self.n = n
        self.automaton = ahocorasick.Automaton()
        for p, (_, i) in self.score.items():
            if self.merge(p) == [i]:  # a piece that its own text doesn't give never comes out of any text
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.first = WordCache(lambda w: self.word(MARK + w), CACHE_WORDS)
        self.later = WordCache(self.word, CACHE_LATER)
        self.runs = WordCache(self.run, CACHE_LATER)

    def is_plain(self) -> bool:
        """Whether texts can be taken apart at spaces and line ends as they are, and decode to themselves."""
        norm, model = self.model.normalizer, self.model
        if not norm.identity or norm.squeeze or not (norm.dummy and norm.escape) or norm.suffix or model.denormalizer or not model.fallback:
            return False
        if self.odd or MARK not in self.chars:
            return False
        return not any("\n" in p or MARK in p[1:] and p.strip(MARK) for p in self.score)

    def merge(self, text: str) -> list[int]:
        """Ids by merging the best pair, leftmost first, until none is left: the plain definition, for pairs and single pieces."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((s[0], -k) for k in range(len(parts) - 1) if (s := self.score.get(parts[k] + parts[k + 1]))), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.score[p][1] if p in self.score else -1 for p in parts]

    def stays(self, a: int, b: int) -> bool:
        """Whether the texts of two tokens, encoded together, give these two tokens."""
        key = a * self.n + b
        out = self.pair.get(key)
        if out is None:
            if len(self.pair) > 2_000_000:
                self.pair.clear()
            out = self.pair[key] = self.merge(self.texts[a] + self.texts[b]) == [a, b]
        return out

    def known(self, text: str) -> list[int]:
        """Ids of a text whose characters all are pieces, by the table of last tokens."""
        last, size = [0] * (len(text) + 1), [0] * (len(text) + 1)
        pair, stays, n = self.pair, self.stays, self.n
        done = 0  # the table is filled up to here; all matches that end at one place follow each other
        for end, (length, i) in self.automaton.iter(text):
            end += 1
            if end == done:
                continue
            start = end - length
            if start:
                ok = pair.get(last[start] * n + i)
                if not (stays(last[start], i) if ok is None else ok):
                    continue
            last[end], size[end], done = i, length, end
        out = []
        at = len(text)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def word(self, text: str) -> tuple[bytes, bytes]:
        """The ids of one word as little-endian 32-bit integers, and the bytes that they decode to: the word's own, with spaces for marks. Characters without a piece become their bytes."""
        chars = self.chars
        if chars.issuperset(text):
            ids = self.known(text)
        else:
            ids = []
            for known, run in itertools.groupby(text, chars.__contains__):
                part = "".join(run)
                ids += self.known(part) if known else [self.byte[b] for b in part.encode()]
        return _little(ids), text.replace(MARK, " ").encode()

    def ident(self, piece: str) -> int:
        """The id of what is left as one symbol; control and byte pieces never come out of a text's own characters."""
        return self.score[piece][1] if piece in self.score else self.unk

    def run(self, text: str) -> list[int]:
        """Ids of normalised text without symbols of the user; -1 - k for a symbol without a piece that is character k of Unicode."""
        if self.chars.issuperset(text):
            return self.known(text)
        ids = []
        for known, part in itertools.groupby(text, self.chars.__contains__):
            ids += self.known("".join(part)) if known else [-1 - ord(c) for c in part]
        return ids

    def by_agenda(self, text: str) -> list[int]:
        """Like :meth:`run` for any normalised text, by the merges themselves. Unused pieces are merged and then taken apart as the library does: as the pair of that
        text was that came up last, anywhere in the text, so that neither words nor prefixes can be looked at apart."""
        parts: list[str] = []
        frozen: list[bool] = []
        for k, part in enumerate(self.own.split(text) if self.own else [text]):
            parts += [part] if k % 2 else part
            frozen += [True] if k % 2 else [False] * len(part)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        split: dict[str, tuple[str, str]] = {}
        agenda: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a < 0 or b < 0 or frozen[a] or frozen[b] or (s := self.score.get(both := parts[a] + parts[b])) is None:
                return
            heapq.heappush(agenda, (-s[0], a, b, len(both)))
            if self.kinds[s[1]] == UNUSED:
                split[both] = parts[a], parts[b]

        for k in range(1, len(parts)):
            offer(k - 1, k)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a] += parts[b]
            parts[b] = ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out, todo = [], [p for p in reversed(parts) if p]
        while todo:
            p = todo.pop()
            i = self.ident(p)
            if self.kinds[i] == UNUSED and p in split:
                todo += reversed(split[p])
            else:
                out.append(-1 - ord(p) if i == self.unk else i)
        return out

    def tokens(self, text: str) -> list[int]:
        """Ids of a normalised text."""
        if self.odd:
            found = self.by_agenda(text)
        else:
            found = []
            for k, part in enumerate(self.own.split(text) if self.own else [text]):
                if k % 2:
                    found.append(self.ident(part))
                elif self.words:
                    for w in _WORD.findall(part):
                        found += self.runs[w]
                else:
                    found += self.run(part)
        unk, byte, out = self.unk, self.byte if self.model.fallback else None, []
        for i in found:
            if i >= 0:
                out.append(i)
            elif byte is not None:
                out += [byte[b] for b in chr(-1 - i).encode()]
            elif not out or out[-1] != unk:  # neighbours without a piece are one
                out.append(unk)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, bytes put together and the added first mark left out."""
        norm, kinds = self.model.normalizer, self.kinds
        out: list[str] = []
        held = bytearray()
        first, seen = norm.dummy or norm.squeeze, False
        for i in ids:
            if kinds[i] == BYTE:
                held.append(self.value[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if seen or out:
                first = False
            seen = False
            if kinds[i] == CONTROL:
                continue
            p = self.model.unknown
            if kinds[i] != UNKNOWN:
                p = self.texts[i]
                if first and p.startswith(MARK):
                    p, seen = p[1:], not norm.squeeze
                p = p.replace(MARK, " ")
            if p:
                out.append(p)
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return self.model.denormalizer(text) if self.model.denormalizer else text

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """All ids with begin and end as little-endian 32-bit integers, and the decoded text in UTF-8."""
        head, tail = self.ends
        if not text:
            return head + tail, b""
        if not self.plain:
            ids = self.tokens(self.model.normalizer(text))
            return head + _little(ids) + tail, self.decode(ids).encode()
        first, later = self.first, self.later
        found = []
        text = text.replace(MARK, " ")
        for k, line in enumerate(text.split("\n")):  # a line's end has no piece, so nothing reaches across it
            parts = line.split(" ")
            if k:
                found.append(self.line_end)
                if parts[0]:
                    found.append(later[parts[0]])
                parts = parts[1:]
            if "" in parts:  # runs of spaces stay with the word that follows
                run = 0
                for p in parts:
                    run += 1
                    if p:
                        found.append(first[p] if run == 1 else later[MARK * run + p])
                        run = 0
                if run:
                    found.append(later[MARK * run])
            else:
                found += [first[p] for p in parts]
        return b"".join([head, *[a for a, _ in found], tail]), b"".join([b for _, b in found])[1:]

    @property
    def line_end(self) -> tuple[bytes, bytes]:
        return self.later["\n"]


_codecs: dict[str, PieceBpe] = {}


def codec(path: str) -> PieceBpe:
    """One codec for each model and worker."""
    if path not in _codecs:
        _codecs[path] = PieceBpe(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]): the ids of every whole text with begin and end ids, and what they decode to.

    Null text is empty: begin and end ids alone, decoded to the empty text. A row for each row, whatever its id; an empty table gives an empty one. Other columns of ``docs`` aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sha = codec(path).encode, hashlib.sha256
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                pairs = [encode(t) for t in part.column(1).to_pylist()]
                columns = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([len(a) // 4 for a, _ in pairs], pa.int64()),
                    "ids_sha256": [sha(a).hexdigest() for a, _ in pairs],
                    "decoded_sha256": [sha(b).hexdigest() for _, b in pairs],
                }
                if with_ids:
                    columns |= {"ids": pa.array([np.frombuffer(a, np.int32) for a, _ in pairs], pa.list_(pa.int32())), "decoded": [b.decode("utf-8", "replace") for _, b in pairs]}
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)
