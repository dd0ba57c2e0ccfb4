"""What a sentencepiece model file says of text before and after its pieces: the fields of the file, and normalisation."""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE, WORD, CHAR = range(1, 5)


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 128:
            return out, at


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; values that aren't variable-length integers as bytes."""
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        if tag & 7 == 0:
            value, at = _varint(b, at)
        else:
            size, at = _varint(b, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = b[at : at + size], at + size
        yield tag >> 3, value


class Normalizer:
    """One normaliser of a model: rules by longest prefix, space marks, extra spaces and the added first (or last) mark, in the library's order of steps."""

    def __init__(self, spec: bytes, user_defined: list[str] = (), suffix: bool = False):
        got = dict(_fields(spec))
        rules = got.get(2, b"")
        self.dummy, self.squeeze, self.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))
        self.suffix = suffix
        self.units, self.texts = array("I"), b""
        if rules:
            size = struct.unpack_from("<I", rules)[0]
            self.units = array("I", struct.unpack_from(f"<{size // 4}I", rules, 4))
            self.texts = rules[4 + size :]
        self.own = re.compile(b"|".join(re.escape(u.encode()) for u in sorted(user_defined, key=len, reverse=True))) if user_defined else None

    @property
    def identity(self) -> bool:
        """Whether characters stay as they are, but for space marks."""
        return not self.units and self.own is None

    def prefix(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the text's next characters, and where they end: a symbol of the user, the longest rule, or one character."""
        if self.own is not None and (m := self.own.match(raw, at)):
            return m[0], m.end()
        end = at
        if units := self.units:  # a double array: a unit has the label, the way to the next ones, and whether a rule ends here
            u = units[0]
            place = (u >> 10) << ((u & 512) >> 6)
            for i in range(at, len(raw)):
                place ^= raw[i]
                u = units[place]
                if u & 0x800000FF != raw[i]:
                    break
                place ^= (u >> 10) << ((u & 512) >> 6)
                if u >> 8 & 1:
                    end, value = i + 1, units[place] & 0x7FFFFFFF
        if end > at:
            return self.texts[value : self.texts.index(b"\0", value)], end
        c = raw[at]
        end = at + (1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
        return raw[at:end], end

    def __call__(self, text: str) -> str:
        mark = MARK if self.escape else " "
        if self.identity:
            if self.squeeze:
                text = re.sub(" +", " ", text.lstrip(" "))
            if not text:
                return ""
            body = text.replace(" ", mark)
        else:
            raw, at, out = text.encode(), 0, []
            while self.squeeze and at < len(raw):
                piece, end = self.prefix(raw, at)
                if piece != b" ":
                    break
                at = end
            if at == len(raw):
                return ""
            spaced = self.squeeze
            while at < len(raw):
                piece, at = self.prefix(raw, at)
                if spaced:
                    piece = piece.lstrip(b" ")
                if piece:
                    out.append(piece)
                    spaced = self.squeeze and piece.endswith(b" ")
            body = b"".join(out).decode().replace(" ", mark)
        if self.dummy and not self.suffix:
            body = mark + body
        if self.squeeze:
            body = body.rstrip(mark)
        return body + mark if self.dummy and self.suffix else body


@dataclass
class Model:
    """A model file's fields, as far as encoding and decoding depend on them."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    suffix: bool = False
    fallback: bool = False
    unknown: str = " ⁇ "
    normalizer: Normalizer = None
    denormalizer: Normalizer | None = None

    @classmethod
    def read(cls, proto: bytes) -> Model:
        out, specs = cls(), {}
        for number, value in _fields(proto):
            if number == 1:
                got = dict(_fields(value))
                out.pieces.append((got[1].decode(), struct.unpack("<f", got.get(2, bytes(4)))[0], got.get(3, NORMAL)))
            else:
                specs[number] = value
        trained = dict(_fields(specs.get(2, b"")))
        out.kind, out.suffix, out.fallback = trained.get(3, UNIGRAM), bool(trained.get(24)), bool(trained.get(35))
        out.unknown = trained[44].decode() if 44 in trained else out.unknown
        out.normalizer = Normalizer(specs.get(3, b""), [p for p, _, kind in out.pieces if kind == USER_DEFINED], out.suffix)
        if dict(_fields(specs.get(5, b""))).get(2):
            out.denormalizer = Normalizer(specs[5])
        return out
