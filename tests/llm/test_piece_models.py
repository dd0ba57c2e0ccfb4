"""Sentencepiece coding against the library, on models other than the one at hand."""

from __future__ import annotations

import io
import random

import numpy as np
import pytest
import sentencepiece

from orbita.llm.sentencepiece_codec import PieceBpe, encode_decode

WORDS = ["the", "cat", "ﬁne", "Écol", "école", "日本", "a  b", "ＡＢＣ", "x²", "hello", "world", "ing", "12", "\t", "İ", "ｶﾞ", "in the", "▁"]
PARTS = [*WORDS, " ", "   ", "\n", "é", "ß", "中", "😀", "<u>", "lo", "☃", "?", "<unk>", "<s>", "<0x41>", "　", "\xa0", "​", "\x00", "﻿", "é", "ｶ", "ﾞ", "㍿", "q", "\r", "̀"]
PLAIN = {"normalization_rule_name": "identity", "remove_extra_whitespaces": False, "byte_fallback": True, "vocab_size": 340}
MODELS = {
    "nfkc": {},
    "nfkc_cf": {"normalization_rule_name": "nmt_nfkc_cf", "byte_fallback": True, "vocab_size": 340},
    "identity": {"normalization_rule_name": "identity"},
    "no first mark": {"add_dummy_prefix": False},
    "no first mark, all spaces": {"add_dummy_prefix": False, "remove_extra_whitespaces": False},
    "marks last": {"treat_whitespace_as_suffix": True},
    "across spaces": PLAIN | {"split_by_whitespace": False},
    "symbols": PLAIN | {"user_defined_symbols": ["<u>", "lo", "x", "\n", "ﬁ"]},
    "symbols, nfkc": {"user_defined_symbols": ["<u>", "lo", "x", "in the", "中"]},
    "control": {"control_symbols": ["☃"], "unk_piece": "?"},
}


def trained(**options) -> bytes:
    r = random.Random(1)
    out = io.BytesIO()
    lines = [" ".join(r.choice(WORDS) for _ in range(8)) for _ in range(800)]
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(lines), model_writer=out, **{"vocab_size": 90, "model_type": "bpe", "minloglevel": 3, "hard_vocab_limit": False} | options)
    return out.getvalue()


def texts(n):
    r = random.Random(7)
    return ["", " ", "▁", "   x  ", *("".join(r.choice(PARTS) + r.choice(["", "", " "]) for _ in range(r.randint(0, 25))) for _ in range(n))]


def held(path) -> None:
    ours = PieceBpe(str(path))
    for t in texts(600):
        ids, decoded = ours.encode(t)
        want = ours.library.encode(t, add_bos=True, add_eos=True)
        assert ours.model.normalizer(t) == ours.library.normalize(t), t
        assert np.frombuffer(ids, np.uint32).tolist() == want and decoded.decode() == ours.library.decode(want), t


@pytest.mark.parametrize("name", MODELS)
def test_models_are_the_library(tmp_path, name):
    (tmp_path / "m").write_bytes(trained(**MODELS[name]))
    held(tmp_path / "m")


@pytest.mark.parametrize("options", [{}, PLAIN | {"split_by_whitespace": False}, {"user_defined_symbols": ["lo", "x"]}])
def test_unused_pieces(tmp_path, options):
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb2.ModelProto.FromString(trained(**options))
    for p in [p for p in model.pieces if p.type == p.NORMAL and len(p.piece) > 1][::2]:
        p.type = p.UNUSED
    (tmp_path / "m").write_bytes(model.SerializeToString())
    held(tmp_path / "m")


def test_denormalised(tmp_path):
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb2.ModelProto.FromString(trained(**MODELS["identity"]))
    model.denormalizer_spec.CopyFrom(pb2.ModelProto.FromString(trained(normalization_rule_name="nfkc_cf")).normalizer_spec)
    (tmp_path / "m").write_bytes(model.SerializeToString())
    held(tmp_path / "m")


def test_refused(tmp_path):
    for name, options in {"unigram": {"model_type": "unigram"}, "no begin": {"bos_id": -1}}.items():
        (tmp_path / name).write_bytes(trained(**options))
        with pytest.raises(ValueError):
            PieceBpe(str(tmp_path / name))


def test_rows(spark, tmp_path):
    (tmp_path / "m").write_bytes(trained())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m"))
    docs = spark.createDataFrame(list(enumerate([*texts(20), None])), "doc_id long, text string")
    for r in encode_decode(docs, str(tmp_path / "m")).join(docs, "doc_id").collect():
        want = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == want and r["decoded"] == sp.decode(want) and r["n_tokens"] == len(want)
