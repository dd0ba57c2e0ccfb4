"""Token files, token counts and sentencepiece coding against their libraries."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from orbita.llm import token_counts, token_files
from orbita.llm.sentencepiece_codec import PieceBpe, encode_decode
from orbita.llm.shared import fresh_path

ALPHABET = [
    "a", "é", "É", "ß", "İ", "ſ", "Σ", "σ", "中", "😀", "́", "'s", "'S", "<|endoftext|>", "<|", "1", "²", "½", "_", "\t", "\n", "\r", " ", "  ", "\xa0", " ", "\x85", "\x1c", "\x00",
    "the", "THE", "ª", "'ll", "…", "​", "ﬁ", "▁", "<s>", "</s>", "<0x41>", "<unk>", "ing", "tion", "﻿",
]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["", " ", "   x", "x" * 5000, "the " * 3000] + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "x") for i, t in enumerate(texts(300))] + [(10_000, None, "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string").repartition(3)


def test_word_bpe_is_the_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    ours, full = token_files.WordBpe(path), Tokenizer.from_file(path)
    for t in texts(3000, 2):
        assert np.frombuffer(ours.encode(t), np.uint32).tolist() == full.encode(t, add_special_tokens=False).ids, t


def test_word_cache_forgets_without_harm():
    cache = token_files.WordCache(lambda w: w.upper(), most=4)
    r = random.Random(1)
    for _ in range(500):
        w = r.choice("abcdefghijk")
        assert cache[w] == w.upper() and len(cache) <= 5


def test_round_trip(spark, docs):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in token_files.token_round_trip(docs, P.path("word_bpe_49k.json")).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = full.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_sequences_have_one_length(spark, docs):
    uri = fresh_path(spark, "tokens")
    manifest = token_files.write_tokens(docs, P.path("word_bpe_49k.json"), uri, partitions=2)
    for r in manifest.collect():
        table, real = token_files.sequences(uri, r["file"])
        assert real == r["n_tokens"] and all(len(x) == token_files.SEQ_LEN for x in table.column("ids").to_pylist())
    assert manifest.agg({"n_docs": "sum"}).first()[0] == docs.count()


def test_no_documents(spark, docs):
    assert token_files.token_round_trip(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0
    assert encode_decode(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0
    lengths = token_counts.encoded_lengths(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    sums = token_counts.suffix_sums(token_counts.length_histogram(lengths))
    assert sums.count() == 0 and token_counts.quantiles(sums, [0.5]).count() == 0
    assert token_counts.at_limits(sums, [10]).first()["total"] == 0


def test_pieces_are_the_library():
    ours = PieceBpe(P.path("piece_bpe_32k.model"))
    for t in texts(3000, 3):
        ids, decoded = ours.encode(t)
        want = ours.library.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, np.uint32).tolist() == want and decoded.decode() == ours.library.decode(want), t


def test_encode_decode(spark, docs):
    sp = PieceBpe(P.path("piece_bpe_32k.model")).library
    for r in encode_decode(docs, P.path("piece_bpe_32k.model")).join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["decoded"] == sp.decode(ids) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_token_counts(spark, docs):
    enc = token_counts.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    n = sorted(len(enc.encode_ordinary(r["text"] or "")) for r in docs.collect())
    lengths = token_counts.encoded_lengths(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    sums = token_counts.suffix_sums(token_counts.length_histogram(lengths), block=7)
    for r in sums.collect():
        k = r["n_tokens"]
        assert r["n_docs"] == n.count(k) and r["docs_ge"] == sum(x >= k for x in n) and r["tokens_ge"] == sum(x for x in n if x >= k)
        assert r["docs_lt"] == sum(x < k for x in n) and r["truncated_total"] == sum(min(x, k) for x in n)
    for r in token_counts.at_limits(sums, [1, 7, 100, 10**6]).collect():
        k = r["context"]
        assert (r["total"], r["truncated"], r["lost"], r["docs_over"]) == (sum(n), sum(min(x, k) for x in n), sum(max(x - k, 0) for x in n), sum(x > k for x in n))
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == min(x for x in n if sum(y <= x for y in n) >= r["q"] * len(n))
