"""Every operator and stage over ids that are null or come again, repeated rows, clashing column names, nulls everywhere, one very long text, and empty tables."""

from __future__ import annotations

from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline
from orbita.llm import decontaminate, line_dedup, lsh_forest, quality, secrets, sharding, suffix_dedup, token_counts, token_files
from orbita.llm.sentencepiece_codec import encode_decode

COLUMNS = ["doc_id", "text", "size", "key", "gone", "component_id", "n_words", "shard", "runs", "rid", "TH", "scanned", "__q_failures", "row", "column0"]
SENTENCE = "seven small words stand in this line, and some more of them follow after it\n"


@pytest.fixture(scope="module")
def odd(spark):
    """Ids 3 and 4 come again with other texts; two rows have no id; one row comes twice; texts come again."""
    texts = [None, "", " ", "x", SENTENCE * 3, SENTENCE * 3, "é" * 30_000, "word " * 30_000, "\x00\x01", "a\nb\n" + SENTENCE]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "y " + SENTENCE), (4, ""), (3, "x"), (None, SENTENCE), (None, None)]
    full = [(*r, *["x" if k % 2 else None] * (len(COLUMNS) - 2)) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in COLUMNS[2:])).repartition(3)


OPERATORS = {
    "token_files": lambda d: token_files.token_round_trip(d, P.path("word_bpe_49k.json")),
    "lsh_forest": lsh_forest.near_duplicates,
    "token_counts": lambda d: token_counts.encoded_lengths(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "decontaminate": lambda d: decontaminate.scan(d, d.select(d.doc_id.alias("item_id"), "text", "size")),
    "line_dedup": line_dedup.dedup_lines,
    "secrets": secrets.scan_secrets,
    "redact": secrets.redact,
    "quality": quality.ledger,
    "sharding": sharding.shard_by_bytes,
    "suffix_dedup": lambda d: suffix_dedup.remove_repeats(d, 64),
    "sentencepiece": lambda d: encode_decode(d, P.path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(odd, name):
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(OPERATORS[name](odd)) == ids(odd)
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_no_lengths(odd):
    assert token_counts.suffix_sums(token_counts.length_histogram(OPERATORS["token_counts"](odd.limit(0)))).count() == 0


def test_near_duplicates_of_rows_that_share_ids(odd):
    """Rows of one id and different texts have sets of their own."""
    got = Counter(tuple(r) for r in lsh_forest.near_duplicates(odd, 5, 80).select("doc_id", "n_shingles", "component_id", "kept").collect())
    n = lambda text: len({tuple(w[k : k + 5]) for w in [text.split()] for k in range(len(w) - 4)})
    own, more = n(SENTENCE), n(SENTENCE * 3)
    assert got == Counter(
        [(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (4, more, 4, True), (5, more, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True)]
        + [(9, own + 2, 3, False), (3, own + 1, 3, True), (4, 0, 4, True), (None, own, 3, False), (None, 0, None, True)]
    )


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_rows(spark, odd, name, stage):
    sf_dir = "/root/testdata/sf0.001"
    out = stage(spark, odd, sf_dir)
    assert out.columns == odd.columns
    left = {"quality_rules": None, "near_dedup": 11, "line_dedup": 15, "decontamination": 15}[name]
    assert left is None or out.count() == left
    assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_encoding_of_no_rows(spark, odd):
    assert corpus_pipeline.encoding(spark, odd.limit(0), "").count() == 0 and corpus_pipeline.encoding(spark, odd, "").count() == 15
