"""The pipeline puts the encoded corpus out."""

from __future__ import annotations

import hashlib

import numpy as np

import corpus_pipeline


def test_encoding_gives_ids(spark):
    rows = [(1, "some plain words\nand a line"), (2, ""), (3, None)]
    got = corpus_pipeline.encoding(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted(x["doc_id"] for x in got) == [1, 2, 3]
    for x in got:
        assert len(x["ids"]) == x["n_tokens"] >= 2
        assert hashlib.sha256(np.array(x["ids"], np.int32).tobytes()).hexdigest() == x["ids_sha256"]
        assert hashlib.sha256(x["decoded"].encode()).hexdigest() == x["decoded_sha256"]
