"""Stages of the pipeline on what they must not leave behind."""

from __future__ import annotations

import random

import pytest
from test_duplicates import shingle_set

import corpus_pipeline


@pytest.mark.parametrize("n", [200, 1200])
def test_near_dedup_of_a_star_family(spark, n):
    """Copies that are like the first document, but not like each other: all those that are near it go."""
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, n + 1):
        w = list(base)
        for p in r.sample(range(300), 6):
            w[p] = f"v{r.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingle_set(t, 5) for i, t in rows}
    near = {i for i, s in sets.items() if i and 100 * len(s & sets[0]) >= 80 * len(s | sets[0])}
    kept = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    assert len(near) > n // 2 and not kept & near and 0 in kept
