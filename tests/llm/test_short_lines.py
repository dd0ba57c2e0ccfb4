"""Short lines: equal ones go, near ones and blank ones stay."""

from __future__ import annotations

import corpus_pipeline
from orbita.llm import line_dedup


def test_short_lines(spark):
    rows = [(1, "All rights reserved.\n\nx\nRights"), (2, " All rights reserved.\n\nAll rights reserved!\nx\n" + "y" * 31), (3, "y" * 31 + "\n" + "y" * 32 + "\n" + "z" * 40), (4, "z" * 39), (5, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == {1: rows[0][1], 2: "\nAll rights reserved!\n" + "y" * 31, 3: "y" * 32 + "\n" + "z" * 40, 4: "", 5: None}
    assert {x["doc_id"]: x["text"] for x in line_dedup.without_repeated_lines(df, exact_from=32).collect()} == dict(rows) | {4: ""}
