"""Passages of many words that come twice, whatever their bytes."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from orbita.llm import suffix_dedup
from orbita.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passage_words(texts: list[str | None], count: int) -> list[int]:
    split = [WORD.findall(t or "") for t in texts]
    starts = [[tuple(ws[k : k + count]) for k in range(len(ws) - count + 1)] for ws in split]
    copies = Counter(s for x in starts for s in x)
    return [len({k + j for k, s in enumerate(x) if copies[s] > 1 for j in range(count)}) for x in starts]


@pytest.mark.parametrize("count", [1, 7, 51])
def test_passage_words(spark, count):
    """Ids are null or come again, rows come again, words run on at any white space, and some texts are one word over and over."""
    r = random.Random(count)
    space = lambda: r.choice([" ", "  ", "\n", "\t", "\x0b ", "\r\n"])
    some = lambda n: [r.choice(["a", "A", "bc", "é", "中", "x\xa0y", "\x1f"]) + str(r.randint(0, 40)) for _ in range(n)]
    pool = [some(r.randint(count, 3 * count)) for _ in range(8)]

    def text() -> str:
        parts = [r.choice([r.choice(pool)[r.randint(0, 3) :], some(r.randint(1, 2 * count)), ["of"] * r.randint(1, 3 * count)]) for _ in range(r.randint(0, 6))]
        return "".join(w + space() for p in parts for w in p)

    rows = [(r.choice([None, 1, 2, k]), text()) for k in range(120)] + [(3, None), (4, ""), (5, " \n"), (None, "of"), (6, "of " * 5 * count)]
    rows += [rows[0], rows[0], rows[7], (900, rows[8][1]), (901, " ".join(some(4000)))]
    want = passage_words([t for _, t in rows], count)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 64, with_text=False, passage_words=count).collect()
    size = lambda t: len((t or "").encode())
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_passage_words"]) for x in got) == sorted((str(i), size(t), n) for (i, t), n in zip(rows, want, strict=True))
    assert any(want) and not all(want)


def test_passages_of_under_400_bytes(spark, tmp_path):
    """A passage of 51 words in two documents is reported; nothing of it is removed, as it has under 400 bytes. One of 50 words isn't reported."""
    own = lambda d, n: [f"{d}w{k}" for k in range(n)]
    rows = [(1, own("a", 30) + own("p", 51) + own("b", 20)), (2, own("p", 51) + own("c", 60)), (3, own("d", 40) + own("q", 50) + own("e", 9)), (4, own("q", 50)), (5, own("f", 200))]
    spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: (x["n_removed"], x["n_passage_words"]) for x in QUERIES["op9_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, 51), 2: (0, 51), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_passages_are_optional(spark):
    df = spark.createDataFrame([(1, "x y")], "doc_id bigint, text string")
    assert "n_passage_words" not in suffix_dedup.remove_repeats(df, 64).columns
    columns = suffix_dedup.remove_repeats(df, 64, passage_words=2).columns
    assert columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "changed", "n_passage_words", "kept", "span_starts", "span_ends"]
    assert suffix_dedup.remove_repeats(df.limit(0), 64, passage_words=2).count() == 0
    with pytest.raises(ValueError, match="passage_words"):
        suffix_dedup.remove_repeats(df, 64, passage_words=0)
