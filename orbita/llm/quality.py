"""Quality rules: a ledger of rule failures as bits, and policies that read only the ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each rule that failed.
A policy is a versioned pair of masks; applying one, or asking what the removal of a rule would change, needs no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbita.llm.bytes_np import groups, mix, shingles, utf8, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_alpha_words", "n_bullet_lines", "n_ellipsis_lines", "max_word_chars")

#: Name and condition of failure of each rule; its place is its bit. New rules go at the end, so that stored ledgers stay readable.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines > 2 and 10 * n_dup_lines > 5 * n_lines"),
    ("few_alphabetic_words", "10 * n_alpha_words < 5 * n_words"),
    ("bullet_lines", "n_lines > 2 and 10 * n_bullet_lines > 9 * n_lines"),
    ("ellipsis_lines", "n_lines > 2 and 10 * n_ellipsis_lines > 3 * n_lines"),
    ("giant_word", "max_word_chars > 1000"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """Rejects a document if a rule of ``any_of`` failed, or at least ``at_least`` rules of ``count_of``."""

    version: str
    any_of: int
    count_of: int = 0
    at_least: int = 1

    def rejects(self, bits: Column) -> Column:
        out = bits.bitwiseAND(F.lit(self.any_of)) != 0
        return out | (F.bit_count(bits.bitwiseAND(F.lit(self.count_of))) >= self.at_least) if self.count_of else out


BASE = Policy("base-1", BIT["few_words"] | BIT["repeated_windows"])
#: The policy in use: the base rules, and what is junk on any reading.
CURRENT = Policy(
    "2",
    BASE.any_of | BIT["short_words"] | BIT["long_words"] | BIT["symbols"] | BIT["duplicate_lines"] | BIT["few_alphabetic_words"] | BIT["bullet_lines"] | BIT["ellipsis_lines"],
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BULLETS = (b"-", b"*", "•".encode())
_SPACES = b" \t\n\r\x0b\x0c"


def _lines(text: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier one, those that open with a bullet, those that end in an ellipsis."""
    seen: set[bytes] = set()
    n = bullets = dots = 0
    for line in text.split(b"\n"):
        if core := line.strip(_SPACES):
            n += 1
            seen.add(line)
            bullets += core.startswith(_BULLETS)
            dots += core.endswith((b"...", "…".encode()))
    return n, n - len(seen), bullets, dots


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the measurements to batches whose last column is the text to measure, in that column's place."""
    for batch in batches:
        offsets, data = utf8(batch.column(batch.num_columns - 1))
        n = batch.num_rows
        out = {m: np.zeros(n, np.int64) for m in MEASURES}
        for lo, hi in groups(offsets):
            at = offsets[lo : hi + 1]
            b = data[at[0] : at[-1]]
            row, start, end, h = words(at, data, lower=False)
            k = hi - lo
            lead = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))  # code points before each byte
            chars = lead[end] - lead[start]
            begin = at - at[0]
            out["n_words"][lo:hi] = np.bincount(row, minlength=k)
            out["word_chars"][lo:hi] = np.bincount(row, chars, minlength=k).astype(np.int64)
            out["n_chars"][lo:hi] = np.diff(lead[begin])
            for name, table in (("n_symbols", _SYMBOL),):
                out[name][lo:hi] = np.diff(np.concatenate(([0], np.cumsum(table[b])))[begin])
            letters = np.concatenate(([0], np.cumsum(_LETTER[b])))
            out["n_alpha_words"][lo:hi] = np.bincount(row[letters[end] > letters[start]], minlength=k)
            np.maximum.at(out["max_word_chars"], row + lo, chars)
            # words in a 3-word window that the text has twice or more
            wrow, sh = shingles(row, h, 3)
            key = mix(sh + wrow.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            window = np.flatnonzero((row[:-2] == row[2:]) if len(row) > 2 else np.zeros(0, bool))[twice]
            covered = np.zeros(len(row), bool)
            for j in range(3):
                covered[window + j] = True
            out["n_repeat_words"][lo:hi] = np.bincount(row[covered], minlength=k)
            whole = b.tobytes()
            for i in range(k):
                j = lo + i
                out["n_lines"][j], out["n_dup_lines"][j], out["n_bullet_lines"][j], out["n_ellipsis_lines"][j] = _lines(whole[begin[i] : begin[i + 1]])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(out[m]) for m in MEASURES)], names=[*batch.schema.names[:-1], *map(_own, MEASURES)])


def _own(measure: str) -> str:
    return f"__q_{measure}"


def _judged(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the measurements and ``__q_failures``, in one pass without a shuffle."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(_own(m), T.LongType()) for m in MEASURES)])
    out = docs.select("*", text.alias("__q_text")).mapInArrow(_measure, schema)
    bits = F.lit(0).cast("bigint")
    for k, (_, fails) in enumerate(RULES):
        fails = re.sub(r"[a-z]\w+", lambda m: _own(m[0]) if m[0] in MEASURES else m[0], fails)
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return out.withColumn("__q_failures", bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, failures bigint): one row for each document; bit k of ``failures`` is set if rule k failed.

    Null and empty texts have zero in all measurements. Repeated ids keep a row each. An empty table gives no rows.
    """
    pair = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("__q_in"))
    judged = _judged(pair, F.col("__q_in"))
    return judged.select("doc_id", *(F.col(_own(m)).alias(m) for m in MEASURES), F.col("__q_failures").alias("failures"))


def apply_policy(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Adds ``policy`` and ``kept`` to a ledger. Never looks at a text."""
    return rows.withColumns({"policy": F.lit(policy.version), "kept": ~policy.rejects(F.col("failures"))})


def ablations(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without): for each rule of ``policy``, what rejecting without it would keep. One pass, bits only.

    ``n_only`` counts documents that no other rule of the policy rejects.
    """
    used = [(name, BIT[name]) for name, _ in RULES if policy.any_of & BIT[name]]
    per = []
    for name, bit in used:
        rest = Policy(policy.version, policy.any_of & ~bit, policy.count_of & ~bit, policy.at_least)
        f = F.col("failures")
        per.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.count_if(f.bitwiseAND(F.lit(bit)) != 0).alias("n_failed"),
                F.count_if(policy.rejects(f) & ~rest.rejects(f)).alias("n_only"),
                F.count_if(~rest.rejects(f)).alias("n_kept_without"),
            )
        )
    return rows.agg(F.array(*per).alias("x")).select(F.inline("x"))


def quality_filter(docs: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns, each judged by its own text; ids aren't used, so they may be null or come again.

    An empty table stays empty. Columns may have any names.
    """
    plain = docs.toDF(*(f"column{i}" for i in range(len(docs.columns))))
    judged = _judged(plain, F.col(f"column{docs.columns.index(text_col)}").cast("string")).filter(~policy.rejects(F.col("__q_failures")))
    return judged.select(*plain.columns).toDF(*docs.columns)
