"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.llm import decontaminate as _decontaminate
from orbita.llm import line_dedup as _lines
from orbita.llm import lsh_forest as _forest
from orbita.llm import quality as _quality
from orbita.llm import secrets as _secrets
from orbita.llm import sentencepiece_codec as _codec
from orbita.llm import sharding as _sharding
from orbita.llm import suffix_dedup as _suffixes
from orbita.llm import token_counts as _counts
from orbita.llm import token_files as _files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine; executors need it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files.token_round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forest.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each length that occurs: documents of it, suffix sums, and the total under a context limit of it."""
    import public_tokenizers

    lengths = _counts.encoded_lengths(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return _counts.suffix_sums(_counts.length_histogram(lengths))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    n_hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", "n_near", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kind(k: int):
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")

    return _secrets.scan_secrets(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        kind(0).alias("n_assign"),
        kind(1).alias("n_access"),
        kind(2).alias("n_hex"),
        F.sha2(_secrets.joined("base").cast("binary"), 256).alias("base_sha256"),
        _secrets.joined("spans").alias("spans"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quality.apply_policy(_quality.ledger(_table(spark, sf_dir, "documents")), _quality.CURRENT)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _quality.BASE.rejects(F.col("failures")).alias("base_failed"), "kept", "failures")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = _sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", "grown_shard")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffixes.remove_repeats(_table(spark, sf_dir, "documents"), length=400, with_text=False, passage_words=51)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codec.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_lsh_forest": op2_lsh_forest,
    "op3_token_counts": op3_token_counts,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_secrets": op6_secrets,
    "op7_quality_rules": op7_quality_rules,
    "op8_sharding": op8_sharding,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_sentencepiece": op10_sentencepiece,
}

_TRIMMED = "trim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"

#: The rules' bits from measurements that this SQL takes by itself.
_FAILURES = " + ".join(f"CASE WHEN {fails} THEN {1 << k} ELSE 0 END" for k, (_, fails) in enumerate(_quality.RULES))

ORACLE: dict[str, str] = {
    "op7_quality_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, k, ws[k] || chr(10) || ws[k + 1] || chr(10) || ws[k + 2] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM rep, range(3) t(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha_words, coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS max_word_chars,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines, len(list_filter(ls, lambda x: regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
f AS (SELECT *, CAST({_FAILURES} AS BIGINT) AS failures FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, (failures & {_quality.CURRENT.any_of}) = 0 AS kept, failures FROM f
""",
    "op2_lsh_forest": r"""
WITH RECURSIVE norm AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda k: array_to_string(ws[k:k + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM norm)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(v, w) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.v, e.b FROM reach r JOIN e ON e.a = r.w),
c AS (SELECT v, min(w) AS component_id FROM reach GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op5_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
t AS (SELECT *, {_TRIMMED} AS norm FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, line_no) AS rn FROM t WHERE length(norm) >= 1),
u AS (SELECT doc_id, line_no, norm, length(norm) AS n FROM f WHERE rn = 1 AND length(norm) >= 32),
p AS (SELECT x.norm AS a, y.norm AS b, x.n AS na, y.n AS nb, x.doc_id, x.line_no FROM u x JOIN u y ON left(x.norm, 16) = left(y.norm, 16) AND abs(x.n - y.n) <= 1 AND (y.doc_id, y.line_no) < (x.doc_id, x.line_no)
  UNION SELECT x.norm, y.norm, x.n, y.n, x.doc_id, x.line_no FROM u x JOIN u y ON right(x.norm, 16) = right(y.norm, 16) AND abs(x.n - y.n) <= 1 AND (y.doc_id, y.line_no) < (x.doc_id, x.line_no)),
g AS (SELECT DISTINCT a AS norm FROM p WHERE
  (na = nb AND len(list_filter(range(1, na + 1), lambda i: substring(a, i, 1) <> substring(b, i, 1))) <= 1)
  OR (na <> nb AND len(list_filter(range(0, greatest(na, nb)), lambda i: left(if(na > nb, a, b), i) || substring(if(na > nb, a, b), i + 2) = if(na > nb, b, a))) > 0)),
m AS (SELECT t.doc_id, t.line_no, t.raw, coalesce(f.rn > 1 OR g.norm IS NOT NULL, false) AS gone, coalesce(f.rn = 1 AND g.norm IS NOT NULL, false) AS near
  FROM t LEFT JOIN f ON f.doc_id = t.doc_id AND f.line_no = t.line_no LEFT JOIN g ON g.norm = f.norm)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped, CAST(count_if(near) AS BIGINT) AS n_near,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
""",
    "op4_decontaminate": r"""
WITH norm AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS k FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS w FROM
  (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS k FROM norm, sizes WHERE len(ws) >= n)),
hits AS (SELECT s.doc_id, s.n, s.k, x.item FROM spots s JOIN windows x ON s.w = x.w AND s.n = x.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(f.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM norm d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
""",
}
