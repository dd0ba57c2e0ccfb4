"""Secret scans in DataFrame functions only: patterns, and a battery of randomness tests under a bound on false discoveries.

Patterns give the base spans. The battery looks at every other run of 20 characters or more from the base64 alphabets. It infers the encoding
from the characters that occur, and makes three tests for it: whether the symbols are uniform (chi-squared), whether kinds of symbols change as often as
chance has it (runs), and whether neighbours depend on each other (serial correlation). Each test is read in two ways. Against chance, a run must not be rejected at
ALPHA_Z. Against ordinary text, each gives a standard score: text has more coincident symbols, fewer changes of kind (upper, lower, digit, sign), and more changes
between vowels and consonants, than chance has. The mean of the three scores gives the probability that text looks so random. Benjamini and
Hochberg's procedure over those probabilities of all runs of the corpus, apart for each class of length, sets how small one must be.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbita.llm.shared import cut

#: Kind, pattern and least length of the group that counts, in the order in which kinds are listed. Java's (?i) is for ASCII letters alone.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"  # a run below 18 matches nothing, here as where longer and shorter ones are found first
HEX = "[0-9a-f]{16,}"
RUN = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

#: Greatest share of false discoveries, and the least probability that each randomness test may have.
FALSE_DISCOVERIES = 0.05
ALPHA_Z = 3.09  # one in a thousand
#: Sums of squares and cubes of the frequencies of letters in text.
TEXT_SQUARES, TEXT_CUBES = 0.0667, 0.0056
#: Share of neighbours in text that change kind, at most (names in camel case and with digits have many), and share of neighbouring letters of which one is a vowel, at least.
TEXT_CHANGES, TEXT_VOWELS = 0.25, 0.55
#: Pairs of letters without which vowels tell nothing.
LEAST_PAIRS = 4
BINS_PER_DECADE = 8
MOST_BIN = 2400

_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ENCODINGS = (
    ("^[0-9]+$", _DIGITS),
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[a-z]+$", _LOW),
    ("^[A-Z]+$", _UP),
    ("^[A-Z2-7]+$", _UP + "234567"),
    ("^[a-z0-9]+$", _DIGITS + _LOW),
    ("^[A-Z0-9]+$", _DIGITS + _UP),
    ("^[A-Za-z0-9]+$", _UP + _LOW + _DIGITS),
    ("^[A-Za-z0-9+/]+$", _UP + _LOW + _DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", _UP + _LOW + _DIGITS + "-_"),
)
_ANY = _UP + _LOW + _DIGITS + "+/-_="
_PIECE = 512


def _sums(array: str) -> str:
    """SQL for the running sums before each element of an array of ints: over pieces of _PIECE first, so that long arrays don't cost their square."""
    pieces = f"transform(sequence(0, (size({array}) - 1) div {_PIECE}), p -> slice({array}, p * {_PIECE} + 1, {_PIECE}))"
    running = "aggregate({0}, named_struct('t', {1}, 'o', cast(array() as array<int>)), (a, x) -> named_struct('t', a.t + {2}, 'o', concat(a.o, array(a.t))), a -> a.o)"
    totals = f"transform({pieces}, p -> aggregate(p, 0, (a, x) -> a + x))"
    starts = running.format(totals, "0", "x")
    inner = running.format("p", "s", "x")
    return f"if(size({array}) = 0, cast(array() as array<int>), flatten(zip_with({pieces}, {starts}, (p, s) -> {inner})))"


def _with_spans(df: DataFrame, name: str, pattern: str, group: int = 0) -> DataFrame:
    """Adds ``name``: array of (s, e, v): leftmost non-overlapping matches of ``text`` in code points, and the group's text."""
    hit = F.col("text").rlike(pattern)
    df = df.withColumn("__gap", F.when(hit, F.transform(F.split("text", pattern, -1), F.length)).otherwise(F.lit(None)))
    df = df.withColumn("__all", F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.lit(None)))
    df = df.withColumn("__val", F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(F.lit(None)) if group else F.col("__all"))
    # what lies before match i: gaps up to it, and the matches before it
    df = df.withColumn("__len", F.expr("transform(__all, (x, i) -> length(x) + get(__gap, i))")).withColumn("__sum", F.expr(_sums("__len")))
    spans = "transform(__all, (x, i) -> named_struct('s', get(__sum, i) + get(__gap, i), 'e', get(__sum, i) + get(__gap, i) + length(x), 'v', get(__val, i)))"
    return df.withColumn(name, F.coalesce(F.expr(spans), F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)"))).drop("__gap", "__all", "__val", "__len", "__sum")


def _pairs(array: str, step: str) -> str:
    """SQL for the sum of ``step`` over the neighbours x, y of an array."""
    return f"aggregate(zip_with(slice({array}, 1, size({array}) - 1), slice({array}, 2, size({array}) - 1), (x, y) -> {step}), 0D, (a, x) -> a + x)"


def _scored() -> list[str]:
    """Successive SQL steps over each r of the array of (s, e, v). The characters of a run are taken apart once, so that work grows with its length."""
    alphabet = "case " + " ".join(f"when r.v rlike '{p}' then '{a}'" for p, a in _ENCODINGS) + f" else '{_ANY}' end"
    count = "(length({0}) - length(replace({0}, substring({1}, i, 1), '')))"
    squares = "aggregate(sequence(1, length({1})), 0D, (a, i) -> a + pow(" + count + ", 2))"
    kind = "case when c between 'a' and 'z' then 1 when c between 'A' and 'Z' then 2 when c between '0' and '9' then 3 else 4 end"
    sound = "case when instr('aeiouAEIOU', c) > 0 then 1 when c between 'a' and 'z' or c between 'A' and 'Z' then 2 else 0 end"
    keep = "'s', r.s, 'e', r.e, 'n', r.n"
    half = "if((2 * x >= r.k) <> (2 * y >= r.k), 1D, 0D)"
    product = "(x - r.m) * (y - r.m)"
    zchi = "(pow(r.chi / (r.k - 1), 1D / 3) - (1 - 2D / (9 * (r.k - 1)))) / sqrt(2D / (9 * (r.k - 1)))"
    pairs = "r.n * (r.n - 1D)"
    t1 = f"({pairs} / 2 * {TEXT_SQUARES} - r.same) / sqrt({pairs} / 2 * {TEXT_SQUARES * (1 - TEXT_SQUARES)} + {pairs} * (r.n - 2) * {TEXT_CUBES - TEXT_SQUARES**2})"
    t2 = f"(r.changes - {TEXT_CHANGES}D * (r.n - 1)) / sqrt({TEXT_CHANGES * (1 - TEXT_CHANGES)}D * (r.n - 1))"
    t3 = f"if(r.letters < {LEAST_PAIRS}, 0D, ({TEXT_VOWELS}D * r.letters - r.turns) / sqrt({TEXT_VOWELS * (1 - TEXT_VOWELS)}D * greatest(r.letters, 1)))"
    t = "(1 / (1 + 0.2316419D * r.z))"
    tail = f"(exp(-r.z * r.z / 2) / 2.5066282746D * {t} * (0.31938153D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D)))))"
    log = f"if(r.z <= 0, 0D, if(r.z > 30, r.z * r.z / 2 * {math.log10(math.e)}, -log10({tail})))"
    return [
        f"named_struct('s', r.s, 'e', r.e, 'v', r.v, 'n', length(r.v), 'alpha', {alphabet}, 'chars', slice(split(r.v, ''), 1, length(r.v)))",
        f"named_struct({keep}, 'k', length(r.alpha), 'codes', transform(r.chars, c -> instr(r.alpha, c) - 1D), 'kinds', transform(r.chars, c -> {kind}), 'sounds', transform(r.chars, c -> {sound}), "
        f"'chi', length(r.alpha) * {squares.format('r.v', 'r.alpha')} / r.n - r.n, 'same', ({squares.format('lower(r.v)', repr(_DIGITS + _LOW + '+/-_='))} - r.n) / 2)",
        f"named_struct({keep}, 'k', r.k, 'codes', r.codes, 'zchi', {zchi}, 'same', r.same, 'm', aggregate(r.codes, 0D, (a, x) -> a + x) / r.n, "
        f"'changes', {_pairs('r.kinds', 'if(x <> y, 1D, 0D)')}, 'letters', {_pairs('r.sounds', 'if(x > 0 and y > 0, 1D, 0D)')}, 'turns', {_pairs('r.sounds', 'if(x > 0 and y > 0 and x <> y, 1D, 0D)')})",
        f"named_struct({keep}, 'zchi', r.zchi, 'z', ({t1} + {t2} + {t3}) / sqrt(3D), 'zruns', ({_pairs('r.codes', half)} - (r.n - 1) / 2D) / sqrt((r.n - 1) / 4D), "
        f"'zserial', coalesce(try_divide({_pairs('r.codes', product)}, aggregate(r.codes, 0D, (a, x) -> a + pow(x - r.m, 2))), 1D) * sqrt(r.n))",
        f"named_struct({keep}, 'zchi', r.zchi, 'zruns', r.zruns, 'zserial', r.zserial, 'p', {log})",
        f"named_struct({keep}, 'class', cast(floor(log2(r.n)) as int), 'bin', cast(least(floor(r.p * {BINS_PER_DECADE}), {MOST_BIN}) as int), "
        f"'random', r.zchi <= {ALPHA_Z} and abs(r.zruns) <= {ALPHA_Z + 0.2} and abs(r.zserial) <= {ALPHA_Z + 0.2})",
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", own: Column | None = None) -> DataFrame:
    """(doc_id, own, base, runs): base spans (s, e, kind's number), and the other runs with the class of their length, the bin of their probability as text, and whether they pass as random."""
    df = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), (F.lit(None).cast("string") if own is None else own).alias("own"))
    df = _with_spans(df, "assign", ASSIGN, 2)
    for name, pattern in (("access", ACCESS), ("hex", HEX), ("runs", RUN)):
        df = _with_spans(df, name, pattern)
    base = "concat(transform(filter(assign, x -> length(x.v) >= 12), x -> struct(x.s, x.e, 0 as kind)), transform(access, x -> struct(x.s, x.e, 1 as kind)), transform(hex, x -> struct(x.s, x.e, 2 as kind)))"
    df = df.select("doc_id", "own", F.array_sort(F.expr(f"transform({base}, x -> named_struct('s', x.s, 'kind', x.kind, 'e', x.e))")).alias("base"), "runs")
    df = df.withColumn("runs", F.when(F.size("runs") > 0, F.expr("filter(runs, r -> not exists(base, b -> r.s < b.e and b.s < r.e))")).otherwise(F.col("runs")))
    for step in _scored():
        df = df.withColumn("runs", F.expr(f"transform(runs, r -> {step})"))
    return df


def thresholds(rows: DataFrame, q: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """The least bin that counts as a discovery in each class of length (a class for each power of two); classes without discoveries are absent."""
    counts = rows.select(F.explode("runs").alias("r")).groupBy("r.class", "r.bin").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("class").orderBy(F.col("bin").desc())
    ranked = counts.withColumn("as_small", F.sum("n").over(up)).withColumn("m", F.sum("n").over(Window.partitionBy("class")))
    good = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) * F.col("m") <= q * F.col("as_small"))
    return {r["class"]: r["bin"] for r in good.groupBy("class").agg(F.min("bin").alias("bin")).collect()}


def scan_secrets(docs: DataFrame, q: float = FALSE_DISCOVERIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (s, kind, e), kind as a number of KINDS, by start, then kind; offsets in code points, ends exclusive.

    ``spans`` are the base spans, all of them, and those runs apart from base spans that pass as random and are discoveries. Null text is empty
    and has none. A row for each row, each from its own text: ids may be null or come again. An empty table gives an empty one. Other columns of ``docs`` aren't read.
    """
    rows, least = _found(docs, q, id_col, text_col)
    return rows.select("doc_id", "base", _spans(least).alias("spans"))


def _found(docs: DataFrame, q: float, id_col: str, text_col: str, own: Column | None = None) -> tuple[DataFrame, dict[int, int]]:
    rows = cut(measured(docs, id_col, text_col, own), "runs")
    return rows, thresholds(rows, q)


def _spans(least: dict[int, int]) -> Column:
    """Base spans and discoveries of a row of :func:`measured`."""
    bound: Column = F.create_map(*(F.lit(x) for pair in (least or {-1: 0}).items() for x in pair))
    found = F.filter("runs", lambda r: r["random"] & F.coalesce(r["bin"] >= bound[r["class"]], F.lit(False)))
    extra = F.transform(found, lambda r: F.struct(r["s"].alias("s"), F.lit(3).alias("kind"), r["e"].alias("e")))
    return F.array_sort(F.concat("base", extra))


def joined(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): texts with every span, or run of overlapping spans, replaced by ``mask``. A row for each row, whatever the ids; null stays null."""
    rows, least = _found(docs, FALSE_DISCOVERIES, id_col, text_col, F.col(f"`{text_col}`").cast("string"))
    step = """aggregate(spans, named_struct('at', 0, 'out', ''), (a, x) -> if(x.s < a.at, named_struct('at', greatest(a.at, x.e), 'out', a.out),
        named_struct('at', x.e, 'out', concat(a.out, substring(text, a.at + 1, x.s - a.at), :mask))), a -> concat(a.out, substring(text, a.at + 1)))"""
    return rows.select("doc_id", F.col("own").alias("text"), _spans(least).alias("spans")).select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.expr(step.replace(":mask", repr(mask)))).alias("text"))
