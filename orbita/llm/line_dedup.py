"""Line dedup within one edit, by a deletion-neighbourhood join in DataFrame functions only.

Two lines are within one edit just if they agree after one character is deleted from both at one place, or from the longer one. So
each line gives the hashes of its variants, and equal variants meet. To emit few, lines are first held against each other with whole blocks
deleted (two to a line, and parts of the blocks that met again and again, until they are short); only lines that agree outside some short block give the
variants of that block. So the work on a line grows as its length, but for a logarithm. Equal lines are one line from the start,
and the earliest of a group of variants answers for it, so groups are summed and never paired.

Documents are known by (rid, th), see :func:`orbita.llm.shared.keyed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbita.llm.shared import cut, free_names, keyed, with_keys

#: Lines of fewer characters have no near matches unless asked for, as an edit weighs more in them.
NEAR_FROM = 32
BLOCKS = 2
#: Blocks wider than that are cut into PARTS.
NARROW, PARTS = 32, 16
#: Rows of (document, line, block), of some 50 bytes each, that are broadcast at most.
BROADCAST_ROWS = 500_000
UNIT = 4 * BLOCKS
_TRIM = "trim(BOTH '\\t\\n\\u000b\\f\\r ' FROM {})"
_DOC = ["rid", "th"]
_AT = [*_DOC, "line_no"]


def _norm(raw: str) -> Column:
    """A line as it is compared: without white space at its ends."""
    return F.expr(_TRIM.format(raw))


def _block_keys(near_from: int) -> Column:
    """Blocks of ``norm`` for its own length class and that of a line shorter by one: characters before and after the block, its least width, and a hash of what is outside it."""
    step = UNIT // BLOCKS
    block = f"named_struct('a', {step} * q * j, 'b', {step} * q * ({BLOCKS - 1} - j), 'w', {step} * q, 'k', {_outside(f'{step} * q * j', f'{step} * q * ({BLOCKS - 1} - j)', 'q, j')})"
    one = f"transform(if(q = 0, array(0), sequence(0, {BLOCKS - 1})), j -> {block})"
    classes = f"array_distinct(if(length(norm) > {near_from}, array(cast(length(norm) div {UNIT} as int), cast((length(norm) - 1) div {UNIT} as int)), array(cast(length(norm) div {UNIT} as int))))"
    return F.expr(f"if(length(norm) < {max(1, near_from)}, array(), flatten(transform({classes}, q -> {one})))")


def _outside(a: str, b: str, more: str) -> str:
    return f"xxhash64({more}, substring(norm, 1, {a}), if({b} = 0, '', right(norm, {b})))"


#: How a line may meet others in a block: in any way; at its own length; as the longer one, and as the shorter one.
ANY, SAME, LONGER, SHORTER = range(4)


def _narrowed(blocks: DataFrame, picked: DataFrame) -> DataFrame:
    """Parts of the blocks in which lines still meet, as wide as NARROW at most, and how they meet there.

    Of a run of equal characters, the longer line deletes the first; so two lines of different lengths meet in one part, were they one character over and over.
    """
    done = None
    blocks = blocks.withColumn("role", F.lit(ANY))
    while True:
        small = blocks.filter(F.col("w") <= NARROW)
        done = small if done is None else done.unionByName(small)
        wide = blocks.filter(F.col("w") > NARROW)
        if wide.isEmpty():
            return done
        step = f"(w div {PARTS})"
        place = f"transform(sequence(0, {PARTS - 1}), i -> named_struct('a', cast(a + {step} * i as int), 'b', cast(b + {step} * ({PARTS - 1} - i) as int), 'w', cast(w - {PARTS - 1} * {step} as int)))"
        parts = wide.join(picked, _AT).select(*_AT, "role", "norm", F.explode(F.expr(place)).alias("x")).select(*_AT, "role", "norm", "x.*")
        varied = "(a = 0 or replace(substring(norm, a, length(norm) - b - a + 1), substring(norm, a, 1), '') <> '')"
        roles = f"filter(if(role = {ANY}, array({SAME}, {LONGER}, {SHORTER}), array(role)), r -> r <> {LONGER} or {varied})"
        parts = parts.select(*_AT, "a", "b", "w", F.expr(_outside("a", "b", "a, b, w")).alias("h"), F.length("norm").alias("n"), F.explode(F.expr(roles)).alias("role"))
        key = F.xxhash64("h", F.when(F.col("role") == SHORTER, F.col("n") + 1).otherwise(F.col("n")), F.col("role") == SAME)
        blocks = _met(cut(parts.select(*_AT, "a", "b", "w", "role", key.alias("k")), "block_parts"), "block_parts")


def _met(blocks: DataFrame, name: str) -> DataFrame:
    """The blocks whose hash comes twice. Shuffled at every size, so that disk grows as the input does."""
    keys = blocks.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    return cut(blocks.join(cut(keys, "keys").hint("merge"), "k", "left_semi").drop("k"), name)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_from: int = 1, near_from: int = NEAR_FROM) -> DataFrame:
    """(rid, th, line_no, near): lines that go. A line goes if an earlier one (by document id, then place) equals it, or the first
    line equal to it is within one edit of an earlier one (``near``). Whether the earlier one itself goes does not matter.

    Lines count by what is between white space: those of ``exact_from`` characters or more where equal, of ``near_from`` or more where near.
    Of documents of one id, the one of the lesser hash is earlier; those without an id come last; those equal in id and text count as one.
    """
    if exact_from < 1 or near_from < exact_from:
        raise ValueError("near_from must be exact_from at least, and that 1 at least")
    texts = keyed(docs, id_col, text_col).select(*_DOC, "text")
    exploded = texts.select(*_DOC, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).select(*_AT, _norm("raw").alias("norm")).filter(F.length("norm") >= exact_from)
    lines = cut(exploded.select(*_AT, F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(7), "norm", F.length("norm")).alias("h2"), _block_keys(near_from).alias("blocks")), "lines")
    first = lines.groupBy("h1", "h2").agg(F.min(F.struct(*_AT)).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("blocks").alias("blocks"))
    blocks = _met(first.select("at.*", F.explode("blocks").alias("x")).select(*_AT, "x.*"), "met")
    wanted = blocks.groupBy(*_DOC).agg(F.collect_set("line_no").alias("wanted"))
    # few lines meet as a rule; then the texts needn't move, beyond the bound they do
    wanted = F.broadcast(wanted) if blocks.count() <= BROADCAST_ROWS else wanted
    picked = texts.join(wanted, _DOC).withColumn("parts", F.split("text", "\n", -1)).select(*_DOC, F.explode(F.expr("transform(wanted, w -> struct(w as line_no, get(parts, w) as raw))")).alias("w"))
    picked = cut(picked.select(*_DOC, "w.line_no", _norm("w.raw").alias("norm")).dropDuplicates(_AT), "picked")
    blocks = _narrowed(blocks, picked)
    # variants: one character deleted at p, for the places of the blocks that met; and the line whole, at -1
    fresh = "p = 0 or substring(norm, p, 1) <> substring(norm, p + 1, 1)"
    inside = f"case when x.role = {SHORTER} then array() when x.role = {LONGER} then filter(sequence(x.a, length(norm) - 1 - x.b), p -> {fresh}) else sequence(x.a, length(norm) - 1 - x.b) end"
    places = f"array_distinct(flatten(transform(blocks, x -> {inside})))"
    variant = "xxhash64(concat(substring(norm, 1, p), substring(norm, p + 2)))"
    near = picked.join(blocks.groupBy(*_AT).agg(F.collect_set(F.struct("a", "b", "role")).alias("blocks")), _AT)
    variants = near.select(F.struct(*_AT).alias("at"), F.explode(F.expr(f"concat(array(struct(-1 as p, xxhash64(norm) as h)), transform({places}, p -> struct(p, {variant} as h)))")).alias("v")).select("at", "v.p", "v.h")
    by_text, by_place = Window.partitionBy("h"), Window.partitionBy("h", "p")
    whole, who = F.col("p") < 0, F.struct("at", "p")
    meets = variants.select(
        "at",
        "p",
        F.when(whole, F.min(F.when(~whole, who)).over(by_text)).otherwise(F.least(F.min(who).over(by_place), F.min(F.when(whole, who)).over(by_text))).alias("by"),
    ).filter("by.at < at")
    best = meets.groupBy("at").agg(F.min(F.struct(F.col("by.at").alias("by"), "p", F.col("by.p").alias("q"))).alias("m")).select("at", "m.*")
    mine, other = picked.select(F.struct(*_AT).alias("at"), "norm"), picked.select(F.struct(*_AT).alias("by"), F.col("norm").alias("other"))
    without = "if({1} < 0, {0}, concat(substring({0}, 1, {1}), substring({0}, {1} + 2)))".format
    close = best.join(mine, "at").join(other, "by").filter(f"{without('norm', 'p')} = {without('other', 'q')}").select("at")
    # the first of equal lines and, with it, all lines equal to it
    gone = first.select("h1", "h2", "at", "copies").join(close.withColumn("near", F.lit(True)), "at", "left").filter("copies > 1 or near").select("h1", "h2", "at", F.coalesce("near", F.lit(False)).alias("near"))
    gone = cut(gone, "gone")  # joined as a written table, so that a line of very many copies can be split
    lead = F.struct(*_AT) == F.col("at")
    return lines.select(*_AT, "h1", "h2").join(gone.hint("merge"), ["h1", "h2"]).filter(F.col("near") | ~lead).select(*_AT, (F.col("near") & lead).alias("near"))


_KEPT = "array_join(transform(array_except(sequence(0, size({parts}) - 1), {gone}), i -> get({parts}, i)), '\\n')"


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_from: int = 1, near_from: int = NEAR_FROM) -> DataFrame:
    """(doc_id, n_lines, n_dropped, n_near, kept): each text without the lines of :func:`dropped_lines`, the others joined as they were.

    A row for each row. Null and empty texts have one empty line, which stays, as all blank lines do. Rows of one id are documents of their own, each of which loses its own
    lines only; rows equal in id and text keep the same. Rows without an id come after the others. An empty table gives an empty one. Other columns of ``docs`` aren't read.
    """
    gone = dropped_lines(docs, id_col, text_col, exact_from, near_from).groupBy(*_DOC).agg(F.collect_set(F.struct("line_no", "near")).alias("gone"))
    gone = gone.select(*_DOC, F.col("gone.line_no").alias("gone"), F.size(F.filter("gone", lambda x: x["near"])).cast("bigint").alias("n_near"))
    joined = keyed(docs, id_col, text_col).join(gone, _DOC, "left").withColumn("parts", F.split("text", "\n", -1))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.expr(_KEPT.format(parts="parts", gone="gone")))
    return joined.select("doc_id", F.size("parts").cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"), F.coalesce("n_near", F.lit(0)).alias("n_near"), kept.alias("kept"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_from: int = 1, near_from: int = NEAR_FROM) -> DataFrame:
    """All rows and columns of ``docs``; the texts of those that lose lines are replaced, and stay null where they were. Columns may have any names."""
    marked, key = with_keys(docs, id_col, text_col)
    gone_name, parts = free_names(marked, "gone", "parts")
    gone = dropped_lines(docs, id_col, text_col, exact_from, near_from).groupBy(*(F.col(c).alias(k) for c, k in zip(_DOC, key, strict=True))).agg(F.collect_set("line_no").alias(gone_name))
    joined = marked.join(gone, key, "left").withColumn(parts, F.split(F.col(f"`{text_col}`").cast("string"), "\n", -1))
    text = F.when(F.col(gone_name).isNull(), F.col(f"`{text_col}`")).otherwise(F.expr(_KEPT.format(parts=parts, gone=gone_name)))
    return joined.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
