"""Near-duplicates, line dedup, repeats and shards against brute force."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from orbita.llm import line_dedup, lsh_forest, sharding, suffix_dedup
from orbita.llm.bytes_np import shingle_sets, utf8
from orbita.llm.shared import keyed

WHITE = "\t\n\x0b\x0c\r "


def closure(nodes, links):
    least = {n: n for n in nodes}

    def find(a):
        while least[a] != a:
            a = least[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, k):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in WHITE:
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of exact and near copies, a chain, unrelated texts, and the odd cases."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.randint(40, 200))]
        for _ in range(r.choice([1, 2, 3, 25])):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            rows.append((n, " ".join(w), "s", 1))
            n += 1
    chain = [word() for _ in range(150)]
    for k in range(12):
        rows.append((n, " ".join(chain[k * 3 : k * 3 + 110]), "s", 1))
        n += 1
    rows += [(n + k, t, None, 0) for k, t in enumerate([None, "", " \n", "one", "one", "One two", "one\xa0two", "same same same same " * 500, "same same same same " * 500])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, component bigint").repartition(5)


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, copies, k, percent):
    sets = {r["doc_id"]: shingle_set(r["text"], k) for r in copies.collect()}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (c := len(sets[a] & sets[b])) and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    want = closure(ids, links)
    got = {r["doc_id"]: r for r in lsh_forest.near_duplicates(copies, k, percent).collect()}
    assert set(got) == set(ids)
    for i in ids:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i), i
    kept = lsh_forest.keep_one(copies, k, percent)
    assert kept.columns == copies.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("k, percent, changed, n", [(3, 85, 7, 3000), (5, 80, 6, 100), (5, 80, 6, 1200)])
def test_star_families(spark, k, percent, changed, n):
    """Copies that are like one document, but not like each other."""
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = [(n // 2, " ".join(base))]
    for i in [i for i in range(n + 1) if i != n // 2]:
        w = list(base)
        for p in r.sample(range(300), changed):
            w[p] = f"v{r.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingle_set(t, k) for i, t in rows}
    hub, links = sets[n // 2], []
    for i, s in sets.items():
        c = len(s & hub)
        if i != n // 2 and 100 * c >= percent * (len(s) + len(hub) - c):
            links.append((i, n // 2))
    alone = sorted(set(sets) - {i for p in links for i in p})
    for i in alone:
        links += [(i, j) for j, s in sets.items() if j != i and 100 * len(s & sets[i]) >= percent * len(s | sets[i])]
    want = closure(sorted(sets), links)
    got = {x["doc_id"]: x["component_id"] for x in lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k, percent).collect()}
    assert len(links) > n // 2 and got == want


def test_no_texts(spark, copies):
    assert lsh_forest.near_duplicates(copies.limit(0)).count() == 0
    assert line_dedup.dedup_lines(copies.limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(copies.limit(0)).count() == 0
    assert sharding.shard_by_bytes(copies.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    links = [(a, r.randrange(300)) for a in range(300) if r.random() < 0.8] + [(k, k + 1) for k in range(400, 460)]
    rows = [(a // 2, a % 2, b // 2, b % 2) for a, b in links]
    got = {2 * x["rid"] + x["th"]: 2 * x["component"] + x["component2"] for x in lsh_forest.components(spark.createDataFrame(rows, "a bigint, a2 bigint, b bigint, b2 bigint")).collect()}
    want = closure({x for p in links for x in p}, links)
    assert all(got.get(n, n) == c for n, c in want.items())


def test_shingle_sets_count_words_as_documented():
    import pyarrow as pa

    texts = ["a b c d", "", "x", "A  b\tc\x0bd", "é b c d"]
    for text, s in zip(texts, shingle_sets(*utf8(pa.array(texts)), 3), strict=True):
        assert len(s) == len(shingle_set(text, 3))


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    p = 0
    while p < len(b) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + (len(a) == len(b)) :]


def lines_left(rows, exact_from=1, near_from=32):
    """(doc_id, n_lines, n_dropped, n_near, kept) of each row, and how many first lines were near an earlier one. Rows in order of time."""
    lines = [(r, k, s) for r, (_, t) in enumerate(rows) for k, raw in enumerate((t or "").split("\n")) if len(s := raw.strip(WHITE)) >= exact_from]
    first = {}
    for r, k, s in lines:
        first.setdefault(s, (r, k))
    long = {s: at for s, at in first.items() if len(s) >= near_from}
    near = {s for s, at in long.items() if any(there < at and within_one(s, other) for other, there in long.items())}
    gone = {(r, k) for r, k, s in lines if s in near or first[s] != (r, k)}
    out = []
    for r, (i, t) in enumerate(rows):
        parts = (t or "").split("\n")
        keep = [p for k, p in enumerate(parts) if (r, k) not in gone]
        out.append((i, len(parts), len(parts) - len(keep), sum(first[s][0] == r for s in near), "\n".join(keep)))
    return out, len(near)


@pytest.mark.parametrize("exact_from, near_from, short", [(1, 32, 28), (32, 32, 28), (1, 1, 1), (5, 20, 10)])
def test_line_dedup(spark, exact_from, near_from, short):
    r = random.Random(5)
    base = ["".join(r.choice("abcé ") for _ in range(r.randint(short, 90))) for _ in range(30)] + ["".join(r.choice("abcé ") for _ in range(n)) for n in (300, 801, 2000)]

    def edit(s):
        p, kind = r.randrange(len(s)), r.randrange(4)
        return s if kind == 0 else s[:p] + r.choice("xyzé") + s[p + (kind > 1) :] if kind < 3 else s[:p] + s[p + 1 :]

    rows = [(i, "\n".join(edit(r.choice(base)) if r.random() < 0.8 else edit(edit(r.choice(base)) + "x") for _ in range(r.randint(0, 6)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "x" * 5000), (904, "x" * 4999), (905, "x" * 2000 + "y" + "x" * 2999), (906, "x" * 2000 + "y" + "x" * 2998), (907, "xy" * 300), (908, "xy" * 299 + "x"), (909, "yx" * 300), (910, "\n".join(["y" * 40] * 300))]
    want, n_near = lines_left(rows, exact_from, near_from)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), exact_from=exact_from, near_from=near_from).collect()
    assert sorted(map(tuple, got)) == want and n_near > 20


def test_line_dedup_of_rows_that_share_ids(spark):
    """Rows of one id are documents of their own, in order of a hash of their texts; those without an id come last."""
    r = random.Random(6)
    base = ["".join(r.choice("abcd ") for _ in range(40)) for _ in range(8)]
    rows = [(r.choice([0, 1, 1, 1, 2, None, None]), "\n".join(r.choice(base) + r.choice(["", "", "x"]) for _ in range(3)) + f"\n{k}") for k in range(40)]
    rows += [(0, "L" * 40), (1, "L" * 40 + "\nab"), (1, "U" * 40 + "\nzz"), (None, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    order = sorted(keyed(df).collect(), key=lambda x: (x["rid"], x["th"]))
    want, _ = lines_left([(x["doc_id"], x["text"]) for x in order])
    assert sorted(map(repr, map(tuple, line_dedup.dedup_lines(df).collect()))) == sorted(map(repr, want))
    twice = df.unionByName(df)  # rows equal in id and text count as one
    assert sorted(map(repr, map(tuple, line_dedup.dedup_lines(twice).collect()))) == sorted(map(repr, want + want))


@pytest.mark.parametrize("letters", ["abcdefgh ", "=", "ab"])
def test_line_dedup_of_very_long_lines(spark, letters):
    """Lines of 300,000 characters, one edit apart; the time is that of the jobs."""
    r = random.Random(1)
    line = "[" + "".join(r.choice(letters) for _ in range(300_000)) + "]"
    rows = [(1, line), (2, line[:200_000] + "X" + line[200_001:]), (3, line[:10] + line[11:]), (4, line[:10] + "YY" + line[12:])]
    began = time.time()
    got = {x["doc_id"]: (x["n_dropped"], x["n_near"]) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (0, 0)} and time.time() - began < 60


def test_line_dedup_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "z" * 50, "p", None), (2, "z" * 50, None, "w"), (3, None, "g", "g")], "doc_id bigint, text string, gone string, rid string")
    got = line_dedup.without_repeated_lines(df)
    assert got.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "z" * 50, 2: "", 3: None}


def repeats(docs, length):
    count = Counter(b[p : p + length] for b in docs.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in docs.items():
        gone = np.zeros(len(b) + length, bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        gone = gone[: len(b)]
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


def test_suffix_order():
    r = random.Random(3)
    for _ in range(100):
        n, alphabet, length = r.randint(30, 300), r.choice([b"a", b"ab", b"abc", bytes(range(256))]), r.choice([3, 8, 20])
        text = bytes(r.choice(alphabet) for _ in range(n))
        wanted = np.array(sorted(r.sample(range(n - length + 1), r.randint(1, n - length + 1))))
        order = suffix_dedup.two_stage_order(np.frombuffer(text, np.uint8), wanted, length)
        assert sorted(order) == wanted.tolist()
        keys = [text[i : i + length] for i in order]
        assert keys == sorted(keys)


@pytest.mark.parametrize("most", [4096, 3])
def test_remove_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SORTED", most)
    r = random.Random(3)
    rnd = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passages = [rnd(r.randint(60, 150)) for _ in range(6)]
    rows = [(i, "".join(r.choice([r.choice(passages)[r.randint(0, 5) :], rnd(r.randint(1, 60)), "a" * r.randint(1, 130)]) for _ in range(r.randint(0, 8)))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, "abc" * 100), (1003, "é" * 300), (1004, rnd(20_000))]
    want = repeats({i: (t or "").encode() for i, t in rows}, 64)
    got = {x[0]: tuple(x)[1:] for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), 64, with_text=False).collect()}
    assert {i: x[:4] for i, x in got.items()} == want


def test_remove_repeats_of_rows_that_share_ids(spark):
    """Ids are null or come again: each row is a text of its own."""
    r = random.Random(8)
    rnd = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passages = [rnd(90) for _ in range(5)]
    rows = [(r.choice([None, 1, 1, 2]), rnd(30) + r.choice(passages) + rnd(40)) for _ in range(40)] + [(1, rnd(200)), (2, "é" * 100), (None, ""), (1, None)]
    rows += [rows[0], rows[0], rows[40], (7, rows[41][1])]
    want = repeats({k: (t or "").encode() for k, (_, t) in enumerate(rows)}, 64)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 64, with_text=False).collect()
    assert sorted((str(x["doc_id"]), *tuple(x)[1:5]) for x in got) == sorted((str(i), *want[k]) for k, (i, _) in enumerate(rows))
    assert all(x["changed"] == (x["n_removed"] > 0) for x in got)


def test_differencing_beats_no_order():
    r = random.Random(1)
    sizes = [r.randint(1, 10_000) for _ in range(500)]
    total, went = sharding.difference([sharding._leaf(s, 16) for s in sizes], 16)
    sums = [0] * 16
    for s, w in zip(sizes, went, strict=True):
        sums[w[0]] += s
    assert tuple(sums) == total and max(sums) - min(sums) <= 5


def test_shards(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["", None, "same", "é" * 5, "x" * r.randint(0, 400)])) for i in range(1500)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string"), 16).collect()
    text = dict(rows)
    assert sorted(x["doc_id"] for x in got) == sorted(text)
    where, sums, slots = {}, Counter(), {}
    for x in got:
        t = (text[x["doc_id"]] or "").encode()
        assert x["size"] == len(t) + 1 and x["text_crc32"] == zlib.crc32(t)
        assert where.setdefault(t, x["shard"]) == x["shard"]
        sums[x["shard"]] += x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard_by_bytes(spark.createDataFrame(rows[::-1], "doc_id bigint, text string").repartition(7), 16).collect()
    assert {x["doc_id"]: x["shard"] for x in again} == {x["doc_id"]: x["shard"] for x in got}  # ties and order of rows don't matter
    many = sharding.shard_by_bytes(spark.createDataFrame([(i % 3 if i % 2 else None, f"{i:0{1 + i % 90}d}") for i in range(4000)], "doc_id bigint, text string"), 16, buckets=20).collect()
    by = Counter()
    for x in many:
        by[x["shard"]] += x["size"]
    assert len(many) == 4000 and len(by) == 16 and max(by.values()) - min(by.values()) <= 20
    groups = Counter()
    for t in text.values():
        groups[t or ""] += len((t or "").encode()) + 1
    assert max(sums.values()) <= max(max(groups.values()), sum(groups.values()) / 16 + 50)
