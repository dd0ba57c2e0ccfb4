"""Quality rules, secret scans, decontamination and the pipeline against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
import string
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orbita.llm import decontaminate, quality, queries, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    parts = ["a", "b", "the", "word", "word", "#", "|", "é", "中", "\n", "\n", " ", " ", " ", "\t", "\xa0", "...", "- "]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 400))), "x") for i in range(200)]
    rows += [(500, None, None), (501, "", ""), (502, " \n \n", "y"), (503, "w " * 20_000, "z"), (504, "x" * 100_000, "z")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words string").repartition(4)


def test_ledger(docs):
    got = {r["doc_id"]: r for r in quality.apply_policy(quality.ledger(docs)).collect()}
    for d in docs.collect():
        text = d["text"] or ""
        w = WORD.findall(text)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        g = got[d["doc_id"]]
        want = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want, d["doc_id"]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert bool(g["failures"] & quality.BASE.any_of) == failed and not (failed and g["kept"])


def test_filter_and_ablations(docs):
    rows = quality.apply_policy(quality.ledger(docs))
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows.filter("kept").collect()}
    bits = [r["failures"] for r in rows.collect()]
    for r in quality.ablations(rows).collect():
        rest = quality.CURRENT.any_of & ~quality.BIT[r["rule"]]
        assert r["n_failed"] == sum(bool(b & quality.BIT[r["rule"]]) for b in bits)
        assert r["n_kept_without"] == sum(not b & rest for b in bits)
        assert r["n_only"] == sum(bool(b & quality.CURRENT.any_of) and not b & rest for b in bits)


PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
)


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, group, least) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets(spark):
    import base64

    r = random.Random(2)
    parts = ["token", "SECRET", "api_key", "apikey", '="', "'", ": ", " ", "=", ":", "é", "\n", "AKIA", "A1B2", "deadbeef", "0123", "x", "password", "😀", "abcdefghijkl", ".", "_", "-/"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for i in range(800)]
    rows += [(6000, None), (6001, ""), (6002, "deadbeefdeadbeef01 " * 3000), (6003, "z" * 100_000), (6004, "thesewordscomeinruns andanotheroneofthosethings")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for x in secrets.scan_secrets(df).select("doc_id", secrets.joined("base").alias("base"), secrets.joined("spans").alias("spans")).collect():
        want = base_spans(dict(rows)[x["doc_id"]])
        assert x["base"] == want and set(filter(None, want.split(","))) <= set(x["spans"].split(","))
    whole = scan_by_hand(dict(rows))
    for x in secrets.scan_secrets(df).select("doc_id", secrets.joined("spans").alias("spans")).collect():
        assert x["spans"] == whole[x["doc_id"]]
    keys = [(i, "plain words and " + base64.b64encode(r.randbytes(48)).decode() + " then more") for i in range(50)]
    words = [(100 + i, "plain wordsthatruntogetherwithoutanyspacesatall and aThingNamedLikeThisOneHereInCode") for i in range(50)]
    found = {x["doc_id"] for x in secrets.scan_secrets(spark.createDataFrame(keys + words, "doc_id bigint, text string")).filter(F.size("spans") > 0).collect()}
    assert len(found & set(range(50))) >= 45 and not found & set(range(100, 150))
    assert [x["text"] for x in secrets.redact(spark.createDataFrame([(1, 'é token="abcdefghijklmnop" b')], "doc_id bigint, text string")).collect()] == ['é [secret]" b']
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def scan_by_hand(texts):
    """All spans of each text, by the module's definition, without its code."""
    letters = string.ascii_uppercase + string.ascii_lowercase + string.digits
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    alphabets = [dig, dig + "abcdef", dig + "ABCDEF", low, up, up + "234567", dig + low, dig + up, letters, letters + "+/", letters + "-_", letters + "+/-_="]
    runs = []
    for i, text in texts.items():
        taken = [tuple(map(int, x.split(":")[1:])) for x in base_spans(text).split(",") if x]
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or ""):
            if any(m.start() < e and s < m.end() for s, e in taken):
                continue
            v, n = m[0], m.end() - m.start()
            alphabet = next(a for a in alphabets if set(v) <= set(a))
            k, codes = len(alphabet), [alphabet.index(c) for c in v]
            chi = k * sum(c * c for c in Counter(v).values()) / n - n
            zchi = (math.cbrt(chi / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
            zruns = (sum((2 * a >= k) != (2 * b >= k) for a, b in itertools.pairwise(codes)) - (n - 1) / 2) / math.sqrt((n - 1) / 4)
            mean = sum(codes) / n
            spread = sum((c - mean) ** 2 for c in codes)
            zserial = (sum((a - mean) * (b - mean) for a, b in itertools.pairwise(codes)) / spread if spread else 1) * math.sqrt(n)
            same = (sum(c * c for c in Counter(v.lower()).values()) - n) / 2
            t1 = (n * (n - 1) / 2 * 0.0667 - same) / math.sqrt(n * (n - 1) / 2 * 0.0667 * 0.9333 + n * (n - 1) * (n - 2) * (0.0056 - 0.0667**2))
            kinds = ["a" if c in low else "A" if c in up else "0" if c in dig else "." for c in v]
            t2 = (sum(a != b for a, b in itertools.pairwise(kinds)) - 0.25 * (n - 1)) / math.sqrt(0.1875 * (n - 1))
            both = [(a in "aeiou", b in "aeiou") for a, b in itertools.pairwise(v.lower()) if a in low and b in low]
            t3 = (0.55 * len(both) - sum(a != b for a, b in both)) / math.sqrt(0.2475 * len(both)) if len(both) >= 4 else 0
            z = (t1 + t2 + t3) / math.sqrt(3)
            p = 0 if z <= 0 else z * z / 2 * math.log10(math.e) if z > 30 else -math.log10(math.erfc(z / math.sqrt(2)) / 2)
            runs.append((i, m.start(), m.end(), int(math.log2(n)), min(int(p * 8), 2400), zchi <= 3.09 and abs(zruns) <= 3.29 and abs(zserial) <= 3.29))
    least = {}
    for c in {r[3] for r in runs}:
        bins = [r[4] for r in runs if r[3] == c]
        good = [b for b in set(bins) if 10 ** (-b / 8) * len(bins) <= 0.05 * sum(x >= b for x in bins)]
        if good:
            least[c] = min(good)
    out = {}
    for i, text in texts.items():
        base = [(int(s), ["assign", "access", "hex"].index(k), int(e)) for k, s, e in (x.split(":") for x in base_spans(text).split(",") if x)]
        base += [(s, 3, e) for j, s, e, c, b, random_ in runs if j == i and random_ and c in least and b >= least[c]]
        out[i] = ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{s}:{e}" for s, k, e in sorted(base))
    return out


@pytest.mark.parametrize("length, n_keys, least", [(40, 10, 9), (40, 20, 18), (32, 20, 17), (24, 20, 8)])
def test_keys_among_names(spark, length, n_keys, least):
    """Bare keys, 1 or 2 in a hundred, among names of words, in camel case, and with numbers."""
    r = random.Random(length + n_keys)
    vocabulary = "the user account service token page index value report summary total order customer list item update create delete from with north south annual company press release market".split()
    rows = []
    for i in range(1000):
        w = [r.choice(vocabulary) for _ in range(r.randint(4, 9))]
        slug = r.choice(["-".join(w), "_".join(w), "".join(x.title() for x in w), "-".join([*w, str(r.randint(1, 9999))]), "/".join(w), "".join(w)])
        rows.append((i, f"see {slug} for more"))
    rows += [(5000 + i, "see " + "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(length)) + " for more") for i in range(n_keys)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {x["doc_id"] for x in secrets.scan_secrets(df).filter(F.exists("spans", lambda x: x["kind"] == 3)).collect()}
    assert len(found & set(range(5000, 5000 + n_keys))) >= least
    assert len(found & set(range(1000))) <= 0.05 * len(found)


def test_very_long_runs(spark):
    """Work grows with the length of a run."""
    r = random.Random(4)
    rows = [(1, "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(1_000_000))), (2, "z" * 1_000_000)]
    began = time.time()
    got = {x["doc_id"]: x["spans"] for x in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert time.time() - began < 40 and len(got[1]) == 1 and not got[2]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, block_bytes):
    r = random.Random(3)
    vocabulary = ["a", "B", "ab", "é", "x1", "中"]
    some = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", "\n", "\x01", "-"]) for _ in range(n))
    items = [(i, some(r.choice([0, 1, 3, 12, 14]))) for i in range(40)] + [(77, None), (78, "..."), (12, some(11))]
    texts = [(i, some(r.randint(0, 60)) + " " + (r.choice(items)[1] or "") if i % 3 else some(30)) for i in range(150)]
    texts += [(900, None), (901, ""), (902, "zz " * 20_000)]
    windows = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {x["doc_id"]: x for x in decontaminate.scan(docs, benchmark, block_bytes=block_bytes).collect()}
    clean = set()
    for i, t in texts:
        w, hit, found = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= owners
        g = got[i]
        assert (g["n_words"], sum(x["end"] - x["start"] for x in g["ranges"]), list(g["items"])) == (len(w), len(hit), sorted(found)), i
        for x in g["ranges"]:
            assert words_of(t[x["char_start"] : x["char_end"]]) == w[x["start"] : x["end"]]
        if not hit:
            clean.add(i)
    left = decontaminate.decontaminate(docs, benchmark, block_bytes=block_bytes)
    assert {x["doc_id"] for x in left.collect()} == clean
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.scan(docs.limit(0), benchmark).count() == 0


def test_decontamination_keeps_rows_of_one_id_apart(spark):
    """One block of items or ten: a row for each row, whatever the ids."""
    r = random.Random(6)
    vocabulary = ["a", "B", "ab", "é", "x1", "zz", "q"]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i % 15, some(12)) for i in range(20)]
    rows = [(r.choice([None, 1, 2, 3]), t, "x") for t in [some(4) + " " + x[1] + " " + some(3) for x in items] + [None, "", "a", some(12), some(12)] * 2]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, scanned string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").repartition(2)
    told = []
    for block_bytes in (1 << 20, 40):
        n_blocks = len(list(decontaminate.item_blocks(benchmark, block_bytes=block_bytes)))
        assert n_blocks == 1 if block_bytes > 40 else n_blocks >= 10
        out = decontaminate.scan(docs, benchmark, block_bytes=block_bytes)
        told.append(sorted(map(repr, out.collect())))
        left = decontaminate.decontaminate(docs, benchmark, block_bytes=block_bytes)
        assert left.columns == docs.columns
        told.append(sorted(repr(tuple(x)) for x in left.collect()))
    assert told[0] == told[2] and told[1] == told[3] and len(told[0]) == len(rows)
    windows = {tuple(words_of(t)[k : k + 10]) for _, t in items for k in range(3)}
    clean = [x for x in rows if not any(tuple(w[k : k + 10]) in windows for w in [words_of(x[1])] for k in range(len(w)))]
    assert told[1] == sorted(map(repr, clean)) and 0 < len(clean) < len(rows)


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert counts[0] == counts[1] >= counts[2] >= counts[3] > 0
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == counts[3] and out.select("doc_id").distinct().count() == counts[3]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert docs.join(labels.filter("quality = 0"), "doc_id").count() == 0


def test_names():
    assert sorted(queries.QUERIES) == sorted(f for f in vars(queries) if re.match(r"op\d+_", f)) and len(queries.QUERIES) == 10
    assert set(queries.ORACLE) <= set(queries.QUERIES)
