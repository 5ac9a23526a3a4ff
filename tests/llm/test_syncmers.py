"""Closed syncmers against brute force."""

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from scribe.llm import syncmers
from scribe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1
LEAST = -(1 << 63)
BLANKS = " \t\n\x0b\x0c\r"
BREAKS = set("048aeiAEI!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
UNSPACED = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]


def signed(x):
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def long_hash(value, seed):
    return xxhash.xxh64_intdigest((value & MASK).to_bytes(8, "little"), seed)


def chained(values):
    seed = 42
    for v in values:
        seed = long_hash(v, seed)
    return signed(seed)


def brute_words(text):
    alone = lambda c: any(a <= ord(c) <= b for a, b in UNSPACED)
    solid = lambda cs: len(cs) == 16 and all(" " < c < "\ud800" or "\udfff" < c < "\U00010000" for c in cs)
    out = []
    for run in re.split("[" + BLANKS + "]+", text):
        at = 0
        for i in range(1, len(run) + 1):
            broken = run[i - 1] in BREAKS and solid(run[max(0, i - 16) : i]) and solid(run[i : i + 16])
            if i == len(run) or alone(run[i - 1]) or alone(run[i]) or broken:
                out.append(run[at:i])
                at = i
    return [w for w in out if w]


def brute_anchors(text):
    w = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in brute_words(text)]
    low = (1 << syncmers.POSITION_BITS) - 1
    if len(w) < syncmers.LARGE:
        return [signed(chained(w) & ~low)] if w else []
    s = [signed(a ^ ((b << 1 | (b & MASK) >> 63) & MASK)) for a, b in zip(w, w[1:])]
    inner = syncmers.LARGE - syncmers.SMALL
    picked = {}
    for i in range(len(s) - inner):
        own = s[i : i + inner + 1]
        if min(own) in (own[0], own[-1]):
            h = signed(chained([own[0], own[2], own[-1]]) & ~low)
            picked.setdefault(h, i)
    return [h | p for h, p in sorted(picked.items())][: syncmers.SKETCH]


def brute(rows):
    """(doc_id, n_chars, edited hash, three fingerprints) of each row, sorted."""
    tag = lambda t: signed(xxhash.xxh64_intdigest((t or "").encode(), 42))
    order = sorted(rows, key=lambda r: (LEAST if r[0] is None else r[0], tag(r[1])), reverse=True)
    known = {t: brute_anchors(t or "") for _, t in rows}
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        out.append((i is None, i or 0, len(t), hashlib.sha256(edited.encode()).hexdigest(), known.get(t, []), brute_anchors(edited), known.get(after, [])))
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, key int, tag string")
    got = syncmers.fingerprints(df.repartition(3)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.anchors, r.edited_anchors, r.next_anchors) for r in got) == brute(rows)


@pytest.fixture
def small_ranges():
    was, syncmers.RANGE_ROWS = syncmers.RANGE_ROWS, 40
    yield
    syncmers.RANGE_ROWS = was


def documents():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"]))


def test_documents(spark):
    check(spark, documents())


def test_identifiers_at_both_ends_of_long(spark, small_ranges):
    rows = [(i * 1000 + (10**12 if i % 9 == 0 else 0), x) for i, x in documents()]
    ends = [(LEAST, "the least"), ((1 << 63) - 1, "the largest one"), (-9 * 10**18, "far down"), (9 * 10**18, "far up"), (None, "no id"), (None, "no id either")]
    check(spark, rows + ends)


def test_rows_alike_fill_several_ranges(spark, small_ranges):
    check(spark, [(5, f"one of the rows {i}") for i in range(70)] + [(7, "all alike in everything here")] * 300 + [(None, None)] * 150 + [(9, "the last of all")])


def test_an_outlier_does_not_crowd_ranges(spark):
    df = spark.range(30_000).union(spark.range(1 << 62, (1 << 62) + 1)).select(F.col("id").alias("key"), F.lit(0).cast("long").alias("tag"))
    ranges = syncmers.Ranges(df)
    seats = df.withColumn("number", ranges.number()).withColumn("seat", ranges.seat()).groupBy("seat").count().collect()
    assert len(seats) >= 20 and max(r["count"] for r in seats) <= syncmers.RANGE_ROWS


def test_edges(spark):
    odd = [None, "", " ", "one", "one two three four", "a b c d e", "a " * 500, "x" * 5000, "é" * 100 + " b c d e f", "🙂 " * 40, "same same same same same same", "汉字かな交じり文 and ภาษาไทย", "𠀋𠀋a𠀋" * 9, "f00" * 40 + "/" + "Zq" * 30, "a" * 31 + " " + "a" * 32 + "\t" + "e" * 33]
    check(spark, list(enumerate(odd)))
    check(spark, [(5, "only one document of several words here")])
    assert syncmers.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def anchors_of(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [{x >> syncmers.POSITION_BITS for x in r.f} for r in syncmers.with_fingerprint(df, "t", "f", sketch=None).orderBy("i").collect()]


def test_edits_leave_other_anchors_alone(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 24))) for _ in range(60)]
    unspaced = "".join(chr(rng.randint(0x4E00, 0x6000)) for _ in range(4000))
    minified = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789=;(){}") for _ in range(4000))
    plain, run, han, moved, mini, shifted = anchors_of(spark, " ".join(words), " ".join([*words, "q" * 65]), unspaced, "汉" + unspaced, minified, "z" + minified)
    assert len(plain - run) == 0
    assert len(han & moved) >= 0.99 * len(han) > 1000
    assert len(mini & shifted) >= 0.97 * len(mini) > 100


def test_places_are_not_capped(spark):
    n = (1 << 20) + 5000
    text = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(text,)], "t string")
    places = [x & ((1 << syncmers.POSITION_BITS) - 1) for x in syncmers.with_fingerprint(df, "t", "f", sketch=None).first().f]
    assert len(set(places)) == len(places) and max(places) > n - 50


def test_likeness(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(3000)]
    a, b = " ".join(words[:1000]), " ".join(words[:800] + words[2000:2200])
    df = spark.createDataFrame([(0, a, b), (1, a, a), (2, a, " ".join(words[1500:2500])), (3, "", ""), (4, a, "")], "id int, a string, b string")
    out = syncmers.with_fingerprint(syncmers.with_fingerprint(df, "a", "x"), "b", "y").withColumn("near", syncmers.likeness(F.col("x"), F.col("y")))
    near = {r.id: r.near for r in out.collect()}
    assert 0.45 < near[0] < 0.9 and near[1] == 1.0 and near[2] < 0.1 and near[3] == 1.0 and near[4] == 0.0
    kept = syncmers.with_aligned(out, "x", "y", "placed").collect()
    assert {r.id: r.placed for r in kept}[1] == 1.0 and all(0 <= r.placed <= 1 for r in kept)


def test_query(spark):
    df = QUERIES["op6_closed_syncmers"](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    rows = df.collect()
    assert len(rows) == 200 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert sum(r.near_edited for r in rows) > 5 * sum(r.near_next for r in rows)
