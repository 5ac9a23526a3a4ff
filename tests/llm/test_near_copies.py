"""The pipeline's near copies against exact Jaccard of five-word shingles."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from scribe.llm import near_copies
from tests.llm.test_dedup import brute_fingerprint

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def brute_kept(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_edited_words_are_near_copies(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = []
    for i in range(0, 60, 2):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(120, 500))]
        other = list(words)
        for at in rng.sample(range(len(words)), len(words) // 60):
            other[at] = rng.choice(vocabulary)
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = {r.doc_id for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert got == brute_kept(rows) and len(got) <= 32
    far = sum((brute_fingerprint(rows[i][1]) ^ brute_fingerprint(rows[i + 1][1])).bit_count() > 3 for i in range(0, 60, 2))
    assert far > 15  # op2's contract would leave these


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 600")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in near_copies.stage(spark, docs, SF).collect()} == brute_kept(rows)


def test_null_identifiers(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text), (5, text + " more"), (None, "something else altogether in this one"), (None, None), (7, "a b"), (8, "a b c")]
    out = near_copies.stage(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("z")), SF)
    assert out.columns == ["doc_id", "text", "root"]
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(5, text + " more"), (0, rows[2][1]), (0, ""), (7, "a b"), (8, "a b c")])


def test_components_are_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 60, k).astype(np.uint64)])) for k in range(0, 120, 6)] + [np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64))]
    label = near_copies.alike(sets)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    want = list(range(len(sets)))
    for _ in sets:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert label.tolist() == want


def brute_labels(sets):
    want = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])):
                x, y = want[a], want[b]
                want = [min(x, y) if w in (x, y) else w for w in want]
    return want


def test_blocks_find_what_one_task_finds(spark, monkeypatch):
    """Roots dealt into many blocks: a chain whose ends share nothing, a large group beside strangers, many small groups."""
    rng = np.random.default_rng(3)

    def drawn(n):
        return rng.integers(0, 1 << 60, n).astype(np.uint64)

    line, base = drawn(400), drawn(100)
    chain = [np.unique(line[k : k + 100]) for k in range(0, 300, 9)]
    group = [np.unique(np.concatenate([base[k % 9 :], drawn(k % 9)])) for k in range(60)] + [np.unique(drawn(100)) for _ in range(5)]
    small = [np.unique(np.concatenate([own, drawn(3)])) for own in (drawn(90) for _ in range(25)) for _ in range(2)]
    monkeypatch.setattr(near_copies, "HASHES", 500)
    rows, want = [], {}
    for root, sets in enumerate((chain, group, small, chain[:2])):
        names = [root * 1000 + i for i in range(len(sets))]
        blocks = -(-sum(map(len, sets)) // 500)
        rows += [(root, blocks, n, s.tobytes()) for n, s in zip(names, sets)]
        for n, w in zip(names, brute_labels(sets)):
            want.setdefault((root, w), set()).add(n)
    frame = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in rows], "root long, blocks long, node long, hashes binary")
    got = {}
    for r in near_copies.exact_heads(frame).collect():
        got.setdefault(r["head"], set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert len(got) == 1 + 6 + 25 + 1


def test_stage_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "HASHES", 1 << 10)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 600")
    assert {r.doc_id for r in near_copies.stage(spark, docs, SF).collect()} == brute_kept([(r.doc_id, r.text) for r in docs.collect()])
