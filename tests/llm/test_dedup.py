"""Exact dedup and SimHash against brute force."""

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from scribe.llm import exact_dedup, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, digest string, kept string, fp string"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y", None) for i, t in zip(ids, texts)], SCHEMA)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    return {i: (min(g), len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for i in g}


EDGE = ["a b", "a  b", "a\tb", "a \n b", None, "", " ", "\n", "\x0b\x0c", "a b", "x" * 200_000, "x" * 200_000 + " ", "a b"]


@pytest.mark.parametrize("files", [1, 4096])
def test_exact_matches_brute_force(spark, files):
    rows = list(enumerate(EDGE * 2))
    got = exact_dedup.exact_dedup(frame(spark, [t for _, t in rows]).repartition(3), files_per_batch=files).collect()
    want = brute_exact(rows)
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got) and len(got) == len(rows)


def test_weak_digest_is_settled_by_full_bytes(spark):
    rows = list(enumerate([f"text {i % 37}" for i in range(300)]))
    got = exact_dedup.exact_dedup(frame(spark, [t for _, t in rows]), digest=lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)).collect()
    want = brute_exact(rows)
    assert len(got) == 300
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: x[:2] for i, x in want.items()}


def test_exact_edges(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    got = exact_dedup.exact_dedup(frame(spark, ["t", "t", "t", "u"], [None, 5, 5, None])).collect()
    assert sum(r.kept for r in got) == 2
    assert {r.keep_id for r in got if r.group_size == 3} == {5}
    out = exact_dedup.stage(spark, frame(spark, ["t", "t", "t", "u"], [7, 5, 5, 9]), "")
    assert sorted(r.doc_id for r in out.collect()) == [5, 9] and out.columns[0] == "doc_id"


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", t)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_simhash_matches_brute_force(spark):
    table = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    rows = list(zip(table["doc_id"], table["text"]))
    rng, top = random.Random(1), max(table["doc_id"])
    for i, (_, t) in enumerate(rows[:60]):  # edits of one to four words
        words = t.split()
        for _ in range(1 + i % 4):
            words[rng.randrange(len(words))] = "edited"
        rows.append((top + 1 + i, " ".join(words)))
    rows += [(top + 1000 + i, t) for i, t in enumerate([None, "", " \n", "One", "one", "one two", "y" * 100_000, "É é"])]
    got = simhash.near_groups(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    want = brute_groups(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len({f for f, _ in want.values()})  # links that aren't copies


def test_every_link_within_three_bits_is_found():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 4, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    key, fp, own = simhash.lookup_rows(np.unique(np.concatenate([x, y])))
    order = np.argsort(key, kind="stable")
    for block in (1 << 21, 4):
        simhash.BLOCK, was = block, simhash.BLOCK
        u, v = simhash.stars_of_runs(key[order], fp[order], own[order])
        simhash.BLOCK = was
        got = set(map(frozenset, zip(u.view(np.uint64).tolist(), v.view(np.uint64).tolist())))
        assert got == {frozenset(p) for p in zip(x.tolist(), y.tolist()) if p[0] != p[1]}


def test_simhash_edges(spark):
    assert simhash.near_groups(frame(spark, [])).count() == 0
    got = simhash.near_groups(frame(spark, ["t", "t", "", None], [None, 5, None, None])).collect()
    assert sorted(r.component_id or -1 for r in got) == [-1, -1, 5, 5]
