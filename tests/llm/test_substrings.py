"""Substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from scribe.llm import substrings

SF = "/root/testdata/sf0.001"


def brute(rows):
    least = {}
    top = 2**63
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            least[s] = min(least.get(s, top), top if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < (top if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, sizes=substrings.Sizes()):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string")
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.repeated_substrings(df.repartition(5), sizes=sizes).collect()), key=str)


def test_random_texts(spark):
    rng = random.Random(5)
    for letters in ("ab", "abcdefgh é"):
        pool = ["".join(rng.choice(letters) for _ in range(rng.choice([10, 49, 50, 51, 75, 200, 900]))) for _ in range(12)]
        rows = []
        for i in range(70):
            parts = [rng.choice(pool) for _ in range(rng.randrange(4))] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60)))]
            rng.shuffle(parts)
            text = "".join(parts)
            if text and rng.random() < 0.5:
                k = rng.randrange(len(text))
                text = text[:k] + "#" + text[k + 1 :]
            rows.append((rng.randrange(50), text))
        assert run(spark, rows) == brute(rows)
        assert run(spark, rows, substrings.Sizes(900, 130, 2000)) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    rows = [(3, "a" * 49), (1, "a" * 49), (2, "a" * 50), (1, "a" * 51), (5, None), (6, ""), (None, "a" * 50), (7, "\0" * 120), (8, "\0" * 60), (9, "ab" * 40_000), (9, "ab" * 40_000), (10, "ba" * 100)]
    assert run(spark, rows) == brute(rows)


def test_documents(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    rows = [(i, x) for i, x in zip(t["doc_id"], t["text"])]
    assert run(spark, rows, substrings.Sizes(1 << 15, 1 << 10, 1 << 15)) == brute(rows)


def sent(rows, parts):
    """Bytes that one batch's index forwards."""
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([0] * len(rows))], ["doc_id", "text", "slot"])
    index = substrings.index_rows(parts, parts, substrings.Sizes(), np.zeros(substrings.SLOTS, bool))
    return sum(len(x) for b in index(iter([batch])) for x in b.column(2).to_pylist())


def test_blobs_stay_small_in_many_parts():
    """What a record costs must not grow with the number of parts, which grows with the input."""
    rng = random.Random(3)
    rows = [(10_000 + i, "".join(rng.choice("abcdefgh ") for _ in range(3000))) for i in range(600)]
    assert sent(rows, 600) < 1.25 * sent(rows, 20)


def test_repeated_ids_are_told_apart(spark):
    own = spark.createDataFrame([(i, s) for i, s in [(1, 0), (1, 0), (2, 32768), (3, 32767), (3, 32767), (4, substrings.SLOTS - 1), (4, substrings.SLOTS - 1)]], "doc_id long, slot int")
    assert np.flatnonzero(substrings.repeated_slots(own)).tolist() == [0, 32767, substrings.SLOTS - 1]
    rows = [(2**63 - 2, "x" * 60), (None, "x" * 60), (None, "y" * 70), (7, "y" * 70), (7, "x" * 50), (-(2**63), "x" * 55)]
    assert run(spark, rows) == brute(rows)


def test_shuffle_files_go_with_their_level(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen, own = [], substrings.materialise
    try:
        substrings.materialise = lambda df, table: seen.append(spark.conf.get(name)) or own(df, table)
        run(spark, [(1, "x" * 60), (2, "x" * 60)])
    finally:
        substrings.materialise = own
    assert seen == ["true"] * 2 and spark.conf.get(name) == "false"
