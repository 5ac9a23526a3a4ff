"""Packing against its contract and the tokenizer itself."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
from tokenizers import Tokenizer

from scribe.llm import packing

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "It's  We'll 123 foo_bar <|endoftext|> x", "İstanbul ΣΑΣ ς", "á ́b  c\x1cd\x85e　f", "中文 字 \r\n tab\tz", "don't!!! 'S", "word " * 9000, "x" * 5000]


def check(spark, rows, pieces, window=packing.WINDOW):
    own = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: own.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    seen, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert set(seen) == set(ids)
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padded += window - at
    assert padded < window


def test_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    rows += [(10**9 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, part long").repartition(7)
    check(spark, rows, packing.pack(df, packing.tokenizer_path()).collect())
    check(spark, rows, packing.pack(df, packing.tokenizer_path(), window=64).collect(), 64)
    assert packing.pack(df.limit(0), packing.tokenizer_path()).count() == 0


def test_least_squares_against_enumeration():
    patterns = packing.combinations_of(np.array([2, 3, 4, 6, 8]), 8)
    assert {tuple(sorted(x for x in p if x)) for p in patterns.tolist()} == {(8,), (2, 6), (4, 4), (2, 2, 4), (2, 3, 3)} - {(8,)} | ({(8,)} if [8, 0, 0] in patterns.tolist() else set())
    hist = np.zeros(9, np.int64)
    hist[[2, 3, 4, 6]] = [30, 10, 12, 20]
    x = packing.least_squares(patterns, hist.astype(float), 2000)
    used = sum(np.bincount(patterns[:, k], weights=x, minlength=9) for k in range(3))
    best = min(((a + 2 * b + c - 30) ** 2 + (2 * c - 10) ** 2 + (b + 2 * d - 12) ** 2 + (a - 20) ** 2) for a in range(25) for b in range(12) for c in range(8) for d in range(8))
    assert ((used - hist)[[2, 3, 4, 6]] ** 2).sum() <= best + 0.05
    taken = np.zeros(9, np.int64)
    for n, parts in packing.solve(hist, 8):
        assert sum(parts) == 8 and n > 0
        for v in parts:
            taken[v] += n
    assert (taken <= hist).all() and taken.sum() > 0.8 * hist.sum()
