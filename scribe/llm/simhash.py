"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code [23, 12, 7] is perfect: each
23-bit word lies within 3 bits of exactly one codeword, and its 12-bit index is a key that survives errors. Around a
word 3 bits from its codeword lie five more codewords at distance 4; together these six are the codewords of all words
within one bit of it. A word nearer its codeword has that one alone.

Of at most 3 differing bits, at most one segment can hold 2 or more (pigeonhole), so two segments differ by one bit or
none: for one of the three pairs of segments, the codeword indices of one fingerprint are among the keys of the other.
Each fingerprint is indexed under 3 keys (its own codewords) and looked up under all combinations (28 on average for
each pair); candidates of a 24-bit key are verified by counting differing bits. No link can be missed.

Equal fingerprints are collapsed first. Candidates are compared inside sorted partitions, in blocks of numpy words, and
what comes out is a spanning star for each connected set of a key, not its pairs; graph.components joins the stars.

Defined cases: null text counts as empty; no words give fingerprint zero, linked like any other; a null doc_id gets a
row and is never a component's name unless all its members are null; rows repeated get a row each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.llm.common import arrow_map, materialise, partitions, table
from scribe.llm.graph import components, least_labels

#: Bits that may differ, and the words of a shingle.
MOST_BITS, SHINGLE, SEED = 3, 3, 42
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the Golay code's generator; first bit and width of each segment.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Pairs of words compared at once.
BLOCK = 1 << 21


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles: bit set where over half the hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16).astype(np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the errors that lead to a codeword, the lightest first, and how many there are (1 or 6)."""
    table_, sizes = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    heavy = set()
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for s, e in zip(syndromes(errors).tolist(), errors.tolist()):
            if weight == 3:
                heavy.add(s)
            if weight < 4 or s in heavy:
                table_[s, sizes[s]] = e
                sizes[s] += 1
    return table_, sizes


def segment_keys(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices near each 23-bit word: (n, 6), the decoded one first, and how many count."""
    patterns, sizes = tables
    s = syndromes(words)
    return (words[:, None] ^ patterns[s]) >> 11, sizes[s]


def lookup_rows(fps: np.ndarray, tables=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, indexed) of all fingerprints: the keys it is looked up under; indexed marks its own 3."""
    tables = tables or error_patterns()
    parts = [segment_keys((fps >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1), tables) for at, width in SEGMENTS]
    keys, owners, own = [], [], []
    for pair, (a, b) in enumerate(combinations(range(3), 2)):
        (ka, na), (kb, nb) = parts[a], parts[b]
        for i in range(6):
            for j in range(6):
                held = np.flatnonzero((na > i) & (nb > j))
                keys.append(pair << 24 | ka[held, i] << 12 | kb[held, j])
                owners.append(fps[held])
                own.append(np.full(len(held), i == j == 0))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(own)


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = error_patterns()
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), 1 << 12):
            key, fp, own = lookup_rows(fps[at : at + (1 << 12)], tables)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(own)], ["key", "fp", "own"])


def near(a: np.ndarray, b: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def stars_of_runs(key: np.ndarray, fp: np.ndarray, own: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, centre) over the links found within each key's run; the arrays are sorted by key."""
    ends = np.flatnonzero(np.diff(key, append=key[-1] + 1)) + 1
    starts = np.concatenate([[0], ends[:-1]])
    indexed = np.flatnonzero(own)
    first = np.searchsorted(indexed, starts)
    many = np.searchsorted(indexed, ends) - first
    names, of = np.unique(fp, return_inverse=True)
    found_a, found_b = [], []

    def take(a: np.ndarray, b: np.ndarray) -> None:
        hit = near(fp[a], fp[b], most) & (fp[a] != fp[b])
        if hit.any():
            found_a.append(of[a[hit]])
            found_b.append(of[b[hit]])

    lengths = ends - starts
    work = np.where((lengths > 1), lengths * many, 0)
    big = work > BLOCK
    for r in np.flatnonzero(big):  # a run too large for one block: row blocks, each reduced to stars
        ys = indexed[first[r] : first[r] + many[r]]
        step = max(1, BLOCK // len(ys))
        for at in range(starts[r], ends[r], step):
            xs = np.arange(at, min(at + step, ends[r]))
            take(np.repeat(xs, len(ys)), np.tile(ys, len(xs)))
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                labels = least_labels(len(names), a, b)
                moved = np.flatnonzero(labels != np.arange(len(names)))
                found_a, found_b = [moved], [labels[moved]]
    todo = np.flatnonzero((work > 0) & ~big)
    if len(todo):
        groups = np.cumsum(work[todo]) // BLOCK
        for g in np.unique(groups):
            runs = todo[groups == g]
            rows = np.repeat(starts[runs] - np.concatenate([[0], np.cumsum(lengths[runs])[:-1]]), lengths[runs]) + np.arange(lengths[runs].sum())
            width = np.repeat(many[runs], lengths[runs])
            a = np.repeat(rows, width)
            base = np.repeat(np.repeat(first[runs], lengths[runs]), width)
            b = indexed[base + np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width)]
            take(a, b)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    labels = least_labels(len(names), np.concatenate(found_a), np.concatenate(found_b))
    moved = np.flatnonzero(labels != np.arange(len(names)))
    return names[moved].view(np.int64), names[labels[moved]].view(np.int64)


def star_rows(batches: Iterator[pa.RecordBatch], most: int = MOST_BITS) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key; an open run is carried into the next batch."""
    held = [np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, bool)]

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        u, v = stars_of_runs(*parts, most)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
        held = [np.concatenate(x) for x in zip(held, now)]
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut > 1 << 16:
            yield out([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield out(held)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def rows(ids: list, texts: list) -> dict:
        return {"doc_id": pa.array(ids, pa.int64()), "fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(own, "doc_id long, fp long", rows, "doc_id", "text")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    fps = materialise(fingerprints(docs, id_col, text_col), "simhash")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    spread = distinct.select("fp").repartition(partitions(docs.sparkSession))
    keys = spread.mapInArrow(key_rows, "key int, fp long, own boolean")
    stars = keys.repartition("key").sortWithinPartitions("key").mapInArrow(star_rows, "u long, v long")
    roots = components(stars)
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
