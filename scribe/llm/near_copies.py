"""Near copies for the pipeline: texts whose distinct five-word shingles agree by 0.8 or more (Jaccard), by exact sets.

op2's setting (3 of 64 bits over three-word shingles) stays that query's contract; this is the pipeline's own setting of the
same Golay operator. A text's set of shingle hashes is summed into BUCKETS signed buckets and turned twice by Hadamard's
matrix; the signs are 63 SimHash fingerprints of 64 bits and one more, the check. Each fingerprint is indexed under its
three own pairs of codewords (simhash.SEGMENTS); texts that meet under a key and whose checks differ by LOOSE bits or less
are loosely linked, as spanning stars. Within each loose component the sets themselves are compared: its members are parted
into the components of the exact relation. So no two texts are joined by an estimate; what can be missed is a pair that
meets under no key (README, 'Near copies').

No task holds a loose component whole. It is dealt into blocks of HASHES shingles or so, and each block is parted exactly;
the heads of the blocks' parts are dealt and parted again, as long as that at least halves them. What is still parted after
that is compared in full: all members but those of the heaviest part, in blocks, against every block of the component. So
a large group of copies costs its members once, and only what stands beside the group is compared with all of it.

Defined cases: a null text counts as empty; texts without words are equal; fewer words than a shingle make one shingle; a
null doc_id is a row like any other and sorts last; rows repeated whole stay together; an empty table gives an empty
result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.llm import simhash
from scribe.llm.common import arrow_map, materialise, partitions
from scribe.llm.graph import components

SHINGLE, SEED = 5, 42
#: Bits of all fingerprints and the check: a square's area, as Hadamard's matrix is applied by sides.
SIDE = 64
BUCKETS = SIDE * SIDE
#: Bits by which checks may differ: at a Jaccard of 0.8 they differ by 9.7 (deviation 2.9), strangers by 32 (4).
LOOSE = 19
#: Under this many shingles no different set agrees by 0.8.
LEAST = 4
#: Texts whose bits are computed at once.
TEXTS = 64
#: Shingles of a block: what one comparison holds, give or take a text.
HASHES = 1 << 18


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), found), np.uint64))


def name_of(hashes: np.ndarray) -> int:
    """A set's name: equal sets have the same."""
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def turns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hadamard's matrix of one side, and the signs before either turn."""
    side = np.ones((1, 1), np.float32)
    while len(side) < SIDE:
        side = np.block([[side, side], [side, -side]])
    signs = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (2, SIDE, SIDE))
    return side, signs[0], signs[1]


def bits_of(sets: list[np.ndarray], by=None) -> np.ndarray:
    """(sets, SIDE) words of 64 bits: the fingerprints, then the check."""
    side, first, second = by or turns()
    out = [np.zeros((0, SIDE), np.uint64)]
    for at in range(0, len(sets), TEXTS):
        part = sets[at : at + TEXTS]
        x = np.zeros((len(part), BUCKETS), np.float32)
        for i, s in enumerate(part):
            x[i] = np.bincount((s >> np.uint64(1)).astype(np.int64) & (BUCKETS - 1), weights=1.0 - 2.0 * (s & np.uint64(1)), minlength=BUCKETS)
        x = x.reshape(-1, SIDE, SIDE)
        for sign in (first, second):
            x = side @ (x * sign) @ side
        out.append(np.packbits(x.reshape(-1, BUCKETS) > 0, axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(out)


def own_keys(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(sets, 3 * (SIDE - 1)) keys: the number of fingerprint and pair of segments, and both codewords."""
    parts = [simhash.segment_keys((words[:, :-1] >> np.uint64(at)).astype(np.int64).ravel() & ((1 << width) - 1), tables)[0][:, 0] for at, width in simhash.SEGMENTS]
    shape = (len(words), SIDE - 1)
    numbers = np.arange(SIDE - 1)
    keys = [(numbers * 3 + p) << 24 | (parts[a] << 12 | parts[b]).reshape(shape) for p, (a, b) in enumerate(combinations(range(3), 2))]
    return np.concatenate(keys, axis=1).astype(np.uint32).view(np.int32)


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = simhash.error_patterns()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            checks = part.column(0).to_numpy()
            words = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(len(checks), SIDE)
            keys = own_keys(words, tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(checks, keys.shape[1])), pa.array(np.ones(keys.size, bool))], ["key", "fp", "own"])


def inverted(sets: list[np.ndarray], live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the sets numbered live, and whose each is."""
    values = np.concatenate([sets[i] for i in live])
    order = np.argsort(values, kind="stable")
    return values[order], np.repeat(live, [len(sets[i]) for i in live])[order]


def agreeing(own: np.ndarray, index: tuple[np.ndarray, np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """For each indexed set, whether it agrees with own by 0.8 or more."""
    values, owners = index
    lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
    many = hi - lo
    at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
    both = np.bincount(owners[at], minlength=len(sizes))
    return (both > 0) & (9 * both >= 4 * (sizes + len(own)))  # both / (a + b - both) >= 4 / 5


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the number of the first of its component: sets are linked where they agree by 0.8 or more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    label, left = np.arange(len(sets)), np.ones(len(sets), bool)
    index, indexed = None, 0
    for head in range(len(sets)):
        if not left[head]:
            continue
        left[head] = False
        todo = [head]
        while todo:
            i = todo.pop()
            rest = int(left.sum())
            if not rest:
                break
            if index is None or rest * 2 < indexed:
                index, indexed = inverted(sets, np.flatnonzero(left)), rest
            near = np.flatnonzero(left & agreeing(sets[i], index, sizes))
            left[near], label[near] = False, head
            todo += near.tolist()
    return label


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """The runs of rows sorted by their first columns: the values of those, and the other columns as lists."""
    at, held = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns):
            if held and row[:keys] != at:
                yield at, [list(c) for c in zip(*held)]
                held = []
            at = row[:keys]
            held.append(row[keys:])
    if held:
        yield at, [list(c) for c in zip(*held)]


def exact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads root, block, blocks, node, hashes sorted by root and block; gives HEADS: head is the first name of a node's
    component within the block, and the hashes go on where the root has other blocks."""
    for (root, _, blocks), (names, raws) in groups(batches, 3):
        kept = dict(sorted(zip(names, raws)))
        own = np.array(list(kept), np.int64)
        label = alike([np.frombuffer(raw, np.uint64) for raw in kept.values()])
        carried = pa.array(list(kept.values()) if blocks > 1 else [None] * len(own), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([root] * len(own), pa.int64()), pa.array([blocks] * len(own), pa.int64()), pa.array(own), pa.array(own[label]), carried], ["root", "blocks", "node", "head", "hashes"])


HEADS = "root long, blocks long, node long, head long, hashes binary"


def cross_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads root, block, other, asks, head, hashes sorted by the first three: gives u, v, the heads of two parts of which a
    member that asks and one that does not agree."""
    for _, (asks, heads, raws) in groups(batches, 3):
        sets = [np.frombuffer(raw, np.uint64) for raw in raws]
        of, sizes = np.array(heads, np.int64), np.array([len(s) for s in sets], np.int64)
        held = np.flatnonzero(~np.array(asks, bool))
        if not len(held) or len(held) == len(sets):
            continue
        index, links = inverted(sets, held), set()
        for i in np.flatnonzero(np.array(asks, bool)):
            links.update((heads[i], int(other)) for other in np.unique(of[agreeing(sets[i], index, sizes)]) if other != heads[i])
        u, v = zip(*links) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def blocks_of(size: Column) -> Column:
    return F.greatest(F.ceil(F.sum(size) / HASHES), F.lit(1)).cast("long").alias("blocks")


def parted(sets: DataFrame, salt: int) -> DataFrame:
    """HEADS of sets (root, blocks, node, hashes): each root's nodes dealt into its blocks."""
    dealt = sets.select("root", F.pmod(F.xxhash64("node", F.lit(salt)), "blocks").alias("block"), "blocks", "node", "hashes")
    return materialise(dealt.repartition("root", "block").sortWithinPartitions("root", "block").mapInArrow(exact_rows, HEADS), "near-heads")


def exact_heads(sets: DataFrame) -> DataFrame:
    """node, head of sets (root, blocks, node, hashes): head names the node's component of the exact relation within its root."""
    first = parted(sets, 0)
    single = first.where("blocks = 1").select("node", "head")
    wide = first.where("blocks > 1")
    size = (F.length("hashes") / 8).alias("size")
    named, now, salt = wide.select("root", "node", "head", size), wide, 0

    # Heads meet heads, in roots that this at least halves.
    while True:
        leads = F.col("node") == F.col("head")
        tally = now.where("blocks > 1").groupBy("root").agg(F.count_if(leads).alias("heads"), F.count("*").alias("nodes"), blocks_of(F.when(leads, size)))
        open_ = materialise(tally.where("heads > 1 and heads * 2 <= nodes").select("root", "blocks"), "near-open")
        if open_.isEmpty():
            break
        salt += 1
        now = parted(now.where(leads).drop("blocks").join(open_, "root"), salt)
        later = now.select(F.col("node").alias("_node"), F.col("head").alias("_head"))
        named = materialise(named.join(later, named["head"] == later._node, "left").select("root", "node", F.coalesce("_head", "head").alias("head"), "size"), "near-named")

    # What is still parted: all but the heaviest part ask every block of their root.
    parts = named.groupBy("root", "head").agg(F.sum("size").alias("size"))
    rest = (F.sum("size") - F.max("size")) / HASHES
    still = parts.groupBy("root").agg(F.max_by("head", F.struct("size", "head")).alias("main"), F.ceil(rest).cast("long").alias("others"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = wide.drop("head").join(named.select("node", "head"), "node").join(still, "root")
    told = members.select("root", F.pmod(F.xxhash64("node", F.lit(0)), "blocks").alias("block"), F.explode(F.expr("sequence(0, others - 1)")).alias("other"), F.lit(False).alias("asks"), "head", "hashes")
    ask = members.where("head <> main").select("root", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.pmod(F.xxhash64("node", F.lit(-1)), "others").alias("other"), F.lit(True).alias("asks"), "head", "hashes")
    meet = told.unionByName(ask).repartition("root", "block", "other").sortWithinPartitions("root", "block", "other")
    links = components(meet.mapInArrow(cross_rows, "u long, v long")).select(F.col("node").alias("_node"), F.col("root").alias("_head"))
    return single.unionByName(named.join(links, named["head"] == links._node, "left").select("node", F.coalesce("_head", "head").alias("head")))


def tag() -> Column:
    """With the doc_id, tells rows whose identifiers are null or repeated."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def picked(docs: DataFrame, rows: DataFrame, *extra: str) -> DataFrame:
    """The rows of docs whose doc_id and tag are among rows, with extra columns of rows."""
    own = rows.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), *extra)
    held = docs.withColumn("_of", tag())
    match = held.doc_id.eqNullSafe(own._id) & (held._of == own._tag)
    return held.join(own, match, "inner" if extra else "left_semi").select(*(held[c] for c in docs.columns), *extra)


def kept_rows(docs: DataFrame) -> DataFrame:
    """doc_id, tag of one row of each group of near copies: the one of the smallest doc_id."""
    by = turns()

    def rows(ids: list, tags: list, texts: list) -> dict:
        sets = [shingles(t) for t in texts]
        words = bits_of(sets, by)
        return {
            "doc_id": pa.array(ids, pa.int64()), "tag": pa.array(tags, pa.int64()), "node": pa.array([name_of(s) for s in sets], pa.int64()), "size": pa.array([len(s) for s in sets], pa.int64()),
            "check": pa.array(words[:, -1].copy().view(np.int64)), "bits": pa.array([w.tobytes() if len(s) >= LEAST else None for w, s in zip(words, sets)], pa.binary()),
        }

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag().alias("tag"), "text")
    marked = materialise(arrow_map(own, "doc_id long, tag long, node long, size long, check long, bits binary", rows, "doc_id", "tag", "text"), "near-bits")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "tag")).alias("first")
    nodes = materialise(marked.groupBy("node").agg(first, F.min("check").alias("check"), F.min("size").alias("size"), F.max(F.col("bits").isNotNull()).alias("wide")), "near-nodes")

    # Loose links between checks; sets that share a check are one there.
    checks = marked.where("bits is not null").groupBy("check").agg(F.first("bits").alias("bits"))
    keys = checks.repartition(partitions(docs.sparkSession)).mapInArrow(key_rows, "key int, fp long, own boolean")
    stars = keys.repartition("key").sortWithinPartitions("key").mapInArrow(partial(simhash.star_rows, most=LOOSE), "u long, v long")
    roots = components(stars).select(F.col("node").alias("check"), "root")
    shared = nodes.where("wide").groupBy("check").agg(F.count("*").alias("n")).where("n > 1").select("check")
    roots = roots.unionByName(shared.join(roots, "check", "left_anti").withColumn("root", F.col("check")))
    loose = nodes.where("wide").join(roots, "check").select("first.doc_id", "first.tag", "node", "size", "root")
    loose = loose.join(loose.groupBy("root").agg(blocks_of(F.col("size"))), "root")

    # The sets themselves, within each loose component.
    def sets_of(root: list, blocks: list, node: list, texts: list) -> dict:
        return {
            "root": pa.array(root, pa.int64()), "blocks": pa.array(blocks, pa.int64()), "node": pa.array(node, pa.int64()),
            "hashes": pa.array([shingles(t).tobytes() for t in texts], pa.binary()),
        }

    sets = arrow_map(picked(docs.select("doc_id", "text"), loose, "node", "root", "blocks"), "root long, blocks long, node long, hashes binary", sets_of, "root", "blocks", "node", "text")
    heads = exact_heads(sets)
    named = nodes.join(heads, "node", "left").select(F.coalesce("head", "node").alias("head"), "first")
    return named.groupBy("head").agg(F.min("first").alias("first")).select("first.doc_id", "first.tag")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest doc_id."""
    return picked(docs, materialise(kept_rows(docs), "near-kept"))
