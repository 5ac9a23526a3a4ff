"""Suffix-array dedup by bucket-pointer refinement: bytes that a 50-byte string of an earlier document covers go.

The refinement never sorts all suffixes to the end. A position's bucket is its q-gram (24 bytes); identifiers of longer
strings come from those of shorter ones at later offsets (8 bytes, then 16 from two of 8, 24, 50, 76), and are reused as
each level refines the one before. Buckets with one document are finished at once and take no further part:

1. Of each 50-byte window, the place of the least q-gram identifier represents all that is in it (equal windows choose
   alike), so about one position in 14 enters the first buckets. A batch of documents forwards, for a bucket and the 76
   bytes around it, the smallest document alone; the others there are settled: that document covers them.
2. Buckets are sorted by q-gram identifier and refined by the identifier of the 76 bytes around. Positions whose 76 bytes
   stand in a smaller document are covered with all of them. A q-gram whose surroundings all agree, or that one document
   holds, is finished.
3. What is still open (a q-gram with differing surroundings: edges of copied passages, edits) is refined by the
   identifiers of the 50-byte windows which that q-gram represents. A window that stands in a smaller document is covered.

Equality is by 128 bits at level 2 (two independent identifiers) and 96 at level 3. Records travel as compressed blobs by
bucket range, texts as compressed blobs by document, so that a shuffle moves few rows and bytes. Hot passages are settled
within batches, so that no key gathers more than one document from each.

Blobs grow in number with the square of the input, so what each repeats is small: the documents of a batch are in order of
their ids, which travel as differences; a document is told by its id alone, and by its text's hash beside it only where that
id may stand on several rows (repeated_slots()); documents of neighbouring ids share a part. A level's shuffle files go as soon
as the level is written (dropped_shuffles()), or they would stay on disk until the driver happens to collect its garbage.

Defined cases: null text is empty; texts under 50 bytes lose nothing; documents of equal doc_id do not cover each other; a
null doc_id counts as larger than all others; very long texts are read whole; rows repeated get a row each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.llm.common import dropped_shuffles, materialise, partitions, table

LENGTH, GRAM = 50, 24
#: q-grams of a window, and bytes around a q-gram that windows with it can reach.
STEPS = LENGTH - GRAM + 1
REACH = LENGTH - GRAM
GAP = 64
#: Slots of the filter of ids that stand on several rows, and how many neighbouring ids share a part (as a power of 2).
SLOTS, NEIGHBOURS = 1 << 20, 5
NO_ID = np.iinfo(np.int64).max
ROWS = "part int, kind int, data binary"
COVER, REQUEST, TEXT, KEYS = 0, 1, 2, 3
M1, M2, M3, M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


class Sizes(NamedTuple):
    """Bytes of text that a batch takes, that are indexed at once, and that a part should hold."""

    batch: int = 6 << 20
    block: int = 1 << 20
    part: int = 6 << 20


def joined(a: np.ndarray, b: np.ndarray, m: np.uint64 = M1, n: np.uint64 = M2) -> np.ndarray:
    """Identifiers of two strings to that of both in a row."""
    x = (a ^ (a >> np.uint64(29))) * m
    x += b
    x ^= x >> np.uint64(32)
    x *= n
    x ^= x >> np.uint64(29)
    return x


def spread(x: np.ndarray) -> np.ndarray:
    """Identifiers one to one, evenly over their range: the least of each window crowd at its low end."""
    x = (x ^ (x >> np.uint64(33))) * M4
    return x ^ (x >> np.uint64(29))


def slid(x: np.ndarray, best, width: int) -> np.ndarray:
    """best over x[i : i + width] for each i, by doubling; the tail repeats shorter windows."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = best(out[: len(out) - step], out[step:])
        have += step
    return out


class Block:
    """Texts laid side by side with gaps of zero bytes, and identifiers of their strings."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = GAP + np.concatenate([[0], np.cumsum(sizes + GAP)[:-1]]).astype(np.int64)
        self.ends = self.starts + sizes
        gap = bytes(GAP)
        raw = gap + b"".join(x for t in texts for x in (t, gap)) + gap
        self.g8 = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).astype(np.uint64)
        n = len(self.g8) - 16
        g16 = joined(self.g8[: n + 8], self.g8[8 : n + 16])
        self.g24 = joined(g16[:n], self.g8[16 : n + 16], M3, M4) | np.uint64(1)
        long = sizes >= LENGTH
        marks = np.zeros(n + 1, np.int8)
        np.add.at(marks, self.starts[long], 1)
        np.add.at(marks, self.ends[long] - LENGTH + 1, -1)
        self.window = np.cumsum(marks[:n], dtype=np.int8).astype(bool)  # where a window starts

    def least(self) -> np.ndarray:
        """The least q-gram identifier of the window at each place; 0 where none starts."""
        return np.where(self.window, slid(self.g24, np.minimum, STEPS), np.uint64(0))

    def anchors(self) -> np.ndarray:
        top = slid(self.least(), np.maximum, STEPS)
        return np.flatnonzero(self.g24[REACH:] == top[: len(top) - REACH]) + REACH

    def owners(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def around(self, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Identifiers of the bytes that windows with the q-gram can reach, ends of the text included."""
        left = np.minimum(REACH, at - self.starts[of])
        right = np.minimum(REACH, self.ends[of] - at - GRAM)
        x = (left << 8 | right).astype(np.uint64) * M3
        for k in (*range(-REACH, REACH + GRAM - 8, 8), REACH + GRAM - 8):
            x = joined(x, self.g8[at + k], M4, M1)
        # A gap is zeros; what a gap of GAP bytes leaves of a neighbour is beyond REACH.
        return x

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two identifiers of the 50-byte windows at places."""
        x = y = np.full(len(at), M2)
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            x, y = joined(x, self.g8[at + k], M1, M3), joined(y, self.g8[at + k], M4, M2)
        return x, (y >> np.uint64(32)).astype(np.uint32)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, bytes of equal weight together."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        parts += [struct.pack("<4sI", a.dtype.str.encode(), len(a)), planes]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<4sI", raw, at)
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        at += 8
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype) if size else np.zeros(0, dtype))
        at += size * dtype.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def text_key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def apart(ids: np.ndarray) -> np.ndarray:
    """Ids as differences, which are small where the ids are in order; together() undoes it."""
    return np.diff(ids, prepend=np.int64(0))


def together(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.int64)


def doc_part(ids: np.ndarray, parts: int) -> np.ndarray:
    x = joined((ids.astype(np.int64) >> NEIGHBOURS).view(np.uint64), np.full(len(ids), M3))
    return (x >> np.uint64(33)).astype(np.int64) % parts


def row(part: int, kind: int, data: bytes) -> tuple[int, int, bytes]:
    return part, kind, data


def as_batches(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size > 4 << 20 or len(held) > 4096:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list) -> pa.RecordBatch:
    part, kind, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "data"])


def batches_of_texts(batches: Iterator[pa.RecordBatch], most: int, again: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Ids in order, keys (0 where the slot says that the id stands on one row alone) and texts."""
    rows, size = [], 0
    for batch in batches:
        for i, t, slot in zip(*(batch.column(k).to_pylist() for k in range(3))):
            data = (t or "").encode("utf-8", "surrogatepass")
            rows.append((i, text_key(data) if again[slot] else 0, data))
            size += len(data)
            if size > most:
                yield _in_order(rows)
                rows, size = [], 0
    if rows:
        yield _in_order(rows)


def _in_order(rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids, keys, texts = zip(*sorted(rows, key=lambda r: r[:2]))
    return np.array(ids, np.int64), np.array(keys, np.int64), list(texts)


class Segment(NamedTuple):
    doc: int
    data: bytes
    base: int  # of data in its text
    low: int  # places of the text that this segment answers for
    high: int


def blocks(texts: list[bytes], most: int) -> Iterator[tuple[list[Segment], Block]]:
    """The texts in blocks of about most bytes; longer ones in segments with GAP bytes of context on both sides."""
    held: list[Segment] = []
    size = 0
    for k, t in enumerate(texts):
        for low in range(0, max(1, len(t)), most):
            high = min(len(t), low + most)
            base = max(0, low - GAP)
            data = t[base : high + GAP]
            held.append(Segment(k, data, base, low, high))
            size += len(data)
            if size > most:
                yield held, Block([x.data for x in held])
                held, size = [], 0
    if held:
        yield held, Block([x.data for x in held])


def in_texts(segments: list[Segment], block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Those of some places of a block that its segments answer for: place, segment, document, place in the text."""
    of = block.owners(at)
    base, low, high, doc = (np.array([getattr(x, f) for x in segments], np.int64) for f in ("base", "low", "high", "doc"))
    place = at - block.starts[of] + base[of]
    mine = (place >= low[of]) & (place < high[of])
    return at[mine], of[mine], doc[of[mine]], place[mine]


def per_doc(kind: int, parts: int, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows by document part: doc (index into ids, keys) and place of each record."""
    if not len(doc):
        return
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    part = doc_part(ids, parts)[doc]
    for p in np.unique(part):
        mine = part == p
        used, local = np.unique(doc[mine], return_inverse=True)
        yield row(int(p), kind, packed(apart(ids[used]), keys[used], narrow(local), narrow(place[mine])))


def key_blobs(kind: int, parts: int, ids: np.ndarray, keys: np.ndarray, main: np.ndarray, second: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows by range of main identifier; the records are sorted by main."""
    if not len(main):
        return
    part = ((main >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
    edges = np.searchsorted(part, np.arange(parts + 1)) if parts < 4 * len(part) else None
    cuts = zip(range(parts), edges[:-1], edges[1:]) if edges is not None else ((int(part[a]), a, b) for a, b in zip(*_runs(part)))
    for p, a, b in cuts:
        if a < b:
            used, local = np.unique(doc[a:b], return_inverse=True)
            gaps = np.diff(main[a:b], prepend=np.uint64(0))
            yield row(int(p), kind, packed(apart(ids[used]), keys[used], gaps, second[a:b], narrow(local), narrow(place[a:b])))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.flatnonzero(np.diff(x) != 0) + 1
    return np.concatenate([[0], ends]).astype(np.int64), np.concatenate([ends, [len(x)]]).astype(np.int64)


def leaders(main: np.ndarray, second: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For records sorted by main: their order by (main, second, id), where groups start there, and their smallest ids."""
    order = np.arange(len(main))
    same = np.zeros(len(main) + 1, bool)
    same[1:-1] = main[1:] == main[:-1]
    tied = np.flatnonzero(same[1:] | same[:-1])
    order[tied] = tied[np.lexsort((ids[tied], second[tied], main[tied]))]
    m, s = main[order], second[order]
    new = np.ones(len(main), bool)
    new[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    return order, group, ids[order][np.flatnonzero(new)]


def settle(ids, keys, main, second, doc, place, kind: int, parts: int, doc_parts: int):
    """Within a batch: only the smallest document of (main, second) goes on; the others are covered."""
    by = np.argsort(main, kind="stable")
    main, second, doc, place = main[by], second[by], doc[by], place[by]
    order, group, least = leaders(main, second, ids[doc])
    main, second, doc, place = main[order], second[order], doc[order], place[order]
    first = ids[doc] == least[group]
    yield from per_doc(COVER, doc_parts, ids, keys, doc[~first], place[~first])
    yield from key_blobs(kind, parts, ids, keys, main[first], second[first], doc[first], place[first])


def index_rows(parts: int, doc_parts: int, sizes: Sizes, again: np.ndarray):
    """Level 1: rows of the first buckets, and what batches settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for ids, keys, texts in batches_of_texts(batches, sizes.batch, again):
                found: list[list[np.ndarray]] = [[], [], [], []]
                for segments, block in blocks(texts, sizes.block):
                    at, of, doc, place = in_texts(segments, block, block.anchors())
                    for held, x in zip(found, (spread(block.g24[at]), block.around(at, of), doc, place)):
                        held.append(x)
                main, second, doc, place = (np.concatenate(x) for x in found)
                yield from settle(ids, keys, main, second, doc, place, KEYS, parts, doc_parts)

        return as_batches(rows())

    return run


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """Rows sorted by part: (part, its (kind, data) rows)."""
    from itertools import groupby

    rows = ((p, k, d) for b in batches for p, k, d in zip(*(b.column(i).to_pylist() for i in range(3))))
    for part, own in groupby(rows, key=lambda r: r[0]):
        yield part, ((k, d) for _, k, d in own)


def opened(blobs: list[bytes]):
    """The records of key blobs: ids, keys (by document, in order) and main, second, doc, place."""
    parts = [unpacked(b) for b in blobs]
    shift = np.cumsum([0, *(len(p[0]) for p in parts)])
    ids, keys = np.concatenate([together(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
    in_order = np.lexsort((keys, ids))
    rank = np.empty(len(ids), np.int64)
    rank[in_order] = np.arange(len(ids))
    ids, keys = ids[in_order], keys[in_order]
    main = np.concatenate([np.cumsum(p[2], dtype=np.uint64) for p in parts])
    second = np.concatenate([p[3] for p in parts])
    doc = rank[np.concatenate([p[4].astype(np.int64) + s for p, s in zip(parts, shift)])]
    place = np.concatenate([p[5].astype(np.int64) for p in parts])
    by = np.argsort(main, kind="stable")
    return ids, keys, main[by], second[by], doc[by], place[by]


def refine_rows(doc_parts: int, windows: bool):
    """Level 2 (or 3, of windows): covered records, and at level 2 what is still open; settled rows pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part, own in grouped(batches):
                blobs = []
                for kind, data in own:
                    if kind == KEYS:
                        blobs.append(data)
                    else:
                        yield row(part, kind, data)
                if not blobs:
                    continue
                ids, keys, main, second, doc, place = opened(blobs)
                # Buckets with one record are finished.
                same = np.zeros(len(main) + 1, bool)
                same[1:-1] = main[1:] == main[:-1]
                live = same[1:] | same[:-1]
                main, second, doc, place = main[live], second[live], doc[live], place[live]
                if not len(main):
                    continue
                order, group, least = leaders(main, second, ids[doc])
                main, second, doc, place = main[order], second[order], doc[order], place[order]
                own_ids = ids[doc]
                covered = own_ids > least[group]
                yield from per_doc(COVER, doc_parts, ids, keys, doc[covered], place[covered])
                if windows:
                    continue
                main, doc, place, own_ids = main[~covered], doc[~covered], place[~covered], own_ids[~covered]
                if len(main):
                    start, end = _runs(main)
                    low, high = np.minimum.reduceat(own_ids, start), np.maximum.reduceat(own_ids, start)
                    still = np.repeat(low < high, end - start)
                    yield from per_doc(REQUEST, doc_parts, ids, keys, doc[still], place[still])

        return as_batches(rows())

    return run


def text_rows(doc_parts: int, sizes: Sizes, again: np.ndarray):
    """Texts by document part: ids, keys and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for ids, keys, texts in batches_of_texts(batches, sizes.batch, again):
                part = doc_part(ids, doc_parts)
                for p in np.unique(part):
                    mine = np.flatnonzero(part == p)
                    lengths = np.array([len(texts[i]) for i in mine], np.int64)
                    yield row(int(p), TEXT, packed(apart(ids[mine]), keys[mine], lengths, np.frombuffer(b"".join(texts[i] for i in mine), np.uint8)))

        return as_batches(rows())

    return run


def sorted_out(own: Iterator[tuple[int, bytes]]):
    """A part's texts (id, key, bytes) and its places by (id, key), by kind."""
    texts, places = [], {COVER: {}, REQUEST: {}}
    for kind, data in own:
        if kind == TEXT:
            ids, keys, sizes, raw = unpacked(data)
            raw, at = raw.tobytes(), 0
            for i, k, n in zip(together(ids).tolist(), keys.tolist(), sizes.tolist()):
                texts.append((i, k, raw[at : at + n]))
                at += n
        else:
            ids, keys, doc, place = unpacked(data)
            ids = together(ids)
            starts, ends = _runs(doc) if len(doc) else ([], [])
            for a, b in zip(starts, ends):
                d = int(doc[a])
                places[kind].setdefault((int(ids[d]), int(keys[d])), []).append(place[a:b].astype(np.int64))
    return texts, places


def window_rows(parts: int, doc_parts: int, sizes: Sizes):
    """Level 3: identifiers of the windows that open q-grams represent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for _, own in grouped(batches):
                texts, places = sorted_out(own)
                wanted = [t for t in {(i, k): (i, k, x) for i, k, x in texts}.values() if t[:2] in places[REQUEST]]
                if not wanted:
                    continue
                ids, keys = np.array([t[0] for t in wanted], np.int64), np.array([t[1] for t in wanted], np.int64)
                found: list[list[np.ndarray]] = [[], [], [], []]
                asked = [np.sort(np.concatenate(places[REQUEST][t[:2]])) for t in wanted]
                for segments, block in blocks([t[2] for t in wanted], sizes.block):
                    least = block.least()
                    own_places = [asked[x.doc][slice(*np.searchsorted(asked[x.doc], [x.low, x.high]))] - x.base + a for x, a in zip(segments, block.starts)]
                    at = np.concatenate(own_places)
                    need = np.zeros(len(least), bool)
                    for back in range(STEPS):
                        s = at - back
                        need[s[least[s] == block.g24[at]]] = True
                    s = np.flatnonzero(need)
                    of = block.owners(s)
                    x, y = block.windows(s)
                    doc = np.array([g.doc for g in segments], np.int64)[of]
                    place = s - block.starts[of] + np.array([g.base for g in segments], np.int64)[of]
                    for held, v in zip(found, (x, y, doc, place)):
                        held.append(v)
                main, second, doc, place = (np.concatenate(v) for v in found)
                for kind_row in settle(ids, keys, main, second, doc, place, KEYS, parts, doc_parts):
                    yield kind_row

        return as_batches(rows())

    return run


def runs_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals joined where they meet or touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[new], ends[np.concatenate([new[1:] - 1, [len(ends) - 1]])]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def removal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document: what goes, as maximal runs, and the digest of what stays. COVER places: q-grams, REQUEST: windows."""
    for _, own in grouped(batches):
        texts, places = sorted_out(own)
        out: list[list] = [[] for _ in range(7)]
        for i, k, text in texts:
            n = len(text)
            grams = np.concatenate(places[COVER].get((i, k), [np.zeros(0, np.int64)]))
            whole = np.concatenate(places[REQUEST].get((i, k), [np.zeros(0, np.int64)]))
            starts, ends = runs_of(np.concatenate([np.maximum(grams - REACH, 0), whole]), np.concatenate([np.minimum(grams + GRAM + REACH, n), whole + LENGTH]))
            edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), n]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if len(starts) else text
            for column, v in zip(out, (None if i == NO_ID else i, n, int((ends - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest(), starts.tolist(), ends.tolist())):
                column.append(v)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [x.split()[0] for x in RESULT.split(", ")])


def repeated_slots(own: DataFrame) -> np.ndarray:
    """True at the slots of ids that stand on several rows (and of others that fall there): SLOTS bits, whatever the input."""
    rows = own.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("slot").alias("slot")).where("n > 1")
    place = F.col("slot") + 1  # Spark numbers a bitmap's places from 1
    maps = rows.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    again = np.zeros(SLOTS, bool)
    for r in maps.collect():
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little").astype(bool)
        again[(r.bucket - 1) * len(bits) : r.bucket * len(bits)] = bits
    return again


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs' starts and ends (bytes)."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("doc_id"), F.col(text_col).alias("text"))
    own = own.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    again = repeated_slots(own)
    n = parts = max(partitions(spark), total // sizes.part)

    def by_part(df: DataFrame) -> DataFrame:
        return df.repartition(n, "part").sortWithinPartitions("part", "kind")

    with dropped_shuffles(spark):
        level2 = materialise(by_part(own.mapInArrow(index_rows(parts, parts, sizes, again), ROWS)).mapInArrow(refine_rows(parts, False), ROWS), "buckets")
        texts = own.mapInArrow(text_rows(parts, sizes, again), ROWS)
        windows = by_part(texts.unionByName(level2.where(F.col("kind") == REQUEST))).mapInArrow(window_rows(parts, parts, sizes), ROWS)
        # What level 3 settles within parts or covers are windows: they travel as kind REQUEST from here on.
        level3 = materialise(by_part(windows).mapInArrow(refine_rows(parts, True), ROWS), "windows").withColumn("kind", F.lit(REQUEST))
    return by_part(texts.unionByName(level2.where(F.col("kind") == COVER)).unionByName(level3)).mapInArrow(removal_rows, RESULT)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents")).drop("starts", "ends")
