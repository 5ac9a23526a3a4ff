"""Packing of token sequences by non-negative least squares over length combinations.

Documents are tokenised (one end id each) and cut into full windows and a remainder. Of the remainders only the histogram
of lengths (at most window - 1 numbers) reaches the driver. There all combinations of two or three lengths that fill the
window exactly are enumerated; non-negative least squares finds how often each should repeat so that together they match
the histogram; the counts are rounded down, then raised greedily while lengths last. What is left over is laid end to
end, longest first, and cut at window ends, so that all sequences but the last are full.

Placement is arithmetic: a remainder's place follows from its length and its rank among remainders of that length. Ranks
come from counts of each (length, written part) and a rank within it, so no task sees all documents of a length.

Defined cases: null and empty texts hold the end id alone; a null doc_id stays null; rows repeated are packed each; very
long texts fill many windows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribe.llm.common import arrow_map, materialise, table

WINDOW, END_ID, CACHE = 2048, 1, 500_000
ROUNDS = 300
#: A worker's words, by the tokenizer's path; they outlive a task.
WORKER: dict = {}


#: What texts of plain Latin hold, and how this tokenizer's pattern parts such texts once in lower case.
LATIN, DIGITS, BLANKS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r "
BEYOND_LATIN = re.compile("[^\t-\r\x20-\x7e\xa1-\u024f]")
#: Bytes of such texts that need no second look: ASCII, and letters from U+00C0 to U+023F.
PLAIN_BYTES = bytes([*range(9, 14), *range(32, 127), *range(0xC3, 0xC9), *range(0x80, 0xC0)])
PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LATIN}]+|[{DIGITS}]|[^{BLANKS}{LATIN}{DIGITS}]+")


def byte_letters() -> list[str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Words:
    """Token ids (as bytes) of the pieces that the tokenizer parts texts into, each tokenised once while it is remembered.

    Texts of plain Latin are parted here by the tokenizer's own pattern, and its model encodes the pieces; all others go
    to the whole tokenizer by words between spaces and line feeds, where it parts texts too.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.wide = "<u2" if self.of.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.wide == "<u2" else "I"
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what self.pieces was before it was full
        self.words: dict[str, bytes] = {}
        self.end = np.array([END_ID], self.wide).tobytes()
        self.letters = byte_letters()
        self.alike = self.parts_alike()

    def parts_alike(self) -> bool:
        """Whether PIECE parts this tokenizer's texts."""
        own = json.loads(self.of.to_str())
        split = next((p for p in (own["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), {})
        return own["model"]["type"] == "BPE" and split.get("pattern") == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"} and {"type": "Lowercase"} in (own["normalizer"] or {}).get("normalizers", [])

    def piece(self, text: str) -> bytes:
        model = self.of.model.tokenize(text if text.isascii() else "".join(map(self.letters.__getitem__, text.encode())))
        return array(self.code, [t.id for t in model]).tobytes()

    def is_plain(self, text: str) -> bool:
        """Whether PIECE parts a text as the tokenizer does. Most texts show it by their bytes alone."""
        if not self.alike or "<|" in text:
            return False
        return not text.encode("utf-8", "surrogatepass").translate(None, PLAIN_BYTES) or not BEYOND_LATIN.search(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text and the end id."""
        text = text or ""
        if self.is_plain(text):
            parts, held = PIECE.findall(text.lower()), self.pieces
            try:
                return b"".join(map(held.__getitem__, parts)) + self.end
            except KeyError:
                if len(held) > CACHE:
                    self.pieces, self.older = {}, held
                    held = self.pieces
                for w in set(parts).difference(held):
                    held[w] = self.older.get(w) or self.piece(w)
                return b"".join(map(held.__getitem__, parts)) + self.end
        parts, held = text.replace("\n", " ").split(" "), self.words
        if len(held) > CACHE:
            held.clear()
        new = list(set(parts).difference(held))
        for at in range(0, len(new), 4096):
            for w, e in zip(new[at : at + 4096], self.of.encode_batch(new[at : at + 4096], add_special_tokens=False)):
                held[w] = np.array(e.ids, self.wide).tobytes()
        return b"".join(map(held.__getitem__, parts)) + self.end


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (ids), ids (bytes, little-endian)."""

    def rows(ids: list, texts: list) -> dict:
        if path not in WORKER:
            WORKER[path] = Words(path)
        words = WORKER[path]
        size = np.dtype(words.wide).itemsize
        codes = [words.encode(t) for t in texts]
        return {"doc_id": pa.array(ids, pa.int64()), "n": pa.array([len(c) // size for c in codes], pa.int64()), "ids": pa.array(codes, pa.binary())}

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(own, "doc_id long, n long, ids binary", rows, "doc_id", "text")


def combinations_of(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """All (a, b, c), a >= b >= c, of the given lengths with a + b + c = window; c may be 0."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    a, b = np.meshgrid(np.arange(window + 1), np.arange(window + 1), indexing="ij", sparse=True)
    c = window - a - b
    fits = (a >= b) & (b >= c) & (c >= 0)
    fits &= have[a] & have[b]
    fits &= (c == 0) | have[np.clip(c, 0, window)]
    i, j = np.nonzero(fits)
    return np.stack([i, j, window - i - j], axis=1).astype(np.int64)


def least_squares(patterns: np.ndarray, wanted: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that brings the lengths used by x patterns nearest to wanted: accelerated projected gradient."""
    n, size = len(patterns), len(wanted)
    if not n:
        return np.zeros(0)
    used = lambda x: sum(np.bincount(patterns[:, k], weights=x, minlength=size) for k in range(3))
    live = np.ones(size)
    live[0] = 0
    probe = np.ones(n)
    for _ in range(20):  # the largest eigenvalue of A'A, by power iteration
        y = used(probe) * live
        probe = y[patterns].sum(axis=1)
        top = np.linalg.norm(probe)
        probe /= top
    x = ahead = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        error = (used(ahead) - wanted) * live
        step = np.maximum(0, ahead - error[patterns].sum(axis=1) / (1.05 * top))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = step + (was - 1) / t * (step - x)
        x = step
    return x


def solve(hist: np.ndarray, window: int = WINDOW) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of the patterns to use; never more of a length than hist (by length) holds."""
    patterns = combinations_of(np.flatnonzero(hist), window)
    x = least_squares(patterns, hist.astype(float))
    left, out = hist.copy(), {}

    def take(k: int, most: int) -> None:
        parts = [int(v) for v in patterns[k] if v]
        n = min([most, *(int(left[v]) // parts.count(v) for v in set(parts))])
        if n > 0:
            out[k] = out.get(k, 0) + n
            for v in parts:
                left[v] -= n

    order = np.argsort(-x, kind="stable")
    for k in order:
        if x[k] < 1:
            break
        take(k, int(x[k]))
    for k in order:  # rounding left some of each length
        take(k, int(left.max()))
    return [(n, tuple(int(v) for v in patterns[k] if v)) for k, n in out.items()]


class Plan:
    """Where a remainder goes, by its length and rank."""

    def __init__(self, hist: np.ndarray, window: int = WINDOW):
        self.window = window
        self.slots: dict[int, list[tuple[int, int, int]]] = {}  # length -> (first rank, first sequence, offset)
        done, sequence = np.zeros(window + 1, np.int64), 0
        for n, parts in solve(hist, window):
            at = 0
            for v in parts:
                self.slots.setdefault(v, []).append((int(done[v]), sequence, at))
                done[v] += n
                at += v
            sequence += n
        self.done, self.base, stream = done, {}, 0
        for v in range(window - 1, 0, -1):  # the rest, end to end, the longest first
            if hist[v] > done[v]:
                self.base[v] = stream
                stream += int(hist[v] - done[v]) * v
        self.first_stream, self.first_full = sequence, sequence - (-stream // window)
        self.ranks = {v: np.array([s[0] for s in x]) for v, x in self.slots.items()}

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the remainder, length, sequence, offset) of its pieces."""
        if rank < self.done[length]:
            first, sequence, offset = self.slots[length][int(np.searchsorted(self.ranks[length], rank, side="right")) - 1]
            return [(0, length, sequence + rank - first, offset)]
        at = self.base[length] + (rank - int(self.done[length])) * length
        head = min(length, self.window - at % self.window)
        out = [(0, head, self.first_stream + at // self.window, at % self.window)]
        return out + [(head, length - head, self.first_stream + at // self.window + 1, 0)] if head < length else out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ids = tokenised(docs, path, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    held = materialise(ids, "tokens")
    sized = held.select("doc_id", "n", "ids", "row", F.shiftright("row", 33).alias("part"), (F.col("n") % window).alias("rest"), F.floor(F.col("n") / window).alias("full"))
    counts = materialise(sized.groupBy("part", "rest").agg(F.count("*").alias("m"), F.sum("full").alias("f")), "lengths")
    totals = counts.groupBy("rest").agg(F.sum("m").alias("m"), F.sum("f").alias("f")).collect()  # at most window rows
    hist, fulls = np.zeros(window + 1, np.int64), np.zeros(window + 1, np.int64)
    for r in totals:
        hist[r.rest], fulls[r.rest] = r.m, r.f
    hist[0] = 0
    plan = Plan(hist, window)
    full_base = plan.first_full + np.concatenate([[0], np.cumsum(fulls)[:-1]])
    before = W.partitionBy("rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("part", "rest", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0"))
    within = W.partitionBy("part", "rest").orderBy("row")
    ranked = sized.select("*", (F.row_number().over(within) - 1).alias("r"), (F.sum("full").over(within) - F.col("full")).alias("g"))
    placed = ranked.join(offsets.hint("merge"), ["part", "rest"]).select("doc_id", "n", "ids", (F.col("m0") + F.col("r")).alias("rank"), (F.col("f0") + F.col("g")).alias("full_rank"))
    cast = spark.sparkContext.broadcast((plan, full_base))  # bounded by the window
    wide = "<u4"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, full_base = cast.value
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, n, code, rank, full_rank in zip(*(batch.column(i).to_pylist() for i in range(5))):
                tokens = np.frombuffer(code, f"<u{len(code) // n}").astype(wide).tobytes()
                rest, whole = n % window, n // window
                pieces = [(k * window, window, int(full_base[rest]) + full_rank + k, 0) for k in range(whole)]
                if rest:
                    pieces += [(whole * window + s, size, q, o) for s, size, q, o in plan.places(rest, rank)]
                for s, size, q, o in pieces:
                    for column, x in zip(out, (doc, s, size, zlib.crc32(tokens[4 * s : 4 * (s + size)]), n, q, o)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [x.split()[0] for x in PIECES.split(", ")])

    return placed.mapInArrow(cut, PIECES)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the pieces of the packed sequences."""
    return pack(docs, tokenizer_path())
