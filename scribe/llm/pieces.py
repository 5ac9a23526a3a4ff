"""SentencePiece encoding and decoding by a max-plus parallel scan.

The model file's pieces make a lattice over a text. Which paths count is said by weights between neighbouring pieces: for
the BPE models at hand, 0 where merging the two pieces' text gives just these two, and minus infinity elsewhere. A path of
weight 0 is the library's encoding, and the only one (each prefix of a text has one encoding, so each place is reached by
one last piece). Where no piece holds a pair of letters, nothing crosses the place between them.

A long document is cut into chunks at fixed places. A state at a cut is a piece of the lattice that ends there or reaches
across. A chunk's transfer matrix has, for each state at its left and right cut, the best weight between them in the
max-plus semiring; matrices are combined associatively, the best states at all cuts follow, and each chunk is then
backtraced alone between its two states. A short document is one chunk whose cuts are its ends.

Words between blanks meet no state but one, so a worker remembers them with their ids.

Defined cases: null and empty texts have no ids; U+2581 in a text is encoded like a space, and so decodes to one; letters
without a piece become byte pieces; lone surrogates are replaced; very long texts are chunked; rows repeated are encoded
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.llm.common import SLICE_ROWS, arrow_map, materialise, partitions, table

BLANK = "▁"
TAIL = re.compile(r"(?<=\w)\W+$")
WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
#: Letters of a chunk; documents of more are cut. A word of more is cut within a document.
CHUNK, WORD_CHUNK = 1 << 16, 1 << 10
CACHE = 300_000
NEVER = -np.inf
#: A worker's models, by path; they outlive a task.
WORKER: dict[tuple[type, str], Decoder] = {}

State = tuple[int, int]  # a piece's first place and the place after it


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number, and value (of varints) or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            if raw[at] < 128:
                return value, at + 1
            at, shift = at + 1, shift + 7

    at = 0
    while at < len(raw):
        head, at = varint(at)
        if head & 7 == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if head & 7 == 1 else (4, at) if head & 7 == 5 else varint(at)
            value, at = raw[at : at + size], at + size
        yield head >> 3, value


def model_type(raw: bytes) -> int:
    """The type a model file was trained as: 1 unigram (if none is said), 2 BPE, 3 words, 4 letters."""
    trainer = next((v for k, v in fields(raw) if k == 2), b"")  # the file's second field describes its trainer, whose third is the type
    return next((v for k, v in fields(trainer) if k == 3), 1)


class Decoder:
    """The bytes that ids stand for."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.raw = [b"" if sp.is_control(i) else bytes([int(self.names[i][3:5], 16)]) if sp.is_byte(i) else (" ⁇ " if sp.is_unknown(i) else self.names[i]).encode() for i in range(n)]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(BLANK, " ")
        return text.removeprefix(" ")


class Model(Decoder):
    """The pieces of a BPE model file and the weights between them; other types are refused, as their encodings differ."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            kind = model_type(f.read())
        if kind != 2:
            raise ValueError(f"{path} is no BPE model (its type is {kind}, not 2)")
        super().__init__(path)
        sp, n = self.sp, len(self.names)
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {self.names[i]: sp.get_score(i) for i in plain}
        self.byte = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.score))
        self.ids = {p: i for i, p in enumerate(self.names) if p in self.score and self.merged(p) == [p]}
        self.reach: dict[str, int] = {}  # by the first three letters, the longest piece
        for p in self.ids:
            self.reach[p[:3]] = max(len(p), self.reach.get(p[:3], 2))
        self.begins = {p[:i] for p in self.ids for i in range(1, len(p))}
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        # Pieces by rank: single letters first, then in the order in which merging prefers them; and the last merge of each.
        order = sorted(self.ids, key=lambda p: (len(p) > 1, -self.score[p], self.ids[p]))
        self.rank, self.by_rank = {p: r for r, p in enumerate(order)}, order
        halves = [(p, p) if len(p) == 1 else self.merged(p, 2) for p in order]
        self.left, self.right = [self.rank[a] for a, _ in halves], [self.rank[b] for _, b in halves]
        # Pieces that merging prefers to their own halves break that order; pairs of letters within them are merged anew.
        odd = [p for r, p in enumerate(order) if len(p) > 1 and max(self.left[r], self.right[r]) >= r]
        self.odd = {p[i : i + 2] for p in odd for i in range(len(p) - 1)}
        self.weights: dict[int, float] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what self.words was before it was full

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Neighbours merged by best score, the leftmost first, until none is a piece or only least parts are left."""
        parts, score = list(text), self.score
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, left: str, right: str) -> float:
        """0 if the two pieces stay apart when their text is encoded, else minus infinity."""
        rank, meet = self.rank, left[-1] + right[0]
        if left not in rank or right not in rank:
            return 0.0
        key = rank[left] << 20 | rank[right]
        held = self.weights.get(key)
        if held is None:
            if len(self.weights) > CACHE:
                self.weights.clear()
            if meet not in self.pairs:
                held = 0.0
            elif meet in self.odd:
                held = 0.0 if self.merged(left + right) == [left, right] else NEVER
            else:
                held = self.undone(rank[left], rank[right])
            self.weights[key] = held
        return held

    def undone(self, a: int, b: int) -> float:
        """The weight between two pieces given by rank."""
        # Merges are undone, the latest first: left's right end and right's left end are what met at each time. They stay
        # apart unless at some time their union was a piece that merging preferred to what came next.
        rank, names = self.rank, self.by_rank
        bound = len(names)
        while True:
            union = rank.get(names[a] + names[b])
            if union is not None and union < bound:
                return NEVER
            inner_a, inner_b = self.right[a], self.left[b]
            if inner_a == a and inner_b == b:
                return 0.0
            if inner_b == b or a > b and inner_a != a:
                bound, a = a, inner_a
            else:
                bound, b = b + 1, inner_b

    def at(self, text: str, start: int, end: int) -> Iterator[int]:
        """Where pieces that begin at start end, up to end; a letter without a piece stands alone."""
        ids, begins = self.ids, self.begins
        found = False
        for stop in range(start + 1, min(end, start + self.longest) + 1):
            part = text[start:stop]
            if part in ids:
                found = found or stop == start + 1
                yield stop
            if part not in begins:
                break
        if not found:
            yield start + 1

    def states(self, text: str, cut: int) -> list[State]:
        """The pieces that end at a cut or reach across it; at the ends of a text, an empty one."""
        if cut in (0, len(text)):
            return [(cut, cut)]
        return [(a, b) for a in range(max(0, cut - self.longest), cut) for b in self.at(text, a, len(text)) if b >= cut]

    def forward(self, text: str, first: State, right: int) -> tuple[dict[int, int], list[State]]:
        """From a state: the place before each reached place, and the reached pieces that end at right or reach across."""
        back: dict[int, int] = {}
        crossing: list[State] = []
        if first[1] >= right:  # a piece over the whole chunk, or the end
            return back, [(right, right) if right == len(text) else first]
        back[first[1]] = first[0]
        for p in range(first[1], right):
            if p not in back:
                continue
            last = text[back[p] : p]
            for stop in self.at(text, p, len(text)):
                if not last or self.weight(last, text[p:stop]) == 0.0:
                    if stop >= right:
                        crossing.append((p, stop))
                    if stop <= right:
                        back[stop] = p
        if right == len(text):
            crossing = [(right, right)] if right in back else []
        return back, crossing

    def transfer(self, text: str, left: int, right: int) -> np.ndarray:
        """Best weights between the states of two cuts."""
        ends = {s: i for i, s in enumerate(self.states(text, right))}
        starts = self.states(text, left)
        out = np.full((len(starts), len(ends)), NEVER)
        for i, s in enumerate(starts):
            for e in self.forward(text, s, right)[1]:
                out[i, ends[e]] = 0.0
        return out

    def backtrace(self, text: str, first: State, last: State, right: int) -> list[str]:
        """The pieces that begin after the state at the left, up to and with the state at the right."""
        if first == last:
            return []
        back, _ = self.forward(text, first, right)
        out, p = [text[last[0] : last[1]]] if last[1] > last[0] else [], last[0]
        while p > first[1]:
            out.append(text[back[p] : p])
            p = back[p]
        return out[::-1]

    def one_chunk(self, text: str) -> list[str]:
        """The encoding of a text between two cuts that no piece crosses: the path of weight 0, tried by longest pieces.

        A place is reached by one path alone, so a place from which the end was not reached need not be tried again.
        """
        rank, reach, weights, n, names, ranks = self.rank, self.reach, self.weights, len(text), [], []
        stops, dead, limit = [0], set(), n
        while (p := stops[-1]) < n:
            last = ranks[-1] if ranks else None
            for stop in range(min(limit, p + reach.get(text[p : p + 3], 2)), p, -1):
                part = text[p:stop]
                own = rank.get(part)
                if own is None and stop > p + 1 or stop in dead:
                    continue
                if last is not None and own is not None:
                    weight = weights.get(last << 20 | own)
                    if weight is None:
                        weight = self.weight(names[-1], part)
                    if weight:
                        continue
                stops.append(stop)
                names.append(part)
                ranks.append(own)
                break
            else:
                dead.add(p)
                limit = stops.pop() - 1
                names.pop()
                ranks.pop()
                continue
            limit = n
        return names

    def pieces(self, text: str, chunk: int = WORD_CHUNK) -> list[str]:
        """The encoding of a text, chunk by chunk."""
        if len(text) <= chunk:
            return self.one_chunk(text)
        cuts = [*range(0, len(text), chunk), len(text)]
        picked = best_states([self.transfer(text, a, b) for a, b in zip(cuts, cuts[1:])]) if len(cuts) > 2 else [0, 0]
        states = [self.states(text, c)[i] for c, i in zip(cuts, picked)]
        return [p for a, b, right in zip(states, states[1:], cuts[1:]) for p in self.backtrace(text, a, b, right)]

    def codes(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.byte.get(b, self.unknown) for b in piece.encode("utf-8", "replace")] if self.byte else [self.unknown]

    def word(self, text: str) -> bytes:
        """Ids of a word as bytes; a long one is cut first where no piece can cross."""
        long = len(text) > WORD_CHUNK
        safe = [0, *(i for i in range(1, len(text)) if long and text[i - 1 : i + 1] not in self.pairs), len(text)]
        out, ids = array("I"), self.ids
        for a, b in zip(safe, safe[1:]):
            for p in self.pieces(text[a:b]):
                if p in ids:
                    out.append(ids[p])
                else:
                    out.extend(self.codes(p))
        return out.tobytes()

    def encode_span(self, text: str) -> bytes:
        """Ids of a text whose ends no piece crosses (blanks already marked)."""
        words, held = WORD.findall(text), self.words
        try:
            return b"".join(map(held.__getitem__, words))
        except KeyError:
            if len(held) > CACHE:
                self.words, self.older = {}, held
                held = self.words
            for w in set(words).difference(held):
                held[w] = self.older.get(w) or self.parted(w)
            return b"".join(map(held.__getitem__, words))

    def parted(self, text: str) -> bytes:
        """Ids of a word that is new; letters and the marks after them apart where no piece has both."""
        m = TAIL.search(text)
        if m and text[m.start() - 1 : m.start() + 1] not in self.pairs:
            head, tail = text[: m.start()], text[m.start() :]
            return b"".join(self.words.get(x) or self.older.get(x) or self.words.setdefault(x, self.word(x)) for x in (head, tail))
        return self.word(text)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def best_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut of the best path through all matrices: a balanced tree of products, then down it again."""
    def build(lo: int, hi: int):
        if hi - lo == 1:
            return matrices[lo], None
        mid = (lo + hi) // 2
        left, right = build(lo, mid), build(mid, hi)
        return compose(left[0], right[0]), (left, right)

    out = [0] * (len(matrices) + 1)

    def walk(node, lo: int, hi: int) -> None:  # out[lo] and out[hi] are known
        if node[1] is None:
            return
        mid = (lo + hi) // 2
        left, right = node[1]
        out[mid] = int((left[0][out[lo]] + right[0][:, out[hi]]).argmax())
        walk(left, lo, mid)
        walk(right, mid, hi)

    root = build(0, len(matrices))
    out[0], out[-1] = divmod(int(root[0].argmax()), root[0].shape[1])
    walk(root, 0, len(matrices))
    return out


def model_of(path: str, kind: type[Decoder] = Model) -> Decoder:
    if (kind, path) not in WORKER:
        WORKER[kind, path] = kind(path)
    return WORKER[kind, path]


def marked(text: str | None) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


# A chunk travels with CONTEXT letters on both sides: as many as states need to be told apart, and the pieces that follow.
CONTEXT = 64


def chunk_matrix(model: Model, text: str, left: int, right: int) -> np.ndarray:
    """The transfer matrix of a chunk in its context: the words inside meet one state, so only its ends are computed."""
    first = next((m for m in range(left + model.longest, right) if text[m - 1] != BLANK and text[m] == BLANK), None)
    last = next((m for m in range(right - model.longest, left, -1) if text[m - 1] != BLANK and text[m] == BLANK), None)
    if first is None or last is None or first > last:
        return model.transfer(text, left, right)
    heads = np.array([[0.0 if any(e[1] == first for e in model.forward(text, s, first)[1]) else NEVER] for s in model.states(text, left)])
    inner = text[last:]
    ends = model.states(text, right)
    reached = {(a + last, b + last) for a, b in model.forward(inner, (0, 0), right - last)[1]}
    return compose(heads, np.array([[0.0 if e in reached else NEVER for e in ends]]))


def chunk_ids(model: Model, text: str, left: int, right: int, first: State, last: State) -> bytes:
    """Ids of the pieces between two states of a chunk."""
    start = next((m for m in range(first[1] + 1, last[0]) if text[m - 1] != BLANK and text[m] == BLANK), None)
    stop = next((m for m in range(last[0], first[1], -1) if text[m - 1] != BLANK and text[m : m + 1] == BLANK), None)
    if start is None or stop is None or start >= stop:
        return codes_of(model, model.backtrace(text, first, last, right))
    head = model.forward(text, first, start)[0]
    pieces, p = [], start
    while p > first[1]:
        pieces.append(text[head[p] : p])
        p = head[p]
    inner = text[stop:]
    tail = model.backtrace(inner, (0, 0), (last[0] - stop, last[1] - stop), right - stop)
    return codes_of(model, pieces[::-1]) + model.encode_span(text[start:stop]) + codes_of(model, tail)


def codes_of(model: Model, pieces: list[str]) -> bytes:
    return np.array([i for p in pieces for i in model.codes(p)], np.uint32).tobytes()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """A row per row of docs: doc_id, n_chars, text_sha256, ids (bytes: little-endian unsigned 32-bit)."""
    kept = "doc_id long, n_chars long, text_sha256 string, ids binary"
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = F.coalesce(F.length("text"), F.lit(0))

    def short(ids: list, texts: list) -> dict:
        model = model_of(path)
        return {
            "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "text_sha256": pa.array([hashlib.sha256((t or "").encode("utf-8", "replace")).hexdigest() for t in texts]),
            "ids": pa.array([model.encode_span(marked(t)) for t in texts], pa.binary()),
        }

    whole = arrow_map(own.where(n < chunk), kept, short, "doc_id", "text")

    # Long documents: each chunk with its context is a row; cuts are places in the marked text.
    long = own.where(n >= chunk).withColumn("doc", F.monotonically_increasing_id())

    def cut(ids: list, docs_: list, texts: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc", "chunk", "last", "piece", "left", "right")}
        for d, t in zip(docs_, texts):
            text = marked(t)
            cuts = [*range(0, len(text), chunk), len(text)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                lo, hi = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
                for name, v in zip(out, (d, k, len(cuts) - 2, text[lo:hi], a - lo, b - lo)):
                    out[name].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)}

    kinds = "doc long, chunk long, last long, piece string, left long, right long"
    held = materialise(long, "long-texts")
    chunks = materialise(arrow_map(held, kinds, cut, "doc_id", "doc", "text").repartition(partitions(docs.sparkSession)), "chunks")

    def matrices(docs_: list, numbers: list, texts: list, lefts: list, rights: list) -> dict:
        model = model_of(path)
        found = [chunk_matrix(model, t, a, b) for t, a, b in zip(texts, lefts, rights)]
        return {"doc": pa.array(docs_, pa.int64()), "chunk": pa.array(numbers, pa.int64()), "rows": pa.array([len(m) for m in found], pa.int64()), "m": pa.array([m.tobytes() for m in found], pa.binary())}

    transfers = arrow_map(chunks, "doc long, chunk long, rows long, m binary", matrices, "doc", "chunk", "piece", "left", "right")
    grouped = transfers.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chunk", "rows", "m"))).alias("ms"))  # small: states alone

    def paths(docs_: list, lists: list) -> dict:
        picked = [best_states([np.frombuffer(x["m"]).reshape(x["rows"], -1) for x in ms]) for ms in lists]
        return {"doc": pa.array(docs_, pa.int64()), "picked": pa.array(picked, pa.list_(pa.int64()))}

    states = arrow_map(grouped, "doc long, picked array<long>", paths, "doc", "ms")
    placed = chunks.join(states, "doc").select("doc", "chunk", "piece", "left", "right", F.get("picked", F.col("chunk").cast("int")).alias("a"), F.get("picked", (F.col("chunk") + 1).cast("int")).alias("b"))

    def trace(docs_: list, numbers: list, texts: list, lefts: list, rights: list, a: list, b: list) -> dict:
        model = model_of(path)
        codes = [chunk_ids(model, t, lo, hi, model.states(t, lo)[i], model.states(t, hi)[j]) for t, lo, hi, i, j in zip(texts, lefts, rights, a, b)]
        return {"doc": pa.array(docs_, pa.int64()), "chunk": pa.array(numbers, pa.int64()), "ids": pa.array(codes, pa.binary())}

    traced = arrow_map(placed, "doc long, chunk long, ids binary", trace, "doc", "chunk", "piece", "left", "right", "a", "b")
    joined = traced.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    codes = joined.select("doc", F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "").alias("hex"))
    long_rows = held.join(codes, "doc").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.unhex("hex").alias("ids"))
    return whole.unionByName(long_rows)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds decoded, the text that ids stand for, to doc_id, n_chars, text_sha256, ids."""
    kept = "doc_id long, n_chars long, text_sha256 string, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path, Decoder)
        for part in batches:
            for batch in (part.slice(at, SLICE_ROWS) for at in range(0, part.num_rows, SLICE_ROWS)):
                texts = pa.array([model.decode(np.frombuffer(c, np.uint32)) for c in batch.column("ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return encoded.select("doc_id", "n_chars", "text_sha256", "ids").mapInArrow(run, f"{kept}, decoded string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_crc32 (of the ids as bytes), decoded_sha256, round_trip."""
    path = model_path()
    back = decode(encode(table(spark, sf_dir, "documents"), path), path)
    digest = F.sha2(F.col("decoded").cast("binary"), 256)
    return back.select("doc_id", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), digest.alias("decoded_sha256"), (digest == F.col("text_sha256")).alias("round_trip"))
