"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed ones: of the word and of its beginnings of 3 to 8 letters; hashes that the sample
does not hold add nothing. Filters of several widths slide over the embedded words; of each filter's responses in a text
the largest and the RANK-th largest are pooled (a word may stand by chance, several seldom do), and a logistic layer joins
them. As a filter is a sum over its places, each place's projection of a word is computed once and remembered, and scoring
a text is gathering, adding and taking maxima over its whole length.

Queries learn from every allowed labelled row and its whole text (trained()), whatever the input's size:

1. One row in ASIDE is kept aside. Over the others, every hash's texts are counted by class in BUCKETS buckets. A word's
   embedding is the shrunk log-odds of its hashes, a dimension for each kind of hash, and how common it is.
2. Filters and the logistic layer are learned by Adam in shards of SHARD_ROWS rows, each of which reads all of its rows; their
   means, weighed by rows, start the next of ROUNDS. A text's own count is taken off its words' odds while it is learned from.
3. All rows kept aside are scored: a logistic fit over their histogram calibrates, and each language's threshold is the lowest
   of at least LEAST_THRESHOLD that at most MOST_FALSE of its clean rows reach. Language is no input of a score.

What travels to the driver is the counts (BUCKETS, in ranges), one mean of the small layers a round, and histograms.

train() learns from a list in memory, with embeddings that are trained too; sample_of() chooses such a list (at most SAMPLE_ROWS
a class, SAMPLE_CHARS of each). No query uses either.

Defined cases: null and empty texts are scored as a text without words; labels that are null are no labels; several
labels of a document count as their largest; with no label of a class the score is constant (0, or 1 if all are toxic);
rows repeated are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.llm.common import arrow_map, crc_mod, dropped_shuffles, least_hashes, materialise, table

SAMPLE_ROWS, SAMPLE_CHARS = 2000, 8000
BUCKETS, RANGES, SHRINK = 1 << 20, 64, 1.0
ROUNDS, SHARD_ROWS, CHUNK_ROWS, CHUNK_WORDS = 2, 6000, 2048, 1 << 20
BINS, MOST_FALSE = 64, 0.005
MARK_BITS, PART_BITS = 26, 15  # the second is that of bitmap_construct_agg
WIDTHS, FILTERS, DIMENSIONS, RANK = (1, 2, 3), 8, 8, 3
HASH_BITS, LEAST_DOCS, BEGINNINGS = 26, 2, (3, 4, 5, 6, 7, 8)
EPOCHS, LEAST_STEPS, BATCH, RATE, ASIDE = 8, 600, 32, 0.02, 5
DECIDE, LEAST_THRESHOLD = 0.7, 0.7
CACHE, SLICE = 120_000, 1 << 17
PLACES = sum(WIDTHS)
#: Rows of a scorer's tables: the end of a text comes first.
END = 0

WORD = re.compile(r"[^\W_]+")


class Model(NamedTuple):
    rows: dict[int, int]  # hash -> row of the embeddings; row 0 is zero
    embeddings: np.ndarray
    filters: np.ndarray  # (DIMENSIONS, PLACES * FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    scale: tuple[float, float]
    by_lang: dict[str, float]
    constant: float | None = None
    name: str = ""
    counts: np.ndarray | None = None  # (2, BUCKETS + 1): clean and toxic texts of each bucket, and of all; instead of rows and embeddings


def hashes_of(word: str) -> list[int]:
    """The word's own hash and those of its beginnings."""
    mask, crc = (1 << HASH_BITS) - 1, zlib.crc32
    if word.isascii():  # a beginning's checksum goes on from the shorter one's
        data = word.encode()
        found = [crc(b"=" + data) & mask]
        if len(data) >= BEGINNINGS[0]:
            c = crc(data[: BEGINNINGS[0]])
            found.append(c & mask)
            for k in range(BEGINNINGS[0], min(len(data), BEGINNINGS[-1])):
                c = crc(data[k : k + 1], c)
                found.append(c & mask)
        return found
    parts = ["=" + word, *(word[:k] for k in BEGINNINGS if len(word) >= k)]
    return [crc(p.encode("utf-8", "surrogatepass")) & mask for p in parts]


def odds_of(counts: np.ndarray, words: list[str], own: int | None = None) -> np.ndarray:
    """Embeddings of words by counts: shrunk log-odds of each kind of hash, then how common the word is. own: the class of the
    text that they stand in, whose own count is taken off."""
    found = [hashes_of(w) for w in words]
    sizes = np.array([len(f) for f in found])
    at = np.array([h for f in found for h in f], np.int64) & (BUCKETS - 1)
    word = np.repeat(np.arange(len(words)), sizes)
    kind = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cold, hot = counts[0, at].astype(float), counts[1, at].astype(float)
    if own is not None:
        (hot if own else cold)[:] -= 1
        cold, hot = np.maximum(cold, 0), np.maximum(hot, 0)
    n0, n1 = totals_of(counts)
    share = n1 / (n0 + n1)
    odds = np.log((hot + SHRINK * share) / (cold + SHRINK * (1 - share))) - np.log(share / (1 - share))
    out = np.zeros((len(words), DIMENSIONS), np.float32)
    out[word, kind] = np.clip(odds / 4, -1, 1)
    whole = kind == 0
    out[:, DIMENSIONS - 1] = np.log1p((hot + cold)[whole]) / np.log1p(n0 + n1) / 4
    return out


def totals_of(counts: np.ndarray) -> tuple[float, float]:
    """Clean and toxic texts: the last column of counts."""
    return float(counts[0, BUCKETS]), float(counts[1, BUCKETS])


class Scorer:
    """A model, and the projections of the words that a worker has met."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}
        self.table = np.zeros((1024, PLACES * FILTERS), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        try:
            return np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = sorted(set(words).difference(cache))
            sums = self.vectors(new)
            first = len(cache) + 1
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(new)] = sums @ self.model.filters
            cache.update(zip(new, range(first, first + len(new))))
            return np.fromiter(map(cache.__getitem__, words), np.int64, len(words))


    def vectors(self, words: list[str]) -> np.ndarray:
        if self.model.counts is not None:
            return odds_of(self.model.counts, words)
        get = self.model.rows.get
        found = [[get(h, 0) for h in hashes_of(w)] for w in words]
        flat = np.array([r for f in found for r in f], np.int64)
        return np.add.reduceat(self.model.embeddings[flat], np.concatenate([[0], np.cumsum([len(f) for f in found])[:-1]]), axis=0)


#: A worker's scorer, by the model's name; it outlives a task.
WORKER: dict[str, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    if model.name not in WORKER:
        WORKER.clear()
        WORKER[model.name] = Scorer(model)
    return WORKER[model.name]


def pooled(table: np.ndarray, bias: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, where: bool = False):
    """Largest and RANK-th largest response of each filter in each text, and where. ids: rows of table, each text followed by ends."""
    half = len(WIDTHS) * FILTERS
    z, at = np.zeros((len(ids), half), np.float32), 0
    for k, width in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        for j in range(width):
            z[: len(ids) - j, cols] += table[ids[j:], at * FILTERS : (at + 1) * FILTERS]
            at += 1
    out = np.zeros((len(starts), 2 * half), np.float32)
    spots = np.zeros(out.shape, np.int64) if where else None
    for d, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
        if not n:
            continue
        own, r = z[a : a + n], min(RANK, n)  # a window starts at a word
        if where:
            order = np.argpartition(own, n - r, axis=0)[n - r]
            top = own.argmax(axis=0)
            spots[d] = a + np.concatenate([top, order])
            out[d] = np.concatenate([np.take_along_axis(own, top[None], 0)[0], np.take_along_axis(own, order[None], 0)[0]])
        else:
            out[d, :half] = own.max(axis=0)
            out[d, half:] = np.partition(own, n - r, axis=0)[n - r]
        if n < RANK:
            out[d, half:] = -1e9
    out += np.tile(bias, 2)
    np.maximum(out, 0, out=out)
    return (out, spots) if where else out


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = np.full(max(WIDTHS), END, np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + len(gap))[:-1]]).astype(np.int64)
    return np.concatenate([x for t in texts for x in (t, gap)]), starts, lengths


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(sample: list[tuple[str, int, str | None]], seed: int = 7) -> Model:
    """sample: (text, label, lang); lang serves the thresholds alone."""
    rng = np.random.default_rng(seed)
    half = len(WIDTHS) * FILTERS
    if len({y for _, y, _ in sample}) < 2:
        none = np.zeros(0)
        return Model({}, none, none, none, none, 0.0, (1.0, 0.0), {}, float(sample[0][1]) if sample else 0.0)
    vocabulary: dict[str, int] = {}
    texts = [np.array([vocabulary.setdefault(w, len(vocabulary)) + 1 for w in WORD.findall(t.lower())], np.int64) for t, _, _ in sample]
    parts = [hashes_of(w) for w in vocabulary]
    labels = np.array([y for _, y, _ in sample], np.float64)
    order = rng.permutation(len(sample))
    aside, used = order[::ASIDE], np.setdiff1d(order, order[::ASIDE])

    # In how many texts of each class each hash stands.
    counts = {0: Counter(), 1: Counter()}
    for i in used:
        counts[int(labels[i])].update({h for w in np.unique(texts[i]) for h in parts[w - 1]})
    names = sorted(h for h in counts[0].keys() | counts[1].keys() if counts[0][h] + counts[1][h] >= LEAST_DOCS)
    rows = {h: i + 1 for i, h in enumerate(names)}
    n1, n0 = labels[used].sum(), (1 - labels[used]).sum()
    hot, cold = np.array([counts[1][h] for h in names], float), np.array([counts[0][h] for h in names], float)
    odds = np.log((hot + 0.25) / (n1 + 0.5)) - np.log((cold + 0.25) / (n0 + 0.5))
    emb = np.zeros((len(names) + 1, DIMENSIONS), np.float32)
    emb[1:] = rng.normal(0, 0.03, (len(names), DIMENSIONS))
    emb[1:, 0] = np.clip(odds / 8, -0.5, 0.5)
    most = max((len(p) for p in parts), default=1)
    features = np.zeros((len(parts) + 1, most), np.int64)  # row 0: the end of a text
    for i, p in enumerate(parts):
        features[i + 1, : len(p)] = [rows.get(h, 0) for h in p]
    filters = rng.normal(0, 0.15, (DIMENSIONS, PLACES * FILTERS)).astype(np.float32)
    filters[0] = np.abs(filters[0]) + 0.3
    bias, weight, offset = np.zeros(half, np.float32), np.full(2 * half, 0.15, np.float32), -1.0
    moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in (("emb", emb), ("filters", filters), ("bias", bias), ("weight", weight))}
    steps = 0

    def moved(kind: str, p: np.ndarray, g: np.ndarray, own=slice(None)) -> None:
        m, v = moments[kind]
        m[own] += 0.1 * (g - m[own])
        v[own] += 0.01 * (g * g - v[own])
        p[own] -= (RATE * (m[own] / (1 - 0.9**steps)) / (np.sqrt(v[own] / (1 - 0.99**steps)) + 1e-6)).astype(p.dtype)

    of_place = [(k, j) for k, w in enumerate(WIDTHS) for j in range(w)]
    per_epoch = max(1, len(used) // BATCH)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // per_epoch))):
        for part in np.array_split(rng.permutation(used), per_epoch):
            steps += 1
            ids, starts, lengths = laid_out([texts[i] for i in part])
            met, ids = np.unique(ids, return_inverse=True)
            x = emb[features[met]].sum(axis=1)
            y, spots = pooled(x @ filters, bias, ids, starts, lengths, where=True)
            error = (sigmoid(y @ weight + offset) - labels[part]) / len(part)
            back = (error[:, None] * weight[None, :] * (y > 0)).astype(np.float32)
            to_x, to_filters = np.zeros_like(x), np.zeros_like(filters)
            for f, (k, j) in enumerate(of_place):
                own = slice(f * FILTERS, (f + 1) * FILTERS)
                for side in (0, half):
                    cols = slice(side + k * FILTERS, side + (k + 1) * FILTERS)
                    words, g = ids[np.minimum(spots[:, cols] + j, len(ids) - 1)], back[:, cols]
                    to_filters[:, own] += np.einsum("nfd,nf->df", x[words], g)
                    np.add.at(to_x, words.ravel(), (g[:, :, None] * filters[:, own].T[None]).reshape(-1, DIMENSIONS))
            live = np.flatnonzero(np.abs(to_x).sum(axis=1))
            touched, where = np.unique(features[met[live]], return_inverse=True)
            to_emb = np.zeros((len(touched), DIMENSIONS), np.float32)
            np.add.at(to_emb, where.ravel(), np.repeat(to_x[live], most, axis=0))
            to_emb[touched == 0] = 0
            moved("weight", weight, (y.T @ error + 1e-4 * weight).astype(np.float32))
            moved("bias", bias, back[:, :half].sum(axis=0) + back[:, half:].sum(axis=0))
            moved("filters", filters, to_filters)
            moved("emb", emb, to_emb, touched)
            emb[0] = 0
            offset -= RATE * 5 * float(error.sum())
    model = Model(rows, emb, filters, bias, weight, offset, (1.0, 0.0), {}, name=uuid.uuid4().hex)
    raw = raw_scores(Scorer(model), [sample[i][0] for i in aside])
    scale = calibrated(raw, labels[aside])
    return model._replace(scale=scale, by_lang=thresholds(sigmoid(scale[0] * raw + scale[1]), labels[aside], [sample[i][2] for i in aside]))


def calibrated(raw: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of a logistic fit with smoothed targets. times: how often each stands."""
    if times is not None:
        share, n1, n0 = times / times.sum(), (labels * times).sum(), ((1 - labels) * times).sum()
        mean = float(share @ raw)
        spread = float(np.sqrt(share @ (raw - mean) ** 2)) + 1e-9
        target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        z, a, b = (raw - mean) / spread, 1.0, 0.0
        for _ in range(2000):
            e = share * (sigmoid(a * z + b) - target)
            a, b = max(0.05, a - 0.5 * float(e @ z)), b - 0.5 * float(e.sum())
        return a / spread, b - a * mean / spread
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, spread = raw.mean(), raw.std() + 1e-9
    z, a, b = (raw - mean) / spread, 1.0, 0.0
    for _ in range(500):
        e = sigmoid(a * z + b) - target
        a, b = max(0.05, a - 0.5 * float((e * z).mean())), b - 0.5 * float(e.mean())
    return a / spread, b - a * mean / spread


def thresholds(scores: np.ndarray, labels: np.ndarray, langs: list[str | None], most_false: float = 0.005) -> dict[str, float]:
    """For each language the lowest threshold of at least LEAST_THRESHOLD that at most most_false of its clean texts reach."""
    out = {}
    for lang in {x for x in langs if x is not None}:
        clean = np.sort(scores[[x == lang for x in langs] & (labels == 0)])
        allowed = int(most_false * len(clean))
        edge = clean[len(clean) - 1 - allowed] if len(clean) else 0.0
        out[lang] = float(max(LEAST_THRESHOLD, np.nextafter(edge, 2.0))) if edge < 0.99 else 0.99
    return out


def raw_scores(scorer: Scorer, texts: list[str | None]) -> np.ndarray:
    """The logistic layer's sums, for slices of texts at a time."""
    model, out = scorer.model, np.zeros(len(texts))
    held: list[list[str]] = []
    size = first = 0
    for i, text in enumerate(texts):
        held.append(WORD.findall((text or "").lower()))
        size += len(held[-1])
        if size > SLICE or i + 1 == len(texts):
            if len(scorer.cache) > CACHE:
                scorer.cache.clear()  # here alone, so that rows of a slice stay
            ids, starts, lengths = laid_out([scorer.ids(w) for w in held])
            out[first : i + 1] = pooled(scorer.table, model.bias, ids, starts, lengths) @ model.weight + model.offset
            held, size, first = [], 0, i + 1
    return out


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    return sigmoid(model.scale[0] * raw_scores(scorer_of(model), texts) + model.scale[1])


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: Column | None = None, rows: int = SAMPLE_ROWS) -> list[tuple[str, int, str | None]]:
    """At most rows labelled texts of each class: short ones first, those of the smallest hashes."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.where(allowed) if allowed is not None else marks
    marks = marks.groupBy(F.col("doc_id").alias("i")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    sizes = docs.select(F.col(id_col).cast("long").alias("i"), (F.length(text_col) > SAMPLE_CHARS).cast("int").alias("long")).where("long is not null")
    met = materialise(sizes.join(marks, "i"), "toxicity-marks")  # labelled rows alone: i, long, y
    totals = {(r.y, r.long): r.n for r in met.groupBy("y", "long").agg(F.count("*").alias("n")).collect()}

    def take(y: int, long: int) -> DataFrame:
        wanted = rows if not long else rows - min(rows, totals.get((y, 0), 0))
        own = met.where((F.col("y") == y) & (F.col("long") == long)).where(least_hashes("i", max(1, wanted), totals.get((y, long), 0)))
        return own.select("i", "y").distinct().orderBy(F.xxhash64("i"), "i").limit(wanted)

    ids = {r.i: r.y for y in (0, 1) for long in (0, 1) if totals.get((y, long)) for r in take(y, long).collect()}
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    chosen = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.substring(text_col, 1, SAMPLE_CHARS).alias("t"), lang.alias("l"))
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids] or [(None,)], "i long")  # at most 2 * SAMPLE_ROWS ids
    found = chosen.join(F.broadcast(wanted), "i", "left_semi").orderBy("i", "t").limit(2 * rows).collect()
    return [(r.t, ids[r.i], r.l) for r in found]


class Net(NamedTuple):
    """The layers that shards learn."""

    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray  # one number


def fresh(seed: int = 7) -> Net:
    rng, half = np.random.default_rng(seed), len(WIDTHS) * FILTERS
    filters = rng.normal(0, 0.15, (DIMENSIONS, PLACES * FILTERS)).astype(np.float32)
    filters[0] = np.abs(filters[0]) + 0.3
    return Net(filters, np.zeros(half, np.float32), np.full(2 * half, 0.15, np.float32), np.full(1, -1.0, np.float32))


class Learner:
    """A shard's copy of the layers, and the embeddings of the words that it has met, by their text's class."""

    def __init__(self, net: Net, counts: np.ndarray, rate: float, seed: int):
        self.net, self.counts, self.rate = Net(*(p.copy() for p in net)), counts, rate
        self.rng, self.steps, self.rows = np.random.default_rng(seed), 0, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net]
        n0, n1 = totals_of(counts)
        self.weighs = np.array([0.5 * (n0 + n1) / n0, 0.5 * (n0 + n1) / n1])

    def read(self, texts: list[str], labels: list[int], repeat: int) -> None:
        """repeat times over some texts, in batches drawn at random."""
        words = [WORD.findall(t.lower()) for t in texts]
        self.rows += len(texts)
        met: tuple[dict, dict] = {}, {}
        for own, y in zip(words, labels):
            met[y].update(dict.fromkeys(own))
        tables, first = [np.zeros((1, DIMENSIONS), np.float32)], 1  # row 0: the end of a text
        for y in (0, 1):
            if met[y]:
                tables.append(odds_of(self.counts, list(met[y]), y))
                met[y].update(zip(met[y], range(first, first + len(met[y]))))
                first += len(met[y])
        table, y = np.concatenate(tables), np.array(labels)
        ids = [np.fromiter(map(met[k].__getitem__, own), np.int64, len(own)) for own, k in zip(words, labels)]
        for _ in range(repeat):
            for part in np.array_split(self.rng.permutation(len(ids)), -(-len(ids) // BATCH)):
                self.step(table, [ids[i] for i in part], y[part])

    def step(self, table: np.ndarray, texts: list[np.ndarray], labels: np.ndarray) -> None:
        filters, bias, weight, offset = self.net
        half = len(bias)
        ids, starts, lengths = laid_out(texts)
        met, ids = np.unique(ids, return_inverse=True)
        x = table[met]
        y, spots = pooled(x @ filters, bias, ids, starts, lengths, where=True)
        error = (sigmoid(y @ weight + offset[0]) - labels) * self.weighs[labels] / len(labels)
        back = (error[:, None] * weight[None, :] * (y > 0)).astype(np.float32)
        to_filters, at = np.zeros_like(filters), 0
        for k, width in enumerate(WIDTHS):
            for j in range(width):
                for side in (0, half):
                    cols = slice(side + k * FILTERS, side + (k + 1) * FILTERS)
                    to_filters[:, at * FILTERS : (at + 1) * FILTERS] += np.einsum("nfd,nf->df", x[ids[np.minimum(spots[:, cols] + j, len(ids) - 1)]], back[:, cols])
                at += 1
        self.steps += 1
        slopes = to_filters, back[:, :half].sum(axis=0) + back[:, half:].sum(axis=0), y.T @ error + 1e-4 * weight, error.sum(keepdims=True)
        for p, g, (m, v) in zip(self.net, slopes, self.moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-6)).astype(p.dtype)


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, t) to counts of buckets, in RANGES ranges; range -1 holds the numbers of texts."""
    counts, cache = np.zeros((2, BUCKETS + 1), np.int64), {}
    for batch in batches:
        for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(WORD.findall(t.lower()))
            if len(cache) > CACHE:
                cache.clear()
            new = words.difference(cache)
            cache.update(zip(new, map(hashes_of, new)))
            held = np.fromiter((h for w in words for h in cache[w]), np.int64) & (BUCKETS - 1)
            counts[y, np.unique(held)] += 1
            counts[y, BUCKETS] += 1
    yield from range_blobs(counts)


def range_blobs(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    cuts = [*np.split(counts[:, :BUCKETS], RANGES, axis=1), counts[:, BUCKETS:]]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([zlib.compress(np.ascontiguousarray(c).tobytes(), 1) for c in cuts], pa.binary())], ["part", "data"])


def summed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of ranges, added."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(zlib.decompress(data), np.int64)
            sums[part] = sums[part] + own if part in sums else own
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["part", "data"])


def counted(rows: DataFrame) -> np.ndarray:
    """Texts of each bucket by class, over all rows (y, t)."""
    found = rows.select("y", "t").mapInArrow(count_rows, "part int, data binary").repartition(RANGES, "part").mapInArrow(summed_rows, "part int, data binary")
    cuts = {r.part: np.frombuffer(zlib.decompress(bytes(r.data)), np.int64).reshape(2, -1) for r in found.collect()}
    return np.concatenate([cuts[k] for k in range(RANGES + 1)], axis=1) if cuts else np.zeros((2, BUCKETS + 1), np.int64)


def learned(rows: DataFrame, counts: np.ndarray) -> Net:
    """The layers after ROUNDS over all rows (y, t)."""
    spark, total, net = rows.sparkSession, int(sum(totals_of(counts))), fresh()
    shards = max(1, total // SHARD_ROWS)
    repeat = max(1, -(-LEAST_STEPS * BATCH * shards // (ROUNDS * total)))
    cast = spark.sparkContext.broadcast(counts)
    for k in range(ROUNDS):

        def shard(batches, net=net, k=k):
            learner = Learner(net, cast.value, RATE / (k + 1), k)
            texts, labels, size = [], [], 0
            for batch in batches:
                for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    texts.append(t)
                    labels.append(y)
                    size += len(t) // 5
                    if len(texts) >= CHUNK_ROWS or size > CHUNK_WORDS:
                        learner.read(texts, labels, repeat)
                        texts, labels, size = [], [], 0
            if texts:
                learner.read(texts, labels, repeat)
            flat = np.concatenate([p.ravel() for p in learner.net]).astype(np.float64) * learner.rows
            yield pa.RecordBatch.from_arrays([pa.array([learner.rows], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["n", "data"])

        def mean(batches):
            n, total = 0, np.zeros(sum(p.size for p in net))
            for batch in batches:
                for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    n, total = n + own, total + np.frombuffer(data)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / max(n, 1)).tobytes()], pa.binary())], ["n", "data"])

        found = rows.select("y", "t").coalesce(shards).mapInArrow(shard, "n long, data binary").repartition(1).mapInArrow(mean, "n long, data binary").first()
        flat, parts = np.frombuffer(bytes(found.data)), []
        for p in net:
            parts.append(flat[: p.size].reshape(p.shape).astype(np.float32))
            flat = flat[p.size :]
        net = Net(*parts)
    return net


def among(own: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (i, t, l) of own whose i may stand in marks: all that do, and of others as large a share as marks take of 2^MARK_BITS
    cells. What has no label need not travel."""
    cell = F.xxhash64("i").bitwiseAND(F.lit((1 << MARK_BITS) - 1)).alias("cell")
    parts = marks.select(cell).groupBy(F.shiftright("cell", PART_BITS).alias("part"))
    held = parts.agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(F.lit((1 << PART_BITS) - 1))).alias("bits"))
    found = np.zeros((1 << MARK_BITS - PART_BITS, 1 << PART_BITS - 3), np.uint8)
    for r in held.collect():  # 8 MB at most
        found[r.part] = np.frombuffer(r.bits, np.uint8)
    cast = own.sparkSession.sparkContext.broadcast(zlib.compress(found.tobytes(), 1))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(cast.value), np.uint8)
        for batch in batches:
            at = batch.column(3).to_numpy()
            yield batch.select(["i", "t", "l"]).filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))

    return own.select("i", "t", "l", cell).mapInArrow(kept, own.select("i", "t", "l").schema)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: Column | None = None) -> DataFrame:
    """y, t, l and aside of all labelled rows of docs. The join is a merge at every size, as labels grow with the documents: small
    ones, if broadcast, would tell nothing of what large ones take."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    own = docs.where(F.col(text_col).isNotNull()).withColumnRenamed(id_col, "doc_id")
    if allowed is not None:
        marks, own = marks.where(allowed), own.where(allowed)
    marks = marks.select(F.col("doc_id").cast("long").alias("i"), "toxic")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = among(own.select(F.col("doc_id").cast("long").alias("i"), F.col(text_col).alias("t"), lang.alias("l")), marks)
    marks = marks.groupBy("i").agg((F.max("toxic") > 0).cast("int").alias("y"))
    return own.join(marks.hint("merge"), "i").select("y", "t", "l", (F.pmod(F.xxhash64("i"), F.lit(ASIDE)) == 0).alias("aside"))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: Column | None = None) -> Model:
    """The model of all labelled rows of docs, whole texts; allowed: of labels' doc_id."""
    none, spark = np.zeros(0), docs.sparkSession
    with dropped_shuffles(spark):
        rows = materialise(labelled(docs, labels, id_col, text_col, allowed), "toxicity-labelled")
    used, aside = rows.where("not aside"), rows.where("aside")
    counts = counted(used)
    if min(totals_of(counts)) == 0:  # so few rows that what is kept aside leaves a class without any
        used = aside = rows
        counts = counted(rows)
        if min(totals_of(counts)) == 0:
            return Model({}, none, none, none, none, 0.0, (1.0, 0.0), {}, float(totals_of(counts)[1] > 0))
    net = learned(used, counts)
    model = Model({}, none, net.filters, net.bias, net.weight, float(net.offset[0]), (1.0, 0.0), {}, name=uuid.uuid4().hex, counts=counts)
    cast = spark.sparkContext.broadcast(model)

    def raw(ys: list, langs: list, texts: list) -> dict:
        return {"y": pa.array(ys, pa.int32()), "l": pa.array(langs, pa.string()), "raw": pa.array(raw_scores(scorer_of(cast.value), texts), pa.float64())}

    bins = arrow_map(aside, "y int, l string, raw double", raw, "y", "l", "t").select("y", "l", F.floor(F.greatest(F.lit(-64.0), F.least(F.lit(64.0), F.col("raw"))) * BINS).cast("int").alias("bin"))
    hist = materialise(bins.groupBy("y", "l", "bin").agg(F.count("*").alias("n")), "toxicity-aside")
    every = hist.groupBy("y", "bin").agg(F.sum("n").alias("n")).orderBy("y", "bin").collect()  # at most 2 * 128 * BINS
    if every:
        y, at, n = (np.array([r[c] for r in every], float) for c in ("y", "bin", "n"))
        model = model._replace(scale=calibrated((at + 0.5) / BINS, y, n))
    return model._replace(by_lang=edges(hist.where("y = 0"), model.scale), name=uuid.uuid4().hex)


def edges(clean: DataFrame, scale: tuple[float, float]) -> dict[str, float]:
    """Thresholds of the languages some of whose clean rows (l, bin, n) reach LEAST_THRESHOLD: all others have that."""
    least = int(np.floor((np.log(LEAST_THRESHOLD / (1 - LEAST_THRESHOLD)) - scale[1]) / scale[0] * BINS))
    high = F.collect_list(F.when(F.col("bin") >= least, F.struct("bin", "n"))).alias("high")
    out = {}
    for r in clean.where("l is not null").groupBy("l").agg(F.sum("n").alias("n"), high).where(F.size("high") > 0).collect():
        over, edge = int(MOST_FALSE * r.n), None
        for at, n in sorted(r.high, reverse=True):
            over -= n
            if over < 0:
                edge = at + 1  # the upper end of the first bin that may not go over
                break
        if edge is not None:
            out[r.l] = min(0.99, max(LEAST_THRESHOLD, float(sigmoid(scale[0] * edge / BINS + scale[1]))))
    return out


def with_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and threshold (of the row's language) for each row of docs."""
    cast = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS counts and the small layers

    def rows(ids: list, langs: list, texts: list) -> dict:
        m = cast.value
        return {"doc_id": pa.array(ids, pa.int64()), "score": score_texts(m, texts), "threshold": pa.array([m.by_lang.get(x, DECIDE) for x in langs], pa.float64())}

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"))
    return arrow_map(own, "doc_id long, score double, threshold double", rows, "doc_id", "lang", "text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, table(spark, sf_dir, "labels"), allowed=crc_mod("doc_id", 3) != 1)
    scored = with_scores(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= DECIDE).cast("int").alias("predicted"), (F.col("score") >= F.col("threshold")).alias("rejected"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches their language's threshold."""
    model = trained(docs, table(spark, sf_dir, "labels"), allowed=crc_mod("doc_id", 3) != 1)
    cast = spark.sparkContext.broadcast(model)

    def kept(batches):
        m = cast.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs = batch.column("lang").to_pylist() if "lang" in batch.schema.names else [None] * len(texts)
            scores = score_texts(m, texts)
            yield batch.filter(pa.array([s < m.by_lang.get(x, DECIDE) for s, x in zip(scores, langs)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
