"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

A word's script narrows the candidates to languages that the sample shows in that script; each candidate's score is the
sum of smoothed log-probabilities of the word's letter groups (1 to 3 letters, word ends marked) and, for frequent words,
of the word itself, held in at most WORD_BOUND. Viterbi over the words of a text, with a price for each change, labels
spans; the text's language is the one with the most letters in its spans, and its score their share.

Every language that a label names is learned. The sample is bounded by SAMPLE_ROWS texts a language (fewer where there are
so many languages that SAMPLE_ALL would be passed, LEAST_ROWS at least), chosen by a hash of doc_id; of a text longer than
SAMPLE_CHARS it takes a window of that length, whose place a hash chooses. Prediction reads whole texts.

Defined cases: a text that is null or has no letter is `und` with score 0 and no spans; with no labelled rows all texts
are `und`; ties go to the language that sorts first; rows repeated are predicted each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scribe.llm.common import arrow_map, crc_mod, table

SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_ALL, LEAST_ROWS = 400, 8000, 80_000, 10
SWITCH, WORD_BOUND, SMOOTHING, LEAST_SEEN = 12.0, 8.0, 0.5, 2
CACHE, MOST_BROADCAST = 300_000, 100_000
WORD = re.compile(r"[^\W\d_]+")

#: First and last code points of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)], "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)], "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)], "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
RANGES = sorted((a, b, name) for name, spans in SCRIPTS.items() for a, b in spans)
STARTS = np.array([a for a, _, _ in RANGES])


def script_of(word: str) -> str:
    """The script of a word's first letter; other where no range has it."""
    c = ord(word[0])
    i = int(np.searchsorted(STARTS, c, side="right")) - 1
    return RANGES[i][2] if i >= 0 and c <= RANGES[i][1] else "other"


def groups(word: str) -> list[str]:
    w = f" {word} "
    return [*word, *(w[i : i + 2] for i in range(len(w) - 1)), *(w[i : i + 3] for i in range(len(w) - 2))]


class Model(NamedTuple):
    langs: list[str]
    rows: dict[str, int]  # letter group -> row; row 0 is for those not seen
    table: np.ndarray  # (groups, langs)
    words: dict[str, np.ndarray]
    scripts: dict[str, np.ndarray]  # script -> 0 for candidates, -1e6 for others
    name: str


WORKER: dict[str, tuple[dict[str, int], np.ndarray, list[int]]] = {}


def train(sample: list[tuple[str, str]]) -> Model:
    """sample: (text, lang)."""
    langs = sorted({y for _, y in sample})
    counts = [Counter() for _ in langs]
    for text, lang in sample:
        counts[langs.index(lang)].update(WORD.findall(text.lower()))
    grams, scripts = [Counter() for _ in langs], [Counter() for _ in langs]
    for k, words in enumerate(counts):
        for w, n in words.items():
            scripts[k][script_of(w)] += n
            for g in groups(w):
                grams[k][g] += n
    names = sorted(g for g, n in sum(grams, Counter()).items() if n >= LEAST_SEEN)
    rows = {g: i + 1 for i, g in enumerate(names)}
    table_ = np.zeros((len(names) + 1, len(langs)), np.float32)
    for k in range(len(langs)):
        totals = Counter()
        for g, n in grams[k].items():
            totals[len(g)] += n
        size = Counter(len(g) for g in names)
        for g, i in rows.items():
            table_[i, k] = np.log((grams[k][g] + SMOOTHING) / (totals[len(g)] + SMOOTHING * (size[len(g)] + 1)))
    if len(langs):
        table_[1:] -= table_[1:].mean(axis=1, keepdims=True)
    common = {w for c in counts for w, n in c.most_common(2000) if n >= 5}
    sums = np.array([sum(c.values()) for c in counts], float)
    words = {}
    for w in common:
        p = np.log((np.array([c[w] for c in counts]) + SMOOTHING) / (sums + 1))
        words[w] = np.clip(p - p.mean(), -WORD_BOUND / 2, WORD_BOUND / 2).astype(np.float32)
    allowed = {}
    for s in [*SCRIPTS, "other"]:
        share = np.array([c[s] / max(1, sum(c.values())) for c in scripts])
        allowed[s] = np.where(share >= 0.01, 0, -1e6).astype(np.float32) if (share >= 0.01).any() else np.zeros(len(langs), np.float32)
    return Model(langs, rows, table_, words, allowed, uuid.uuid4().hex)


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """(words, langs); zero rows for words without a letter."""
    out = np.zeros((len(words), len(model.langs)), np.float32)
    get, lengths, ids = model.rows.get, [], []
    for w in words:
        g = groups(w)
        ids += [get(x, 0) for x in g]
        lengths.append(len(g))
    if words:
        sums = np.add.reduceat(model.table[np.array(ids)], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)
        out = np.clip(sums - sums.mean(axis=1, keepdims=True), -WORD_BOUND, WORD_BOUND)
        for i, w in enumerate(words):
            if w in model.words:
                out[i] += model.words[w]
            out[i] += model.scripts[script_of(w)]
    return out


def rows_of(model: Model, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's words as rows of a score table, the table, and the letters of each row; row 0 has no letter."""
    if model.name not in WORKER:
        WORKER.clear()
        WORKER[model.name] = ({}, np.zeros((1, len(model.langs)), np.float32), [0])
    cache, scores, letters = WORKER[model.name]
    found = [WORD.findall((t or "").lower()) for t in texts]
    new = set().union(*found).difference(cache) if found else set()
    if len(cache) > CACHE:
        cache, scores, letters = {}, np.zeros((1, len(model.langs)), np.float32), [0]
        new = set().union(*found)
    known = []
    for w in new:
        if any(map(str.isalpha, w)):
            cache[w] = len(letters)
            letters.append(len(w))
            known.append(w)
        else:
            cache[w] = 0
    parts = [scores] + [word_scores(model, known[i : i + 20_000]) for i in range(0, len(known), 20_000)]
    scores = np.concatenate(parts)
    WORKER[model.name] = (cache, scores, letters)
    return [np.fromiter(map(cache.__getitem__, f), np.int64, len(f)) for f in found], scores, np.array(letters)


def viterbi(rows: list[np.ndarray], scores: np.ndarray, price: float = SWITCH) -> list[np.ndarray]:
    """The best language of each word of each text: all texts step together, longest first."""
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    lengths = np.array([len(rows[i]) for i in order], np.int64)
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(rows)
    if not len(order) or not lengths[0]:
        return out
    flat = np.concatenate([rows[i] for i in order])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")  # texts longer than t
    path = np.zeros(len(flat), np.int32)
    best = np.zeros(len(flat), np.int32)  # the best language before each word
    moved = np.zeros((len(flat), -(-scores.shape[1] // 8)), np.uint8)  # a bit for each language
    value = scores[flat[starts[: live[0]]]].astype(np.float64)
    ends = np.zeros(len(lengths), np.int32)
    for t in range(1, lengths[0]):
        n = live[t]
        if n < len(value):
            ends[n : len(value)] = value[n:].argmax(axis=1)
            value = value[:n]
        top = value.argmax(axis=1)
        held = value[np.arange(n), top] - price
        at = starts[:n] + t
        best[at] = top
        moved[at] = np.packbits(held[:, None] > value, axis=1)
        value = np.maximum(value, held[:, None]) + scores[flat[at]]
    ends[: len(value)] = value.argmax(axis=1)
    state = ends
    for t in range(lengths[0] - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        path[at] = state[:n]
        if t:
            own = state[:n]
            state[:n] = np.where(moved[at, own >> 3] >> (7 - (own & 7)) & 1, best[at], own)
    for k, i in enumerate(order):
        out[i] = path[starts[k] : starts[k] + lengths[k]]
    return out


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, score, spans) of each text; a span is (language, first word, last word)."""
    if not model.langs:
        return [("und", 0.0, [])] * len(texts)
    rows, scores, letters = rows_of(model, texts)
    out = []
    for r, path in zip(rows, viterbi(rows, scores)):
        if not r.any():
            out.append(("und", 0.0, []))
            continue
        mass = np.bincount(path, weights=letters[r], minlength=len(model.langs))
        k = int(mass.argmax())
        ends = np.flatnonzero(np.diff(path, append=-1))
        firsts = [0, *(ends[:-1] + 1).tolist()]
        out.append((model.langs[k], float(mass[k] / mass.sum()), [(model.langs[path[a]], a, int(b)) for a, b in zip(firsts, ends)]))
    return out


def sample_of(docs: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, str]]:
    """Texts, or windows of them, of each language: those of the smallest hashes."""
    rows = docs.where(F.col("lang").isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.where(allowed) if allowed is not None else rows
    slim = rows.select(F.col(id_col).alias("i"), "lang", F.xxhash64(id_col).alias("h"))
    counts = slim.groupBy("lang").agg(F.count("*").alias("n"))
    langs = counts.count()
    wanted = max(LEAST_ROWS, min(SAMPLE_ROWS, SAMPLE_ALL // max(1, langs)))
    # Some three times as many as are wanted, below a bound on their hash, so that no task sorts a language's rows.
    below = F.when(F.col("n") > 3 * wanted, (F.lit(3.0 * wanted) / F.col("n") - 0.5) * F.lit(2.0**64)).otherwise(F.lit(2.0**63))
    bounds = counts.select("lang", below.alias("below"))
    # Languages are few; their number is counted before they are broadcast, so that rows are not dealt by a hot language.
    chosen = slim.join(F.broadcast(bounds) if langs <= MOST_BROADCAST else bounds, "lang").where(F.col("h") <= F.col("below"))
    first = W.partitionBy("lang").orderBy("h", "i")
    held = {r.i for r in chosen.withColumn("k", F.row_number().over(first)).where(F.col("k") <= wanted).select("i").collect()}  # at most wanted * langs
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(held)] or [(None,)], "i long")  # bounded by the sample
    start = F.pmod(F.xxhash64(id_col, F.lit("window")), F.greatest(F.length(text_col) - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    found = rows.select(F.col(id_col).alias("i"), F.substring(text_col, start, F.lit(SAMPLE_CHARS)).alias("t"), "lang").join(F.broadcast(ids), "i", "left_semi")
    return [(r.t, r.lang) for r in found.orderBy("i", "t").limit(wanted * max(1, langs)).collect()]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, lang_pred, score, spans array<struct<lang, first_word, last_word>>."""
    cast = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def rows(ids: list, texts: list) -> dict:
        got = []
        at = size = 0
        most = 32_000_000 // max(8, len(cast.value.langs))
        for i, t in enumerate(texts):  # parts of some millions of letters
            size += len(t or "")
            if size > most or i + 1 == len(texts):
                got += predict(cast.value, texts[at : i + 1])
                at, size = i + 1, 0
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
        return {
            "doc_id": pa.array(ids, pa.int64()),
            "lang_pred": pa.array([g[0] for g in got], pa.string()),
            "score": pa.array([g[1] for g in got], pa.float64()),
            "spans": pa.array([[{"lang": x, "first_word": a, "last_word": b} for x, a, b in g[2]] for g in got], kind),
        }

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(own, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first_word:long,last_word:long>>", rows, "doc_id", "text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(sample_of(docs, crc_mod("doc_id", 5) != 0))
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
