"""The registered queries over whole tables, against brute force or plainer paths."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scribe.llm import language, toxicity
from scribe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def found(spark):
    held = {}

    def rows(name):
        if name not in held:
            held[name] = QUERIES[name](spark, SF).collect()
        return held[name]

    return rows


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "op9_packing"])
def test_a_row_for_each_document(found, documents, name):
    assert sorted(r.doc_id for r in found(name)) == sorted(documents)


def test_held_out(found):
    for name, modulus, rest in (("op5_language_id", 5, 0), ("op7_toxicity", 3, 1)):
        for r in found(name):
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
            assert 0 <= r.score <= 1
    assert all(r.predicted == int(r.score >= 0.7) for r in found("op7_toxicity"))


def test_languages_of_held_out_rows(found):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet' WHERE lang IS NOT NULL").fetchall())
    held = [r for r in found("op5_language_id") if r.held_out and r.doc_id in langs]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) > 0.9 * len(held) > 10


def test_links_are_whole(found):
    rows = found("op2_simhash_near_dedup")
    fps = {r.fingerprint: int(r.fingerprint, 16) for r in rows}
    component = {f: {r.component_id for r in rows if r.fingerprint == f} for f in fps}
    assert all(len(c) == 1 for c in component.values())
    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                assert component[a] == component[b]
    assert all(r.component_id <= r.doc_id for r in rows)


def test_removed_bytes(found, documents):
    seen = {}
    for i in sorted(documents):
        data = documents[i].encode()
        for at in range(len(data) - 49):
            seen.setdefault(data[at : at + 50], i)
    for r in found("op8_substring_dedup"):
        data = documents[r.doc_id].encode()
        gone = np.zeros(len(data) + 1, bool)
        for at in range(len(data) - 49):
            if seen[data[at : at + 50]] < r.doc_id:
                gone[at : at + 50] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_pieces_lie_end_to_end(found, documents):
    from tokenizers import Tokenizer

    from scribe.llm import packing

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = found("op9_packing")
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == sorted(documents)
    for i, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(documents[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence))) or len(by_sequence) > 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_languages_beyond_a_byte():
    """200 languages, each of its own words: every one is learned and found, mixed texts too."""
    rng = np.random.default_rng(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [["".join(rng.choice(list(letters), 7)) for _ in range(30)] for _ in range(200)]
    langs = [f"l{i:03d}" for i in range(200)]
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    model = language.train([(text(k, 60), langs[k]) for k in range(200) for _ in range(3)])
    got = language.predict(model, [text(k, 40) for k in range(200)] + [text(150, 30) + " " + text(199, 30)])
    assert [g[0] for g in got[:200]] == langs
    assert [s[0] for s in got[200][2]] == ["l150", "l199"]


def test_every_label_is_learned(spark):
    long = [("w" + chr(97 + k % 26) + chr(97 + k // 26) + " ") * 4000 for k in range(260)]
    rows = [(k, long[k] if k % 2 else long[k][:40], f"l{k}") for k in range(260)]
    got = language.sample_of(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {y for _, y in got} == {f"l{k}" for k in range(260)}
    assert max(len(t) for t, _ in got) == language.SAMPLE_CHARS
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") < 5, "few").otherwise("many").alias("lang"))
    got = [y for _, y in language.sample_of(many)]
    assert got.count("few") == 5 and got.count("many") == language.SAMPLE_ROWS


def test_a_class_of_long_texts_alone(spark):
    """Labelled texts beyond SAMPLE_CHARS teach where a class has no others."""
    rows = [(k, ("vile scum " if k % 2 else "kind folk ") * 1000) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    sample = toxicity.sample_of(docs, labels)
    assert sorted(y for _, y, _ in sample) == [0] * 20 + [1] * 20 and {len(t) for t, _, _ in sample} == {toxicity.SAMPLE_CHARS}
    scores = toxicity.score_texts(toxicity.train(sample), ["vile scum " * 900, "kind folk " * 900])
    assert scores[0] > 0.6 and scores[1] < 0.4  # some eight texts kept aside hold the calibration near the middle
    mixed = docs.union(spark.createDataFrame([(100 + k, "vile scum") for k in range(30)], docs.schema))
    more = labels.union(spark.createDataFrame([(100 + k, 1) for k in range(30)], labels.schema))
    sample = toxicity.sample_of(mixed, more, rows=25)
    assert sum(y for _, y, _ in sample) == 25 and {len(t) for t, y, _ in sample if y} == {9}
    assert sum(not y for _, y, _ in sample) == 20


def direct_score(model, text):
    """The network as defined: windows of embedded words, one filter after another."""
    words = toxicity.WORD.findall((text or "").lower())
    emb = [sum((model.embeddings[model.rows.get(h, 0)] for h in toxicity.hashes_of(w)), np.zeros(toxicity.DIMENSIONS)) for w in words]
    top, other, place = [], [], 0
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            seen = []
            for at in range(len(words)):
                total = 0.0
                for j in range(width):
                    if at + j < len(words):
                        total += float(emb[at + j] @ model.filters[:, (place + j) * toxicity.FILTERS + f])
                seen.append(total + model.bias[k * toxicity.FILTERS + f])
            seen.sort(reverse=True)
            top.append(max(0.0, seen[0]) if seen else max(0.0, float(model.bias[k * toxicity.FILTERS + f])))
            other.append(max(0.0, seen[toxicity.RANK - 1]) if len(seen) >= toxicity.RANK else (0.0 if seen else max(0.0, float(model.bias[k * toxicity.FILTERS + f]))))
        place += width
    raw = float(np.array(top + other) @ model.weight) + model.offset
    return 1 / (1 + np.exp(-(model.scale[0] * raw + model.scale[1])))


def test_scores_match_direct_convolution():
    rng = np.random.default_rng(3)
    words = ["vile", "scum", "idiot", "lovely", "friend", "walk", "table", "the", "of", "and"]
    texts = [" ".join(rng.choice(words[3:], 12)) for _ in range(60)]
    sample = [(t, 0, "en") for t in texts] + [(t + " you vile idiot " + t, 1, "en") for t in texts]
    model = toxicity.train(sample)
    probes = [None, "", "vile", "vile scum", "walk the table", "vile " * 50, *texts[:20], *(t for t, y, _ in sample[60:80])]
    got = toxicity.score_texts(model, probes)
    assert np.allclose(got, [direct_score(model, t) for t in probes], atol=1e-4)


def test_the_stage_needs_no_language(spark):
    docs = spark.createDataFrame([(1, "plain"), (2, None)], "doc_id long, text string")
    assert toxicity.stage(spark, docs, SF).count() == 2


def test_every_labelled_row_and_its_whole_text_is_learned(spark, tmp_path):
    """What tells the classes stands beyond SAMPLE_CHARS, and the rows of a class are more than SAMPLE_ROWS."""
    start = "the table of a walk " * (toxicity.SAMPLE_CHARS // 20 + 1)
    rows = [(k, start + ("vile scum " if k % 2 else "kind folk ") * 5, "en") for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.op7_toxicity(spark, str(tmp_path)).collect())
    many = spark.createDataFrame([(k % 2, "vile" if k % 2 else "kind") for k in range(2 * toxicity.SAMPLE_ROWS + 1002)], "y int, t string").repartition(3)
    counts = toxicity.counted(many)
    half = toxicity.SAMPLE_ROWS + 501
    assert toxicity.totals_of(counts) == (half, half)
    assert [counts[y, toxicity.hashes_of(w)[0] & (toxicity.BUCKETS - 1)] for w, y in (("kind", 0), ("vile", 1), ("kind", 1))] == [half, half, 0]


def test_labels_meet_texts_by_one_plan_and_few_texts_travel(spark):
    """Small labels were broadcast and large ones merged; then every allowed text went through the exchange, labelled or not."""
    docs = spark.createDataFrame([(k, f"text {k}", None if k % 3 else "en") for k in range(4000)] + [(7, "again", "de"), (None, "none", "en"), (8, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 4 // 2) for k in range(0, 4000, 40)] + [(7, 0), (7, 1), (9, None), (None, 1), (9000, 1)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels)
    want = [(k % 4 // 2, f"text {k}", None if k % 3 else "en") for k in range(0, 4000, 40)] + [(1, "text 7", None), (1, "again", "de")]
    assert sorted(((r.y, r.t, r.l) for r in rows.collect()), key=str) == sorted(want, key=str)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    own, marks = docs.selectExpr("doc_id AS i", "text AS t", "lang AS l"), labels.selectExpr("doc_id AS i", "toxic")
    for held, most in ((marks, 130), (marks.limit(0), 0)):
        ids = [r.i for r in toxicity.among(own, held).collect()]
        assert {r.i for r in held.collect()} & set(range(4000)) <= set(ids) and len(ids) <= most


def test_hashes_of_beginnings():
    for word in ("", "a", "abc", "abcd", "abcdefghijk", "schönheit", "日本語テキスト"):
        parts = ["=" + word, *(word[:k] for k in toxicity.BEGINNINGS if len(word) >= k)]
        assert toxicity.hashes_of(word) == [zlib.crc32(p.encode()) & ((1 << toxicity.HASH_BITS) - 1) for p in parts]


def test_a_text_does_not_count_for_itself():
    counts = np.zeros((2, toxicity.BUCKETS + 1), np.int64)
    counts[:, -1] = 90, 10
    counts[1, [h & (toxicity.BUCKETS - 1) for h in toxicity.hashes_of("scum")]] = 1
    assert toxicity.odds_of(counts, ["scum"])[0, 0] > 0.1
    assert np.allclose(toxicity.odds_of(counts, ["scum"], 1)[0], 0)
