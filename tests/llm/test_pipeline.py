"""The corpus pipeline: each stage's decisions on planted rows, and its shape."""

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scribe.llm import exact_dedup, near_copies, secrets, toxicity
from tests.llm.test_dedup import brute_exact

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secret_scan", "packing"]


def test_columns_are_kept(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(50), SF)
        assert out.dtypes == docs.dtypes


def test_toxicity_keeps_clean_documents(spark, docs):
    kept = {r.doc_id for r in toxicity.stage(spark, docs, SF).select("doc_id").collect()}
    rows = duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{SF}/labels.parquet' GROUP BY 1").fetchall()
    clean, toxic = [i for i, y in rows if not y], [i for i, y in rows if y]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    assert sum(i in kept for i in toxic) < 0.5 * len(toxic)


def test_dedups_match_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    once = exact_dedup.stage(spark, docs, SF)
    want = {k for i, (k, _, _) in brute_exact(rows).items() if k == i}
    assert {r.doc_id for r in once.select("doc_id").collect()} == want


def test_near_copies_go(spark, docs):
    words = [f"word{i}" for i in range(120)]
    text, edited = " ".join(words), " ".join([*words[:60], "changed", *words[61:]])
    rows = [(7, text), (3, edited), (None, edited + " end"), (5, "another text of its own entirely here"), (5, text), (None, "no copy of anything else at all")]
    out = near_copies.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted([(3, edited), (5, rows[3][1]), (0, rows[5][1])])


def test_secrets_go(spark, docs):
    out = secrets.stage(spark, docs, SF).collect()
    assert len(out) == docs.count()
    assert not [r for r in out for s in secrets.base_spans(r.text) if s.kind in ("access", "hex")]
    assert all(r.n_chars == len(r.text) for r in out)


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    left = {r.doc_id for r in rows}
    assert 100 < len(left) <= pq.read_table("/root/testdata/sf0.001/documents.parquet").num_rows
    seen = {}
    for r in rows:
        assert seen.setdefault(r.sequence_id, 0) <= 2048 and r.length > 0
        seen[r.sequence_id] += r.length
    assert sum(n < 2048 for n in seen.values()) <= 1


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, "s", None), (3, "x" * 50_000, "??", None, 50_000), (4, "stupid moron " * 5, "en", "s", 65)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda out: sorted(((r.doc_id or 0, r.text or "") for r in out.collect()), key=str)
    long, rude = (3, "x" * 50_000), (4, "stupid moron " * 5)
    want = {
        "toxicity": [(0, ""), (1, ""), (1, ""), (2, ""), long], "exact_dedup": [(1, ""), long, rude],
        "near_dedup": [(1, ""), (1, ""), long, rude], "secret_scan": [(0, ""), (1, ""), (1, ""), (2, ""), long, rude],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = texts(stage(spark, df, SF))
        assert [x for x in got if x != rude] == [x for x in want[name] if x != rude] and (name == "toxicity" or got == want[name]), name
    packed = corpus_pipeline.STAGES[-1][1](spark, df, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in packed} == {None, 1, 2, 3, 4} and all(r.n == r.m * (2 if r.doc_id == 1 else 1) for r in packed)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0, name
    more = df.withColumn("_digest", F.lit(1)).withColumn("ids", F.lit("z"))
    assert exact_dedup.stage(spark, more, SF).columns == more.columns


def test_exact_dedup_keeps_null_identifiers(spark):
    rows = [(None, "alone"), (None, "twice now"), (None, "twice\tnow"), (None, "with an id"), (4, "with an id"), (5, None), (6, ""), (7, "alone too")]
    out = exact_dedup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    got = sorted((r.doc_id or 0, (r.text or "").replace("\t", " ")) for r in out)
    assert got == [(0, "alone"), (0, "twice now"), (4, "with an id"), (5, ""), (7, "alone too")]


def test_the_stage_learns_from_whole_texts(spark, tmp_path):
    start = "the table of a walk " * (toxicity.SAMPLE_CHARS // 20 + 1)
    docs = spark.createDataFrame([(k, start + ("vile scum " if k % 2 else "kind folk ") * 5, "en") for k in range(200)], "doc_id long, text string, lang string")
    spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r.doc_id for r in toxicity.stage(spark, docs, str(tmp_path)).collect()) == list(range(0, 200, 2))
