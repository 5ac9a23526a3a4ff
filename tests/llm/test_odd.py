"""Every operator on odd tables: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

import pytest
from pyspark.sql import functions as F

from scribe.llm import exact_dedup, language, licenses, packing, pieces, secrets, simhash, substrings, syncmers, toxicity

ROWS = [(None, None, None), (None, "x", "en"), (1, "", "en"), (1, "", "en"), (2, "the same text here", None), (3, "the same text here", "fr"), (4, "y" * 150_000, "de"), (5, "word " * 20_000, "en"), (6, "\0 ퟿ \U0010ffff", "zz"), (7, "ß İ ǅ ſ ΑΣ", "en")]
CLASHES = ("id", "key", "n", "ids", "fp", "part", "kind", "data", "norm", "digest", "seq", "first", "locator", "batch", "score", "threshold", "spans", "labels", "doc", "chunk", "range", "seat", "guest", "own", "edited", "next_text", "row", "rest", "full")


def model():
    return language.train([("the and of to", "en"), ("le la de et", "fr")])


OPERATORS = {
    "licenses": licenses.find_licenses,
    "simhash": simhash.near_groups,
    "exact": exact_dedup.exact_dedup,
    "pieces": lambda df: pieces.decode(pieces.encode(df, pieces.model_path(), chunk=50_000), pieces.model_path()),
    "language": lambda df: language.identify(df, model()),
    "syncmers": syncmers.fingerprints,
    "toxicity": lambda df: toxicity.with_scores(df, toxicity.train([("bad words", 1, "en"), ("good words", 0, "en")] * 20)),
    "substrings": substrings.repeated_substrings,
    "packing": lambda df: packing.pack(df, packing.tokenizer_path()),
    "secrets": secrets.find_secrets,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({c: F.lit("7") for c in CLASHES})
    out = OPERATORS[name](df.repartition(3)).collect()
    ids = [r.doc_id for r in out]
    assert set(ids) == {i for i, _, _ in ROWS}
    if name != "packing":
        assert len(out) == len(ROWS)
    assert OPERATORS[name](df.limit(0)).count() == 0
    same = spark.createDataFrame([(5, "tie tie tie tie tie tie " * 5, "en")] * 6, "doc_id long, text string, lang string")
    assert OPERATORS[name](same).count() >= 6


def test_samples(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, None), (1, None, 0), (2, 0, 1), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert [(y, x) for _, y, x in toxicity.sample_of(df, labels)] == [(0, "en"), (0, "en"), (1, None)]
    assert {x for _, x in language.sample_of(df)} == {"de", "en", "fr", "zz"}  # de has one text of 150,000 letters: a window of it
    assert toxicity.sample_of(df.limit(0), labels.limit(0)) == [] and language.sample_of(df.limit(0)) == []
