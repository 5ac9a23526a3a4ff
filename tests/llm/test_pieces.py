"""SentencePiece encoding against the library, and exact round trips."""

import random

import numpy as np
import pytest

from scribe.llm import pieces

LETTERS = ["ab ", "thein ", " ", "éü中\n\t", "🙂x", "aaaa", "0123.,!?<>="]


@pytest.fixture(scope="module")
def model():
    return pieces.model_of(pieces.model_path())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def texts(n, longest=90):
    rng = random.Random(n)
    return ["".join(rng.choice(rng.choice(LETTERS)) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_ids_are_the_librarys(model, library):
    for t in texts(1500):
        assert np.frombuffer(model.encode_span(pieces.marked(t)), np.uint32).tolist() == library.encode(t)


def test_chunks_change_nothing(model):
    for t in texts(300):
        for chunk in (17, 24, 40):
            assert model.pieces(pieces.marked(t), chunk) == model.pieces(pieces.marked(t))


def test_products_are_associative():
    rng = np.random.default_rng(1)
    a, b, c = (rng.choice([0.0, -1.0, -np.inf], (3, 4)) for _ in range(3))
    b = b.T
    left, right = pieces.compose(pieces.compose(a, b), c), pieces.compose(a, pieces.compose(b, c))
    assert (left == right).all()


def test_frames(spark, library):
    rows = [*texts(40), None, "", "a" * 700, " " * 500, "the theatre " * 60, "中" * 300 + " end", "x y" * 200, "un▁der"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumnRenamed("x", "y")
    out = pieces.decode(pieces.encode(df, pieces.model_path(), chunk=100), pieces.model_path()).collect()
    assert len(out) == len(rows)
    for r in out:
        t = rows[r.doc_id] or ""
        assert np.frombuffer(r.ids, np.uint32).tolist() == library.encode(t), t
        assert r.decoded == t.replace("▁", " ")
    empty = df.limit(0)
    assert pieces.encode(empty, pieces.model_path()).count() == 0


def test_other_types_are_refused(tmp_path):
    raw = open(pieces.model_path(), "rb").read()
    assert pieces.model_type(raw) == 2 and pieces.model_type(b"") == 1
    head = b"\x12\x06tok_v0\x18"
    assert raw.count(head + b"\x02") == 1
    other = tmp_path / "unigram.model"
    other.write_bytes(raw.replace(head + b"\x02", head + b"\x01"))
    with pytest.raises(ValueError, match="no BPE model"):
        pieces.Model(str(other))
