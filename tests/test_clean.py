"""Cleaning steps against the specification, on drawn texts."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scribe.functions import clean, lines, rules
from tests import spec

ALPHABET = list("abdefhilnoprstuwxIlO019_.=!<>:;|$(){}[]-'\"`\\ \t\n\r") + ["de f", "in put", "if ", "elif", "while ", " = ", "def", "else", "-->", "—", "–", ">", "£", "€", "é", "¡", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "’", "“", "    ", "  ", "\n   ", "\n  if "]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join)
STEPS = {
    "newlines": (clean.norm_newlines, spec.newlines),
    "rstrip": (clean.rstrip_lines, spec.rstrip),
    "arrows": (rules.ARROWS.apply, spec.arrows),
    "keywords": (rules.KEYWORDS.apply, lambda t: spec.keywords(t, rules.SPLIT_KEYWORDS)),
    "inverted": (clean.inverted_bang, spec.inverted),
    "numbers": (clean.numeric_confusions, spec.numbers),
    "semicolon": (clean.semicolon_colon, spec.semicolon),
    "braces": (clean.brace_paren, spec.braces),
    "pipe": (clean.pipe_in_ident, spec.pipe),
    "dollar": (clean.dollar_in_ident, spec.dollar),
    "bang": (clean.bang_in_ident, spec.bang),
    "equality": (clean.equality_fix, spec.equality),
    "tabs": (clean.expand_tabs, lambda t: spec.tabs(t)),
}


def outputs(spark, texts, step):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("o", step(F.col("t")))
    return [r.o for r in sorted(df.collect(), key=lambda r: r.i)]


@pytest.mark.parametrize("name", STEPS)
@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(TEXTS, min_size=120, max_size=120))
def test_step(spark, name, texts):
    step, want = STEPS[name]
    texts = [t.replace("\r", "") for t in texts] if name == "tabs" else texts  # line ends come first
    assert outputs(spark, texts, step) == [want(t) for t in texts]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.lists(st.tuples(st.integers(0, 13), st.sampled_from(["x", "", "if y:", "é"])), max_size=8), min_size=100, max_size=100))
def test_reindent(spark, texts):
    texts = ["\n".join(" " * n + x if x else "" for n, x in rows) for rows in texts]
    assert outputs(spark, texts, clean.reindent) == [spec.reindent(t) for t in texts]


def test_white_space_is_pythons(spark):
    every = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert outputs(spark, [f"x{c}" for c in every if c != "\n"], clean.rstrip_lines) == ["x"] * (len(every) - 1)
    assert outputs(spark, [f"de{c}f" for c in every], rules.KEYWORDS.apply) == ["def"] * len(every)


def test_quotes_and_sizes(spark):
    assert outputs(spark, ["‘’′ʼ“”«»″`"], clean.fold_quotes) == ["''''\"\"\"\"\"'"]
    assert outputs(spark, ["x" * 10_001, "x" * 10_000, "y"], lines.truncated) == ["x" * 10_000 + "[...output truncated]", "x" * 10_000, "y"]
    assert outputs(spark, ["<a & b>"], lines.escaped_html) == ["&lt;a &amp; b&gt;"]
    assert [r[0] for r in spark.createDataFrame([(5,), (2048,), (3 << 20,)], "n long").select(lines.human_size(F.col("n"))).collect()] == ["5 B", "2.0 KB", "3.00 MB"]


def test_own_rules(spark):
    mine = rules.RuleSet("mine", ((r"\bfoo\b", "bar"),), ("python",))
    assert outputs(spark, ["foo food"], mine.apply) == ["bar food"] and mine.serves("python") and not mine.serves("java")
