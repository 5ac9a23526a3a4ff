"""Correction of transcribed source text: cleaning in the JVM, then one Arrow UDF for what needs a parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribe.functions import clean
from scribe.functions.rules import CATALOGUE, WS, RuleSet
from scribe.operators.repair import repair_udf


def normal_language(language: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(language, F.lit("python"))), rf"\A{WS}+|{WS}+\z", "")


def cleaned(df: DataFrame, text: str, out: str, language: str, extra: tuple[RuleSet, ...] = ()) -> DataFrame:
    """Adds out: text with all corrections short of parsing. Each step is a projection, so that none is evaluated twice."""
    df = df.withColumn(out, clean.norm_newlines(F.coalesce(F.col(text), F.lit(""))))
    steps = [clean.expand_tabs, clean.rstrip_lines, clean.reindent]
    steps += [r.apply for r in (*CATALOGUE, *extra) if r.serves(language)]
    steps += [clean.fold_quotes, clean.inverted_bang, clean.numeric_confusions]
    if language == "python":
        steps += [clean.semicolon_colon, clean.brace_paren, clean.pipe_in_ident, clean.dollar_in_ident, clean.bang_in_ident, clean.equality_fix]
    for step in steps:
        df = df.withColumn(out, step(F.col(out)))
    return df


def correct_syntax(df: DataFrame, text: str = "text", language: str = "language", extra: tuple[RuleSet, ...] = ()) -> DataFrame:
    """Adds corrected, ok and diagnostics. Rows of other languages than Python never reach the UDF."""
    own = df.withColumn("_language", normal_language(F.col(language)))
    empty = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{WS}+", "") == ""
    python = cleaned(own.where("_language = 'python'"), text, "_clean", "python", extra)
    python = python.withColumn("_r", repair_udf(F.col(text), F.col("_clean")))
    kind = "array<struct<line:int,message:string,suggestion:string>>"
    other = cleaned(own.where("_language <> 'python'"), text, "_clean", "other", extra)
    hint = F.array(F.struct(F.lit(0).alias("line"), F.lit("Empty input").alias("message"), F.lit("Provide non-empty code text").alias("suggestion")))
    result = F.struct(
        F.when(empty, F.lit("")).otherwise(F.col("_clean")).alias("corrected"),
        (~empty).alias("ok"),
        F.when(empty, hint).otherwise(F.lit(None)).cast(kind).alias("diagnostics"),
    )
    out = [*df.columns, "_r.corrected", "_r.ok", "_r.diagnostics"]
    return python.select(*out).unionByName(other.withColumn("_r", result).select(*out))
