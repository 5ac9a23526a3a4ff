"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup (verified by shingles), secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
reads again as the next stage's docs. All but the last return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scribe.llm import exact_dedup, near_copies, packing, secrets, toxicity
from scribe.llm.common import materialise, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_copies.stage),
    ("secret_scan", secrets.stage),
    ("packing", packing.stage),
]

#: Training a classifier, tokenising and solving least squares are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
