"""What the operators of this subpackage share: tables, the shared folder, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch that are Python objects at a time.
SLICE_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own in a local session (tests) where it is unset."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="scribe-")
        spark.conf.set("spark.checkpoint.dir", held)
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder within the shared one."""
    return f"{shared_dir(spark)}/scribe/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and returns the table, which survives lost executors."""
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, with the table's folder."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when it ends: for tables that are written once, and read from where they are written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, schema: str, rows: Callable[..., dict[str, object]], *cols: str) -> DataFrame:
    """mapInArrow over columns of df: rows(list, list, ...) gives each batch's output columns in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for batch in (part.slice(at, SLICE_ROWS) for at in range(0, part.num_rows, SLICE_ROWS)):
                out = rows(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], list(out))

    return df.select(*cols).mapInArrow(run, schema)


def least_hashes(col: str, wanted: int, total: int):
    """True for all of total rows if they are few, else for about 3 * wanted of them, those of the smallest hashes: what a
    choice of wanted rows is made from, so that no task sorts all rows."""
    if total <= 3 * wanted:
        return F.lit(True)
    return F.xxhash64(col) < F.lit(-(1 << 63) + (1 << 64) * 3 * wanted // total)


def crc_mod(col: str, modulus: int):
    """crc32 of an id's text, modulo: how held-out rows are told."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus
