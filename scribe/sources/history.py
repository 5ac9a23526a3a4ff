"""The evaluation history: a Parquet table that is appended to, listed newest first, and looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns, and how much of each text is kept.
SCHEMA = (
    T.StructType()
    .add("request_id", T.StringType()).add("timestamp", T.TimestampType()).add("execution_status", T.StringType()).add("processing_time", T.DoubleType())
    .add("recognized_text", T.StringType()).add("corrected_text", T.StringType()).add("stdout", T.StringType()).add("stderr", T.StringType())
    .add("auto_corrected", T.IntegerType()).add("language", T.StringType()).add("sandbox_mode", T.StringType())
)
KEPT, TOP = 500, 20


def kept(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, KEPT)


def log_rows(responses: DataFrame, now: Column | None = None) -> DataFrame:
    """Responses as history rows: texts cut, flags as numbers, defaults filled."""
    return responses.select(
        "request_id",
        (F.current_timestamp() if now is None else now).alias("timestamp"),
        "execution_status",
        F.bround("processing_time", 2).alias("processing_time"),
        *(kept(F.col(c)).alias(c) for c in ("recognized_text", "corrected_text", "stdout", "stderr")),
        F.col("auto_corrected").cast("int").alias("auto_corrected"),
        F.coalesce("language", F.lit("python")).alias("language"),
        F.coalesce("sandbox_mode", F.lit("subprocess")).alias("sandbox_mode"),
    )


def new_rows(history: DataFrame, rows: DataFrame, *order: Column) -> DataFrame:
    """Of rows, the first of each request_id (by order, else by timestamp) that history lacks: the first write wins."""
    first = W.partitionBy("request_id").orderBy(*(order or ("timestamp",)))
    once = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.join(history.select("request_id"), "request_id", "left_anti")


def create(spark: SparkSession, path: str) -> DataFrame:
    """The table, made empty where there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def append(spark: SparkSession, path: str, rows: DataFrame, *order: Column) -> None:
    """Appends the rows that are new. For one writer at a time: it reads, then writes, without a lock."""
    new_rows(create(spark, path), rows, *order).select(*SCHEMA.names).write.mode("append").parquet(path)


def recent(history: DataFrame, n: int = TOP) -> DataFrame:
    """The newest n; ties by request_id."""
    return history.orderBy(F.desc("timestamp"), "request_id").limit(n)


def lookup(history: DataFrame, request_id: str) -> DataFrame:
    return history.where(F.col("request_id") == request_id).limit(1)


def envelope(rows: DataFrame) -> DataFrame:
    """One row: the rows as JSON with their count. For the few rows that recent() gives."""
    return rows.agg(F.to_json(F.struct(F.collect_list(F.struct(*rows.columns)).alias("evaluations"), F.count("*").alias("count"))).alias("body"))
