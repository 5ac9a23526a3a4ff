"""Exact dedup by a stateful stream: disk-backed keyed state, kept for ever, with full bytes compared on hits.

Digests of normalised texts go to a log in the shared folder. A structured stream reads the log and folds it by digest
into RocksDB state without watermark or expiry; the state of a digest holds the smallest identifier, its content locator
and the number of rows. A digest that several rows share is a hit: the rows' normalised texts are compared in full with
the text of the row that stays. Should texts differ under one digest, its rows are grouped by text instead.

Everything is DataFrame operations; the only Python is on the driver (foreachBatch writes each batch's changed keys).

Defined cases: a null text counts as empty; a null doc_id sorts after all others; rows repeated with the same doc_id and
text form one group of which the first logged row stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.llm.common import materialise, table, work_dir, written

#: Rows that one keeper's text is compared with in a task; larger groups are salted.
GROUP_SLICE = 256
#: Files of the log that one micro-batch takes.
FILES_PER_BATCH = 4096


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.regexp_replace(out, " {2,}", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fold_stream(spark: SparkSession, log: str, schema, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Runs the stream over all of the log; returns digest, first (missing, id, seq, locator), n."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # All instances on an executor share this much native memory; idle ones are closed soon after a stream ends.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "128")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB", "4")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else each store reserves MB of disk
    session.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "5s")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    out = work_dir(spark, "dedup-state")
    state = (
        session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log)
        .groupBy("digest")
        .agg(F.min(F.struct("missing", "id", "seq", "locator")).alias("first"), F.count("*").alias("n"))
    )

    def changed(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/changes-{number:08d}")

    changed(session.createDataFrame([], state.schema), 0)  # an empty log starts no batch
    query = state.writeStream.outputMode("update").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).foreachBatch(changed).start()
    query.awaitTermination()
    changes = spark.read.parquet(f"{out}/changes-*")
    return changes.groupBy("digest").agg(F.max_by("first", "batch").alias("first"), F.max_by("n", "batch").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (the digest), locator of the row that stays."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), F.input_file_name().alias("locator"))
    log, folder = written(own.select("id", F.col("id").isNull().alias("missing"), digest(F.col("norm")).alias("digest"), "locator", F.monotonically_increasing_id().alias("seq")), "dedup-log")
    state = materialise(fold_stream(spark, folder, log.schema, files_per_batch), "dedup-keys")

    # Hits: full bytes against the text of the row that stays, in slices of a group.
    keys = state.where("n > 1").select("digest", F.col("first.id").alias("keep"), F.ceil(F.col("n") / GROUP_SLICE).cast("int").alias("slices"))
    hits = materialise(own.select("id", "norm", digest(F.col("norm")).alias("digest")).join(keys, "digest"), "dedup-hits")
    texts = hits.where(F.col("id").eqNullSafe(F.col("keep"))).groupBy("digest").agg(F.min("norm").alias("kept_text"), F.max("slices").alias("slices"))
    texts = texts.select("digest", "kept_text", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    sliced = hits.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    clash = materialise(sliced.join(texts, ["digest", "slice"]).where("norm <> kept_text").select("digest").distinct(), "dedup-clash")

    rows = log.select("id", "digest", "seq").join(state.select("digest", "first", "n"), "digest")
    result = rows.select(F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("seq") == F.col("first.seq")).alias("kept"), F.col("digest").alias("text_sha256"), F.col("first.locator").alias("locator"))
    if not clash.take(1):
        return result
    # Different texts under one digest: their rows are grouped by the text itself.
    parted = own.select("id", "norm", "locator", digest(F.col("norm")).alias("digest"), F.monotonically_increasing_id().alias("seq")).join(clash, "digest", "left_semi")
    parted = materialise(parted, "dedup-parted")
    firsts = parted.groupBy("norm").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "seq", "locator")).alias("first"), F.count("*").alias("n"))
    again = parted.join(firsts, "norm").select(F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("seq") == F.col("first.seq")).alias("kept"), F.col("digest").alias("text_sha256"), F.col("first.locator").alias("locator"))
    return result.join(clash.select(F.col("digest").alias("text_sha256")), "text_sha256", "left_anti").unionByName(again)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("locator")


ORACLE = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the row with the smallest doc_id, once."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_digest"))
    held = docs.withColumn("_digest", sha256(normalised(F.col("text"))))
    joined = held.join(kept, held.doc_id.eqNullSafe(kept._kept_id) & (held._digest == kept._kept_digest), "left_semi")
    return joined.dropDuplicates(["doc_id", "_digest"]).select(*docs.columns)
