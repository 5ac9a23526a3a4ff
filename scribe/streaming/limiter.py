"""The admission limiter as a stateful stream: state is the admitted times within the window, dropped when a key idles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scribe.operators.limiter import MOST_REQUESTS, WINDOW_SECONDS


def admit_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", window: int = WINDOW_SECONDS, most: int = MOST_REQUESTS, evict: bool = False) -> DataFrame:
    """As the batch operator, for a stream whose batches come in order of time: key, order, allowed.

    A batch with an event of a key older than the newest that was decided before fails, as its decisions could not be those
    of the whole. evict drops the state of keys that idle for a window; it is for streams that run on, as batches go on to wait for it.
    """
    span = window * 1_000_000
    rows = events.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order).cast("long").alias("id"))

    def fold(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, newest = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        batch = pd.concat(parts).sort_values(["t", "id"])  # a key's rows may come in pieces
        if newest is not None and batch["t"].iloc[0] < newest:
            raise ValueError(f"an event of key {name[0]} is older than events decided before: batches must come in order of time")
        allowed = []
        for t in batch["t"]:
            held = [x for x in held if x > t - span]
            allowed.append(len(held) < most)
            if allowed[-1]:
                held.append(int(t))
        state.update((held, int(batch["t"].iloc[-1])))
        if evict:
            state.setTimeoutDuration(window * 1000)
        yield pd.DataFrame({"key": batch["key"].to_numpy(), "id": batch["id"].to_numpy(), "allowed": allowed})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if evict else GroupStateTimeout.NoTimeout
    out = rows.groupBy("key").applyInPandasWithState(fold, "key long, id long, allowed boolean", "held array<long>, newest long", "append", timeout)
    return out.select(F.col("key").alias(key), F.col("id").alias(order), "allowed")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what its source holds; returns what it wrote."""
    spark = stream.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # state beyond the heap
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
