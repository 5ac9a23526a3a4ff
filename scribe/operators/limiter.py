"""Sliding-window admission: at most so many admitted requests of a key in a window; denied ones count for nothing.

The fold is sequential within a key and parallel across keys. A key's rows come sorted by a secondary sort and stream
through mapInArrow in constant memory (the admitted times within the window), so that a hot key is long but never large.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds, requests.
WINDOW_SECONDS, MOST_REQUESTS = 60, 10


def admitted(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", window: int = WINDOW_SECONDS, most: int = MOST_REQUESTS) -> DataFrame:
    """key, order, allowed for each event, in the order (ts, order); an admission exactly window old has left."""
    spark = events.sparkSession
    plain = {c: F.col(c) if events.schema[c].dataType.simpleString() == "string" else F.col(c).cast("long") for c in (key, order)}
    rows = events.select(plain[key].alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), plain[order].alias("id"))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "t", "id")
    span = window * 1_000_000

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = object(), deque()
        for batch in batches:
            keys, times = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = np.zeros(len(keys), bool)
            for i, (k, t) in enumerate(zip(keys, times)):
                if k != last:
                    last, held = k, deque()
                while held and held[0] <= t - span:
                    held.popleft()
                if len(held) < most:
                    held.append(t)
                    out[i] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], ["key", "id", "allowed"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = dealt.mapInArrow(fold, f"key {kind['key']}, id {kind['id']}, allowed boolean")
    return out.select(F.col("key").alias(key), F.col("id").alias(order), "allowed")
