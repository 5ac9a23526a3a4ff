"""Connected components of a large sparse graph, by rounds of large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribe.llm.common import materialise, partitions

#: Edges that are reduced to a forest at a time.
CHUNK = 1 << 20


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes by links a-b."""
    labels = np.arange(n)
    while len(a):
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while (labels[labels] != labels).any():
            labels = labels[labels]
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]
    return labels


def forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: of each CHUNK of edges a star for each connected set, its centre the least node: no more edges than nodes."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        names, of = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        labels = least_labels(len(names), *of.reshape(2, -1))
        moved = np.flatnonzero(labels != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[labels[moved]])], ["u", "v"])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        size += batch.num_rows
        if size >= CHUNK:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge; root is the smallest node it can reach. edges: u, v long, any order.

    Edges meet by their u first (the member of a star, so that hubs are spread), and each task keeps a forest of its own: a group whose members met in many
    places is as many edges as members from then on, but for its few centres.
    A round links each node's larger neighbours to its smallest one, then likewise the smaller ones; each round is a
    written table. Hubs are met by sums and joins on a unique side alone, so no task gathers a hub's neighbours.
    It ends when a round changes nothing: then every edge leads from a node to its root.
    """
    whole = edges.where("u <> v").select("u", "v").repartition(partitions(edges.sparkSession), "u").mapInArrow(forest_rows, "u long, v long")
    held = materialise(whole.distinct(), "edges")
    seen = _mark(held)
    while seen[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        held = materialise(small.where("u <> v").distinct(), "edges")
        now = _mark(held)
        if now == seen:
            break
        seen = now
    roots = held.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Tells one set of edges from another."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("u", "v"))).first()
    return tuple(row)
