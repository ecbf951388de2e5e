"""Connected components of an edge table.

Edges are first thinned to a forest inside each partition. A table of at most
``one_task`` edges is then solved in one task; a larger one by alternating
large-star and small-star rounds, each written to the shared folder. Both give
each node the least node of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

ONE_TASK = 2_000_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and for each the least node that it is joined to."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        high = np.maximum(label[x], label[y])
        open_ = low != high
        if not open_.any():
            break
        x, y, low, high = x[open_], y[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return nodes, nodes[label]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 1_000_000:
            b, a = least_labels(a, b)
    if len(a):
        node, root = least_labels(a, b)
        keep = node != root
        for k in range(0, int(keep.sum()), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(root[keep][k : k + 100_000]), pa.array(node[keep][k : k + 100_000])], ["a", "b"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node that is not itself the least of its component.

    edges: two bigint columns; direction, repeats and loops don't matter, and
    edges with a null end are left out. Without edges the result is empty.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).filter("a <> b")
    edges = written(edges.mapInArrow(_forest, "a bigint, b bigint"), "edges")
    if edges.count() <= one_task:
        return written(edges.repartition(1).mapInArrow(_forest, "a bigint, b bigint"), "components").select(F.col("b").alias("node"), F.col("a").alias("root"))
    before = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = written(small.filter("a <> b").distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
