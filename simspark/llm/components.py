"""Connected components of link tables, without gathering links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simspark.llm.common import Workspace


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        live = x != y
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def forest(edges: DataFrame) -> DataFrame:
    """Links (src > dst) that join the same nodes as `edges`, at most one for each node of an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = np.unique(np.concatenate([np.asarray(batch.column(0)), np.asarray(batch.column(1))]), return_inverse=True)
            at = at.ravel()
            root = local_roots(len(ids), at[: batch.num_rows], at[batch.num_rows :])
            moved = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["src", "dst"])

    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null").mapInArrow(run, "src long, dst long")


def connected_components(ws: Workspace, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(id, component) of each node of edges (src, dst): component is the smallest id it reaches; nodes that are their own aren't listed.

    Alternates large-star and small-star steps: each node hooks its larger neighbours, then its smaller ones, to the smallest
    it sees, until nothing changes. A hub only meets its partial minimum in the aggregate, and its join can be split.
    """
    now = ws.save(forest(edges).distinct(), f"{tag}-0")
    state, step = None, 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.min("src")).first()
        if seen == state or not seen[0]:
            return now.select(F.col("src").alias("id"), F.col("dst").alias("component"))
        state, step = seen, step + 1
        # large star: the larger neighbours of a node go to the smallest it sees
        low = now.select(F.col("src").alias("dst"), F.col("dst").alias("m")).groupBy("dst").agg(F.min("m").alias("m"))
        hooked = now.join(low, "dst", "left").select("src", F.coalesce("m", "dst").alias("dst"))
        # small star: the smaller ones go there too
        least = hooked.groupBy("src").agg(F.min("dst").alias("m"))
        both = hooked.join(least, "src").select(F.explode(F.array(F.struct(F.col("src").alias("src"), F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e")).select("e.*").where("src <> dst")
        now = ws.save(both.distinct(), f"{tag}-{step}")
        ws.drop(f"{tag}-{step - 1}")
