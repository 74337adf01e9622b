"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import materialise

#: Edges that a task contracts at a time; it bounds the task's memory, not the result.
LOCAL_EDGES = 1 << 20


def stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, other): the edges as stars, each vertex but the smallest of its component hung on that one."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    up = np.arange(len(ids))
    while True:
        low = np.minimum(up[x], up[y])
        new = up.copy()
        np.minimum.at(new, up[x], low)
        np.minimum.at(new, up[y], low)
        while (new != (nxt := new[new])).any():
            new = nxt
        if (new == up).all():
            break
        up = new
    hung = np.flatnonzero(up != np.arange(len(ids)))
    return ids[up[hung]], ids[hung]


def _contract(batches):
    names = ["a", "b"]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def row_batch():
        a, b = stars_of(*(np.concatenate([w[k] for w in waiting]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

    for batch in batches:
        if batch.num_rows:
            waiting.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            size += batch.num_rows
            if size >= LOCAL_EDGES:
                yield row_batch()
                waiting, size = [], 0
    if waiting:
        yield row_batch()


def _settled(links: DataFrame) -> bool:
    """Whether the edges (a, b) are stars already: every b hangs on one a, and no a hangs on anything."""
    ends = links.select(F.col("b").alias("u"), F.lit(1).alias("n")).unionAll(links.select("a", F.lit(0)))
    per = ends.groupBy("u").agg(F.sum("n").alias("n"), F.min("n").alias("low"))
    return not per.where("n > 1 or n = 1 and low = 0").limit(1).count()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(id, component): component is the smallest id that is reachable.

    Vertices are those of the edges; self loops, repeated edges and edges with a null end count
    for nothing. Each task first contracts the edges it holds to stars, which needs no shuffle. Each
    round then hangs the larger neighbours of every vertex on its smallest one and then the smaller ones
    likewise, until all edges are stars, so the number of rounds grows with the logarithm of the
    longest path. All state is an edge table in the shared folder; one row at most a round
    comes to the driver. The minimum per vertex is a partial aggregate, and the join with it is
    between two plain tables, so that hubs are split by adaptive execution.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    links = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b and a is not null")
    links = materialise(links.mapInArrow(_contract, "a long, b long").distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(links):
            break
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b"), F.col("a")))
        low = materialise(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = materialise(large, "large")
        low = materialise(large.groupBy("b").agg(F.min("a").alias("m")), "low")
        small = large.join(low, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        links = small.unionAll(low.select(F.col("m").alias("a"), "b")).where("a < b")
        links = materialise(links.mapInArrow(_contract, "a long, b long").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return links.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(roots)
