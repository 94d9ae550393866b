"""Connected components: union-find within each task, then large-star and small-star rounds between them.

A round first replaces the links that a task holds by stars, then shares what tasks found
by pre-aggregated minima and equi-joins that adaptive execution can split.  Tables are
read by as many tasks as their rows ask for, so a small one needs no shuffle.  Links are
written to the shared folder after each round; nothing but a count reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.store import Store

#: Links that a task holds at once.
EDGES = 100_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that the links join to a smaller one, and the smallest it is joined to."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        x, y = up[a], up[b]
        if np.array_equal(x, y):
            break
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, up[up]):
            up = up[up]
    below = np.flatnonzero(up < np.arange(len(ids)))
    return ids[below], ids[up[below]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(u, v)], ["u", "v"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) > 2 * EDGES:
            yield out()
            held = []
    if held:
        yield out()


def components(store: Store, edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges(u, v)``; component is the smallest node reachable.

    Self-links, repeated links and nulls are harmless; an empty input gives an empty result.
    """
    now = store.put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        tasks = 1 + now.count() // EDGES
        after = store.put(now.coalesce(tasks).mapInArrow(_contract, "u long, v long"), "stars")
        store.drop(now)
        now = after.coalesce(tasks)
        # Done when every smaller end is a root, that is, no larger end of another link, and every larger end has one.
        ends = now.groupBy("u").agg(F.countDistinct("v").alias("roots"))
        below = now.select("v").join(ends.select(F.col("u").alias("v")), "v", "left_semi")
        if below.unionByName(ends.where("roots > 1").select(F.col("u").alias("v"))).isEmpty():
            break
        now = store.put(_small(_large(now)).coalesce(tasks), "edges")
        store.drop(after)
    once = after.distinct() if tasks > 1 else after
    roots = after.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return once.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
