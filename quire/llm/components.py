"""Connected components of an undirected link table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored

#: Links that a task contracts at once.
CHUNK = 500_000


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (each at or below its member) after the links a-b have joined their groups."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars around the least node of each group, ``CHUNK`` links at a time."""
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        rows = np.concatenate(held)
        nodes, at = np.unique(rows, return_inverse=True)
        at = at.reshape(-1, 2)
        root = joined(np.arange(len(nodes)), at[:, 0], at[:, 1])
        low = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[low]), pa.array(nodes[root[low]])], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]))
            size += batch.num_rows
        if size >= CHUNK:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def contracted(links: DataFrame) -> DataFrame:
    """The same groups with fewer links: each task replaces its own by stars; nothing is shuffled."""
    return mapped(links, _contract, "a bigint, b bigint")


def _star(links: DataFrame, smaller: bool) -> DataFrame:
    """Hang the neighbours of every node on the least of them.

    ``smaller`` keeps to neighbours below the node (small star); else the
    neighbours above it are hung (large star). The least neighbour comes from a partial aggregate; a
    hub's links meet it in a join, whose skewed partitions Spark splits.
    """
    if smaller:
        out = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        out = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = out.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = out.join(least, "a")
    if smaller:
        hung = met.select(F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("e"), "m")
        hung = hung.select(F.col("e.x").alias("a"), F.col("m").alias("b"))
    else:
        hung = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.filter(F.col("a") != F.col("b"))


def _settled(links: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root hangs on another."""
    none = F.lit(None).cast("bigint")
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("up"), F.lit(0).alias("holds")), F.struct(F.col("b").alias("x"), none.alias("up"), F.lit(1).alias("holds"))))
    nodes = links.select(ends.alias("e")).groupBy("e.x").agg(F.min("e.up").alias("low"), F.max("e.up").alias("high"), F.max("e.holds").alias("holds"))
    return nodes.filter("low <> high OR (low IS NOT NULL AND holds = 1)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link; root: the least node reachable.

    Loops and repeated links are harmless; null ends are left out; no link gives an empty table. Each
    round is written to the shared folder, so a lost executor costs one round. Tasks contract what
    they hold before and after each round, so few rounds are needed.
    """
    own = links.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().filter(F.col("a") != F.col("b"))
    now = stored(contracted(stored(own, "links")), "star")  # links may come from Python: one worker a task
    while not _settled(now):
        now = stored(contracted(_star(_star(now, False), True)), "star")
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root"))))
    return now.select(ends.alias("e")).select("e.node", "e.root").distinct()
