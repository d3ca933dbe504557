"""Connected components of a graph given as a table of edges.

Each round joins every node's neighbours to the smallest of them, first the larger ones, then the smaller ones (alternating
large-star and small-star), after a union-find within each partition has shortened what it holds. A node of very many edges meets its
smallest neighbour in the map tasks, so no task reads all edges of a hub. Rounds are written to the shared folder, so no lineage grows,
each in place of the one before, and nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

EDGE = "a long, b long"
#: A node with more than 1 / HUBS of all edges, and over HUB_ROWS, is a hub. Every edge counts for two nodes at most, so there are 2 * HUBS hubs at most.
HUBS, HUB_ROWS = 1_000, 1_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph of these edges, without the smallest's own."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:  # min-label hooking with pointer jumping
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list = []
    n = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return stars(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n > 2_000_000:  # what stays is at most one edge a node
            a, b = merged()
            held, n = [], 0
    a, b = merged()
    for i in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], ["a", "b"])


def with_low(edges: DataFrame, low: DataFrame, rows: int) -> DataFrame:
    """The rows of edges (a, b), of which there are at most ``2 * rows``, with their a's low from ``low`` (a, low, n: its number of edges).

    Hubs' lows are broadcast (2 * HUBS rows at most); other nodes' edges meet them by a shuffle.
    """
    hub = F.col("n") > max(HUB_ROWS, rows // HUBS)
    hubs = F.broadcast(low.where(hub).select("a", "low"))
    rest = edges.join(F.broadcast(low.where(hub).select("a")), "a", "left_anti").join(low.where(~hub).select("a", "low"), "a")
    return edges.join(hubs, "a").select("a", "b", "low").unionAll(rest.select("a", "b", "low"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected with, itself included) of every node in an edge (a, b)."""
    now = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInArrow(_shortened, EDGE)
    now = written(now, "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
    before = mark(now)
    while before[0]:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).select("a", F.least("a", "low").alias("low"), "n")
        large = with_low(both.where("b > a"), low, before[0]).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        down = with_low(large, least, before[0])
        small = down.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(least.select("a", F.col("low").alias("b")))
        last, now = now, written(small.distinct(), "edges")
        after = mark(now)
        discard(last)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
