"""Connected components by alternating large and small stars over a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folio.llm.common import discard, shipped, stored


def _large(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest node near it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node, and itself, to the smallest of them; edges run from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _summed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, stored, with their number and a sum of their hashes, which the write itself counts."""
    seen = Observation()
    at = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
    return at, (seen.get["n"], seen.get["sum"])


#: Edges that a task contracts at a time.
CHUNK = 200_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges with the same components: each chunk becomes stars around the smallest nodes of the chunk's own components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def stars() -> pa.RecordBatch:
        rows = [(x, y) for x in root if (y := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], ["a", "b"])

    n = 0
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(a, b)] = min(a, b)
        n += batch.num_rows
        if n >= CHUNK:
            yield stars()
            root.clear()
            n = 0
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b); root is the smallest node of its component.

    No edges give no rows; loops and repeated edges are ignored. Tasks first contract the edges that they read, a bounded
    number at a time, which leaves the steps between tasks little to do. The edges of every other step are kept in the
    shared folder, only the last of them for long. A step's joins meet at hub nodes, whose rows AQE may split, and no
    task holds a node's neighbours together.
    """
    shipped(edges.sparkSession)
    stars = edges.where("a <> b").select("a", "b").mapInArrow(_contracted, "a long, b long")
    at, before = _summed(stars.distinct())
    while before[0]:
        last, (at, now) = at, _summed(_small(_large(at)))
        discard(last)
        if now == before:
            break
        before = now
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
