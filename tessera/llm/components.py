"""Connected components of an edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.shared import parts_of, written

#: Edges that one task takes at a time, about 200 bytes each.
SINGLE_TASK_EDGES = 500_000


def _forest(it):
    """Replaces the edges of a partition by a star for each of their components; the least node is its centre."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top and y != x:
            up[x] = top
            x = y
        return top

    for batch in it:
        for a, b in zip(batch.column("a").to_numpy(), batch.column("b").to_numpy(), strict=True):
            a, b = root(int(a)), root(int(b))
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for at in range(0, len(nodes), 100_000):
        some = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["a", "b"])


def _contracted(edges: DataFrame, parts: int | None = None) -> DataFrame:
    if parts:
        edges = edges.coalesce(parts)
    return edges.mapInArrow(tb.trimmed(_forest), "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    lower = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, single_task_edges: int = SINGLE_TASK_EDGES) -> DataFrame:
    """(node, component) for every node of edges(a long, b long); a component is named by its least node.

    Each task first replaces its own edges by a spanning forest, and again with
    fewer tasks of up to single_task_edges as long as that leaves out a fifth of
    them. What is left goes through one union-find task if there are at most
    single_task_edges of them, and through rounds of large-star and small-star
    otherwise; both give the same result. Edges with a null are ignored; a node
    with an edge to itself alone is not listed; no edges give no rows.
    """
    spark = edges.sparkSession
    edges = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = written(_contracted(edges), "edges")
    count, before = now.count(), None
    while count > max(1, single_task_edges) and (before is None or count < 0.8 * before):
        before, now = count, written(_contracted(now, -(-count // max(1000, single_task_edges))), "edges")
        count = now.count()
    if count <= single_task_edges:
        stars = written(_contracted(now, 1), "edges")
    else:
        seen = None
        while True:
            stars = written(_small_star(_large_star(now)), "edges")
            said = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
            if said == seen:
                break
            seen, now = said, stars
    stars = stars.repartition(parts_of(spark), "b")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
