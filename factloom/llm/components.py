"""Connected components of an edge table: in one task where it is small, else by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, map_arrow

#: Edges that one task of a round takes; small graphs don't need as many tasks as the tables they came from.
EDGES_A_TASK = 100_000

#: Up to so many edges one task holds all nodes; rounds of joins cost the driver dozens of jobs, however small the graph (55 in the test, where one task needs 8 at most).
LOCAL_EDGES = 200_000

#: Types that Python orders like Spark.
_LOCAL_TYPES = ("int", "bigint", "string")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges -> node, component. Null isn't linked with anything."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b and a is not None and b is not None:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], ["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """edges (a, b) of one orderable type -> (node, component), component the smallest node reachable.

    Self-loops keep a node in the result. Up to local_edges rows, a bounded number, go to one task. Beyond, each round pre-aggregates the smallest
    neighbour and joins it back; the edges of one node, two ids each, then meet in one task's sorted rows, but no task holds them at once. Rounds are
    checkpointed, and their number grows with the logarithm of the longest path.
    """
    kind = edges.schema["a"].dataType
    edges = cut(edges.select("a", "b"))
    n = edges.count()
    if n <= local_edges and kind.simpleString() in _LOCAL_TYPES and edges.schema["b"].dataType == kind:
        return cut(map_arrow(edges.coalesce(1), _forest, f"node {kind.simpleString()}, component {kind.simpleString()}"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    mark = None
    for _ in range(max_rounds):
        tasks = n // EDGES_A_TASK + 1
        now = now.coalesce(tasks)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(tasks).distinct().coalesce(tasks)
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        turned = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = cut(turned.where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        n, mark = seen[0], seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").cast(kind).alias("component"))
