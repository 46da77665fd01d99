"""Connected components by linking to hubs in turns, as joins and aggregates over the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_trust.sources.artifacts import cut

MAX_ROUNDS = 50
# At most this many edges count as few, see ``components``; a broadcast row has 16 bytes.
FEW_EDGES = 100_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _to_hub(pairs: DataFrame, larger: bool, few: bool) -> DataFrame:
    """Link neighbours of every u to the smallest of u and its neighbours: the larger ones, or u and the smaller ones."""
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(F.broadcast(smallest) if few else smallest, "u")
    if larger:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(smallest.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest id reachable from every id in ``edges`` (u, v): columns id, component.

    Every round moves all neighbours of an id to its smallest neighbour, first the larger and then the smaller ones;
    it ends when every edge leads to its component's hub. Edges are aggregated before they are joined, and a hot id's edges are spread by
    skewed joins, so no id's neighbours need to fit into one task. Loops, repeated edges and nulls change nothing.

    Few edges are not shuffled for the joins and stored in few files: a round then is a matter of jobs and tasks, which
    take the driver's threads and memory.
    """
    current = cut(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    files = edges.sparkSession.sparkContext.defaultParallelism
    few = current.count() <= FEW_EDGES
    state = None
    for _ in range(MAX_ROUNDS):
        large = _to_hub(_both_ways(current), True, few)
        small = _to_hub(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False, few)
        current = cut(small.coalesce(files) if few else small, "edges")
        mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
        new = current.agg(F.count("*"), F.sum(mixed)).first()
        if new == state:
            return current.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = new
    raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
