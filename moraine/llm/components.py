"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import Scratch, size_of

#: A node is crowded beyond this number of edges and this share of all edge ends.
CROWD, CROWDS = 256, 1024


def components(edges: DataFrame, name: str = "components", rounds: int = 60, within: int | None = None) -> DataFrame:
    """Smallest member of each node's component.

    ``edges`` has columns ``u`` and ``v`` of one orderable type, in any direction; null ends and loops are ignored, repeated
    edges are merged.  Returns ``node`` and ``component`` for every node of an edge (an empty table for no edges).  Each
    round is an aggregation and a join, its table is written to the shared folder; a round's stars move every label to the
    smallest neighbour, so the number of rounds grows with the logarithm of the longest path.

    The edges of a node that has more than ``CROWD`` of them and more than one in ``CROWDS`` of all edge ends never meet in
    one task: its smallest neighbour, aggregated by parts, goes to where they are.  There are fewer than ``CROWDS`` such nodes.
    """
    scratch = Scratch(edges.sparkSession, name)
    now = scratch.put(_ordered(edges), within)
    within = size_of(now)  # rounds merge edges, they make none
    for _ in range(rounds):
        settled, crowded = _state(now)
        if settled:
            break
        now = scratch.put(_small_star(_large_star(now, crowded), crowded), within)
        scratch.keep_last()
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    low = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(low.distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end ``u`` to its smaller end ``v``."""
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple[bool, DataFrame | None]:
    """Whether every node is a centre or has one centre (then the centres are the components), and the crowded nodes.

    Crowded nodes reach the driver: each takes more than a share of 1 / ``CROWDS`` of the edge ends, which bounds their number.
    """
    high = F.col("v") < F.col("u")
    own = _both(edges).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.count_if(high).alias("low"))
    open_ends = (F.col("low") > 1) | ((F.col("low") > 0) & (F.col("n") > F.col("low")))
    limit = max(CROWD, 2 * edges.count() // CROWDS)
    found = own.agg(F.count_if(open_ends).alias("open"), F.collect_list(F.when(F.col("n") > limit, F.col("u"))).alias("crowded")).first()
    if not found["open"] or not found["crowded"]:
        return not found["open"], None
    return False, edges.sparkSession.createDataFrame([(u,) for u in found["crowded"]], StructType([edges.schema["u"]]))


def _beside_lows(edges: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """Every edge with ``low``, the smallest ``v`` of its ``u``; edges of crowded nodes stay where they are."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    if crowded is None:
        return edges.join(low, "u")
    few = F.broadcast(crowded)
    lows = edges.join(few, "u", "left_semi").groupBy("u").agg(F.min("v").alias("low"))
    others = edges.join(few, "u", "left_anti").join(low, "u")
    return others.unionByName(edges.join(F.broadcast(lows), "u"))


def _large_star(edges: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """Every larger neighbour of a node points to the node's smallest neighbour (or the node itself)."""
    moved = _beside_lows(_both(edges), crowded).where(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.least("u", "low").alias("v"))


def _small_star(edges: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """Every smaller neighbour of a node, and the node, point to the smallest of them.

    A node has no more edges to smaller ones here than it had edges before the large star, so the same nodes are crowded.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = _beside_lows(edges, crowded).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return _ordered(moved.unionByName(low.select("u", F.col("low").alias("v"))))
