"""Connected components of a graph by alternating large-star and small-star."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import settled_step


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join each node's neighbours to the least of them; ``edges`` has each edge once, u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.where("v > u") if large else both
    moved = near.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (u, v)``; a component is named by its least node.

    Loops, repeated edges and either direction are allowed. Minima are pre-aggregated, so a node
    with any number of neighbours is no hot spot; every round is written to the shared folder. No join is
    by broadcast, so rounds over few edges don't fill the driver's memory with relations.
    """
    now = settled_step(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = settled_step(_star(_star(now, large=True), large=False), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
