"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.storage import cut


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours and itself to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = low.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).where("u <> v").distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``; component is the smallest node.

    Direction, repeated edges and extra columns do not matter. A loop names a node
    of its own. Edges with a null end are ignored; no edges give no row. Rounds end
    when the edge set no longer changes, after O(log n) of them in practice; each
    round's edges are written to the shared folder.
    """
    given = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.col("a").alias("u"), F.col("b").alias("v"))
    given = cut(given.distinct())
    e, state = given.where("u <> v"), None
    for _ in range(max_rounds):
        e = cut(_small_star(_large_star(e)))
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
