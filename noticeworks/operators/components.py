"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.tables import Stored, store


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """One step on edges (u, v): large-star links greater neighbours to the least one, small-star the lesser ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    # A join, not a window: a hub's edges are then spread by the skew join.
    linked = both.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> Stored:
    """(u, v): each node that has an edge and is not its component's least node, with that least node.

    ``edges`` has columns u and v of one ordered type; null ends and loops are left out. Each round is written to
    the shared folder, so a lost executor costs one round at most.
    """
    kept = store(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    mark = None
    for _ in range(most_rounds):
        new = kept.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            return kept
        mark = new
        last, kept = kept, store(_star(_star(kept.df, large=True), large=False), "components")
        last.drop()
    raise RuntimeError("components did not settle")
