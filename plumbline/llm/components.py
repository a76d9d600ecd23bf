"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import drop_written, written


#: Edges of a node up to which they stay together, and how many nodes may have more at most.
LIGHT, HEAVY = 100, 1024


def _folded(edges: DataFrame) -> tuple[DataFrame, tuple]:
    out = written(edges, "edges")
    row = out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return out, tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for each node of ``edges`` (u long, v long).

    Large-star and small-star rounds: every round each node hands its larger (then its
    smaller) neighbours to its least neighbour, until each component is a star around its
    least node.  A node of many edges is aggregated map-side for its minimum; its edges are dealt by
    neighbour over several tasks before they meet it.  Nothing is collected.  Loops and repeated
    edges don't matter.
    """
    # u > v always: v is nearer to the root.
    edges, seen = _folded(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        most = max(LIGHT, 2 * seen[0] // HEAVY)
        heavy = F.broadcast(least.where(F.col("n") > most).select("u", F.ceil(F.col("n") / most).alias("parts")))  # fewer than HEAVY rows
        parts = F.coalesce("parts", F.lit(1))
        outer = both.where("v > u").join(heavy, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), parts).alias("part"))
        inner = least.join(heavy, "u", "left").select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        large = outer.join(inner, ["u", "part"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v")))
        now, mark = _folded(small.distinct())
        drop_written(edges)
        edges = now
        if mark == seen:
            break
        seen = mark
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
