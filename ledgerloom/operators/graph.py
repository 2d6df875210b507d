"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import staged


def _nearest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``u``, itself included. A grouped minimum is combined before the shuffle, so a
    node with very many neighbours costs no single task their number."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.where("v > u").join(_nearest(both), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _nearest(down)
    others = down.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, limit: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge, the smallest node of its component as root.

    Edges with a null end are passed over, loops and repeated edges do no harm, an empty table gives none. Each
    round is written to the shared folder, so lost executors cost one round at most. Rounds grow with the logarithm
    of the longest path; ``limit`` only guards against endless work and raises an error rather than a wrong result.
    """
    edges = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u is not null and v is not null")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = staged(edges.where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(limit):
        now = staged(_small_star(_large_star(now)), "stars")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.count_distinct("u")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components not settled after {limit} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
