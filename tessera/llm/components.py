"""Connected components of a graph given as links, by alternating large and small stars.

Each round hooks every node's larger neighbours to its smallest one, by a combinable minimum and a join whose hot keys
the engine splits; no node's neighbours are ever collected. The graph never leaves the executors: the driver sees two
sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, saved


def _hooked(edges: DataFrame, larger_only: bool) -> DataFrame:
    """From edges u, v: every neighbour v of u that is larger than u (or any) linked to the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if larger_only:
        return edges.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: each node of a link with the smallest node that it reaches. Nulls, loops and repeats don't matter."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges, before = saved(edges), None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not mark.n or mark == before:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hooked(both, True).filter("u > v").distinct()
        done, edges = edges, saved(_hooked(large, False).filter("u > v").distinct())
        forget(done)
    # the last edges go when no plan reads them any more
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
