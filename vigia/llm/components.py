"""Connected components of a link table, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


#: Edges that a task of a round reads at least, but for the last.
TASK_EDGES = 50_000


def components(links: DataFrame) -> DataFrame:
    """Components of an undirected graph.

    ``links``: columns ``a``, ``b`` (bigint).  Self-links and repeated links are harmless.  Returns
    ``node``, ``component`` (smallest node reachable) for each node with a link to
    another one; an empty table gives an empty table.  Each round only aggregates (min per node, combined
    before the shuffle) and joins on the node, so no component is gathered in one place.  A round runs in as many tasks
    as it has edges for: few edges in many partitions are many small files a shuffle.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    edges = cut(links.where("a <> b").select(big.alias("u"), small.alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        few = -(-2 * mark[0] // TASK_EDGES)
        edges = edges.coalesce(few)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(few)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").coalesce(few).distinct().coalesce(few)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(few).distinct().coalesce(few))
        seen, mark = mark, _mark(edges)
        if seen == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]
