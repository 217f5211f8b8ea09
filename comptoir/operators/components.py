"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comptoir.session import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """Rows (node, component) for every node of links; component is the smallest node reachable.

    Each round is two aggregations and two equi-joins of one row for each link, so a hub's links are
    split by the skew join and never meet in one task. Self links and nulls are ignored; an empty
    table of links gives no rows. Raises RuntimeError if the rounds do not suffice.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges, mark = _marked(edges)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "v")
        large = edges.join(low, "v").select("u", F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = mark
        edges, mark = _marked(small.unionByName(low.withColumnRenamed("m", "v")).where("u > v").distinct())
        if mark == before:
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = cut(edges)
    got = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return edges, (got[0], got[1])
