"""Connected components of an edge table, by alternating neighbourhood contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import save, scratch


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the least of each node's neighbours and itself; ``edges`` has both directions."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` (columns a, b) with the least node it is connected to.

    Every round, each node sends its larger neighbours, then its smaller ones, to its least neighbour
    (large star and small star), which halves long chains; a round only adds minima per node, joined
    back on the node, so a hub of any degree is counted in parts and split as a skewed join. Each
    round is written to the shared folder, and the rounds end when only stars are left. Null
    ends are ignored; an empty table gives no rows.
    """
    spark = edges.sparkSession
    with scratch(spark):
        return _components(edges, most_rounds)


def _components(edges: DataFrame, most_rounds: int) -> DataFrame:
    edges = save(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    spark = edges.sparkSession
    for _ in range(most_rounds):
        edges, done = _round(spark, edges)
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # now each edge leads from a node to the root of its star
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return save(stars, "components", outlive=1)


def _round(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, bool]:
    """The edges after a large and a small star, and whether only stars are left."""
    with scratch(spark):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(_least_neighbour(both), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = save(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large-star")
        # a node's smaller neighbours are few by now: no hub on this side
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = save(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star", outlive=1)
        roots = edges.select(F.col("v").alias("_root"))
        # every edge leads from a node to a root, so these are stars
        return edges, edges.join(roots, edges["u"] == roots["_root"], "left_semi").isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty()
