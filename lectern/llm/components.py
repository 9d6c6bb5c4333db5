"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every vertex's larger neighbours, then its smaller ones, move to the smallest."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(
        F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(
        F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of the links (a, b): root is the smallest vertex it reaches.

    Alternates large-star and small-star rounds, each written to the shared folder, until nothing
    moves. Both reduce before they shuffle, and a hub's rows meet one row of the other side, which
    adaptive execution can split. Links from a vertex to itself or with a null end are no links.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = written(edges, "links"), None
    while True:
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now or now[0] == 0:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("vertex"), F.col("b").alias("root"))).distinct()
        edges, before = written(_stars(edges), "stars"), now
