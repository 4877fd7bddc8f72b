"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import stage


def _least(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, itself included."""
    return edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select(
        "u", F.least("u", "m").alias("m"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for every node of an edge (a, b).

    Stars are built in turn over larger and over smaller neighbours until the edges stay the
    same; every round is written to the shared folder. Nodes may be of any orderable type.
    """
    edges = stage(edges.filter("a <> b").distinct(), "edges")
    last = None
    while True:
        both = _both_ways(edges)
        large = both.join(_least(both), F.col("a") == F.col("u")).filter("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = _least(down)
        small = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"),
                                                                F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = stage(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots).groupBy("node").agg(F.min("root").alias("root"))
