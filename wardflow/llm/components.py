"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.session import reliable_checkpoint, release


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node at most, which hangs on none."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.count_if((F.col("up") > 1) | (F.col("up") + F.col("down") > 1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (columns ``a``, ``b``),
    ``label`` being the smallest node reachable.

    Each step hangs the neighbours of a node on their smallest neighbour;
    first the larger ones, then the smaller ones, until only stars are left (a
    number of steps logarithmic in the table). A step groups with a partial
    minimum and joins back on the node, so a node with very many neighbours
    is one row of the grouped side. Steps are cut by written tables, and the
    table of a step is deleted once the next is written.
    """
    now = reliable_checkpoint(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # One row for each edge; rows that come twice are left to the last step.
        large = (both.filter(F.col("b") > F.col("a")).join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter(F.col("b") != F.col("m"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        after = reliable_checkpoint(small, "edges")
        release(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``labels`` (from ``components``) after further ``links``
    (columns ``a``, ``b``) between their nodes or others. Only the components
    that links connect are worked on, each as one node."""
    between = links
    for x in ("a", "b"):
        of = labels.select(F.col("node").alias(x), F.col("label").alias(f"_{x}"))
        between = between.join(of, x, "left")
    tops = components(between.select(*[F.coalesce(f"_{x}", x).alias(x) for x in ("a", "b")]))
    tops = reliable_checkpoint(tops, "tops")
    new = tops.join(labels.select("node"), "node", "left_anti")
    top = tops.select(F.col("node").alias("label"), F.col("label").alias("_top"))
    return labels.join(top, "label", "left").select("node", F.coalesce("_top", "label").alias("label")).unionByName(new)
