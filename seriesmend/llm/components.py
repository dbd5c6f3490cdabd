"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesmend.plans.staging import stage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of any sortable type -> (node, component), component the smallest node.

    Alternates large-star (link all larger neighbours to the smallest one) and
    small-star (link the smaller ones to the smallest), until every link is (node,
    smallest node).  Links point downwards, so both are a grouped minimum and a join of
    the links with it.  A hub is never gathered: its minimum is a partial aggregate,
    and its links are one side of a join whose other side has one row per node.  Nodes
    without links are not in the result.
    """
    links = stage(_downward(links).distinct())
    while not _settled(links):
        # a node without smaller neighbours is the smallest one itself
        lowest = _least(links).withColumnRenamed("a", "b")
        large = links.join(lowest, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        least = _least(large)
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stage(least.toDF("a", "b").unionAll(small).distinct())
    roots = links.select(F.col("b").alias("node")).distinct()
    return (
        links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .unionAll(roots.select("node", F.col("node").alias("component")))
    )


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more ``links`` (a, b): only those between two components
    are worked on, and by component."""
    across = stage(_downward(between(found, links).select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).distinct())
    if across.isEmpty():
        return found
    # the smallest of the components' smallest nodes is that of their union
    merged = components(across)
    known = found.join(merged.toDF("component", "whole"), "component", "left").select(
        "node", F.coalesce("whole", "component").alias("component"))
    return stage(known.unionAll(merged.join(found.select("node"), "node", "left_anti")))


def between(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components, with both components
    (of_a, of_b); a node that is not in ``found`` is its own."""
    ends = [found.toDF(c, f"of_{c}") for c in "ab"]
    return pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").withColumns(
        {f"of_{c}": F.coalesce(f"of_{c}", c) for c in "ab"}).filter("of_a <> of_b")


def _downward(links: DataFrame) -> DataFrame:
    """Every link from its larger end to its smaller one, without loops."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _least(links: DataFrame) -> DataFrame:
    """(a, m): the smallest of a node's smaller neighbours."""
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _settled(links: DataFrame) -> bool:
    """Whether every node has one link downwards, to a node that has none."""
    count = lambda end, up, low: links.select(F.col(end).alias("node"), F.lit(up).alias("up"), F.lit(low).alias("low"))
    ends = count("a", 1, 0).unionAll(count("b", 0, 1)).groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return not ends.filter("up > 1 OR up > 0 AND low > 0").count()
