"""Connected components by alternating large-star and small-star steps, all of it joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tilewright.llm.common import join_groups, keep


def _minima(edges: DataFrame) -> DataFrame:
    """Kept, since both sides of :func:`join_groups` read it: a round is a few small plans instead of one of many copies."""
    return keep(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("_n")))


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour above u is linked with the smallest of u and its neighbours."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    linked = join_groups(both, _minima(both), "u", 2 * total).where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """u and its neighbours below it are linked with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = join_groups(down, _minima(down), "u", total)
    ends = linked.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return ends.where("u != v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v); the label is the smallest node of the component.

    Loops and repeated edges don't matter; no edges give no rows. Ends when a round leaves the edges as they are.
    """
    edges = keep(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        n, mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if (n, mark) == state or not n:
            break
        state = (n, mark)
        edges = keep(small_star(keep(large_star(edges, n)), n))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, label) of those so far and of new ``links`` (u, v) between any nodes.

    Only the links' labels go through the rounds of :func:`connected`, however many links are behind them.
    """
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    known = keep(label.unionByName(ends.join(label, "node", "left_anti").select("node", F.col("node").alias("label"))))
    between = (links.join(known.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u")
               .join(known.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v"))
    roots = connected(between.select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    total = known.count()
    sizes = keep(roots.select(F.col("node").alias("_node"), F.col("label").alias("_root")).join(
        known.groupBy(F.col("label").alias("_node")).agg(F.count(F.lit(1)).alias("_n")), "_node").withColumnRenamed("_node", "label"))
    return keep(join_groups(known, sizes, "label", total, "left").select("node", F.coalesce("_root", "label").alias("label")))
