"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import stage


LINKS_PER_TASK = 50_000


def _digest(edges: DataFrame) -> tuple:
    """(links, a sum over them) to tell when a round has changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of a link and the least node that it reaches.

    Each round hangs a node's larger neighbours, then its smaller ones, on the least of them;
    rounds grow with the logarithm of the longest path.  Every round is a written table, so a
    lost executor costs one round, and nothing but counts reaches the driver.  Links to itself
    and repeated links are allowed; without links there is no row.
    """
    edges = stage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "links")
    before, now = None, _digest(edges)
    while now != before:
        before = now
        # tasks follow the number of links, so that few links don't pay for many empty tasks
        tasks = 4 + now[0] // LINKS_PER_TASK
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        # after the large star every link points to a smaller node
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u"))).coalesce(tasks)
        small = small.select("u", F.col("m").alias("v")).union(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = stage(small.distinct().coalesce(tasks), "star")
        now = _digest(edges)
    out = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return out.union(roots)
