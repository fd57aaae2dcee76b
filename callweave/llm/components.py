"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots themselves, from links (a, b); root is the smallest node of the component.

    Each round links larger neighbours to the smallest one (large star), then smaller ones (small star), until nothing changes.
    The number of rows never grows, minima are taken before the shuffle, and joins on a busy node are split by the adaptive
    planner; each round is written out, so a lost executor costs a round at most.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    edges = cut(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = cut(large, "large")
        down = large.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("_hi"), "m")
        moved = large.join(down, F.col("hi") == F.col("_hi")).select("lo", "m").where("lo <> m")
        small = down.select(F.col("_hi").alias("hi"), F.col("m").alias("lo")).union(moved.toDF("hi", "lo")).distinct()
        edges, before = cut(small, "small"), state
        state = _state(edges)
        if state == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
