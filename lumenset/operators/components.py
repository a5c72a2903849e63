"""Connected components for the curation stages, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenset.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours point to the smallest of its neighbourhood. Small star: its smaller neighbours and itself do."""
    ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = ways.join(least, "u").select(F.col("v").alias("a"), "m", "u")
    out = moved.where("a > u").select(F.col("a").alias("u"), F.col("m").alias("v")) if large else moved.select(F.col("a").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(``node``, ``component``) for every node of an edge; ``component`` is the smallest node linked to it.

    Works on any comparable type. NULL ends and loops are ignored; no edges give no rows.
    The rounds, about log(n) of them, end when the edges no longer change.
    """
    scratch = Scratch(edges.sparkSession, "stars")
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    count, step = None, 0
    while True:
        seen = Observation()
        nxt = _star(_star(now, True), False)
        nxt = scratch.write(nxt.observe(seen, F.count(F.lit(1)).alias("n")), f"edges{step}")
        n = seen.get["n"]
        same = n == count and nxt.join(now, ["u", "v"], "left_anti").isEmpty()  # as many and none new: the same edges
        if step:
            scratch.drop(f"edges{step - 1}")
        if same:
            break
        now, count, step = nxt, n, step + 1
    return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(nxt.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
