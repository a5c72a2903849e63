"""Connected components by deterministic Boruvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenset.scratch import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other"))))).select("col.*")


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(``node``, ``component``) for every node of an edge; ``component`` is the smallest node id linked to it.

    ``u`` and ``v`` are 64-bit ids. Edges with a NULL end, loops, repeated and reversed edges
    change nothing; a node that has only such edges does not appear. No edges give no rows.
    Extra columns are ignored.

    Each round, every component selects its smallest outgoing edge. Edges are ordered by
    their smaller end and then by their larger one, so the choice of a component is its
    smallest neighbour, which one map-side combined ``min`` finds even at a hub. Choices
    form trees whose only cycles are mutual choices; the smaller end of such a pair is
    the root. Pointer doubling collapses the trees, edges are relabelled by root and
    deduplicated, and the rounds end when no edge is left. Their number is at most the
    binary logarithm of the number of nodes, as every component at least doubles.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    rest_seen = Observation()
    rest = scratch.write(_canonical(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null")).observe(rest_seen, F.count(F.lit(1)).alias("n")), "edges0")
    left, level = rest_seen.get["n"], 0
    roots: list[DataFrame] = []
    while left:
        choice = _both_ways(rest).groupBy("node").agg(F.min("other").alias("parent"))
        trees, step = scratch.write(choice, f"tree{level}_0"), 0
        moving = True
        while moving:
            up = trees.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            target = F.when((F.col("above") == F.col("node")), F.least("node", "parent")).otherwise(F.col("above")) if step == 0 else F.col("above")
            seen = Observation()
            jumped = trees.join(up, "parent").select("node", target.alias("parent"), (F.col("parent") != target).alias("moved"))
            nxt = scratch.write(jumped.observe(seen, F.max("moved").alias("moved")), f"tree{level}_{step + 1}").drop("moved")
            moving = bool(seen.get["moved"]) or step == 0
            scratch.drop(f"tree{level}_{step}")
            trees, step = nxt, step + 1
        a, b = (trees.select(F.col("node").alias(x), F.col("parent").alias(f"root_{x}")) for x in ("u", "v"))
        relabelled = rest.join(a, "u").join(b, "v").select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
        seen = Observation()
        nxt = scratch.write(_canonical(relabelled).observe(seen, F.count(F.lit(1)).alias("n")), f"edges{level + 1}")
        left = seen.get["n"]
        scratch.drop(f"edges{level}")
        rest, level = nxt, level + 1
        roots.append(trees)
    if not roots:
        return rest.select(F.col("u").alias("node"), F.col("v").alias("component")).where("false")
    # From the last round back: each map is smaller than the one before it.
    named = roots[-1].withColumnRenamed("parent", "component")
    for r in reversed(roots[:-1]):
        named = r.join(named.withColumnRenamed("node", "parent"), "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
    # Roots follow the hooking, so the smallest member still has to name the component.
    smallest = named.groupBy("component").agg(F.min("node").alias("least"))
    return named.join(smallest, "component").select("node", F.col("least").alias("component"))
