"""Exact ranks within groups of any size.

A window over one hot group puts that group into one task. Here the rows are
range-partitioned by group and order, so a hot group spans many partitions. Each
row is numbered within its sorted partition, and a table with one row for each
partition and group tells where the group starts there and how many rows precede.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenset.scratch import Scratch


def grouped_rank(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds ``name``: the 1-based position of each row within its group in the given order.

    The order must be total within a group (append a unique key), else equal rows are
    numbered arbitrarily. NULL group values form a group of their own. An empty input
    gives an empty result. The column ``__id`` is reserved. All columns of ``df`` are
    shuffled and written once, so rank keys only and join the rest back where rows are wide.
    """
    spark = df.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sort = [F.col(g).asc_nulls_first() for g in group] + order
    placed = df.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("__id", F.monotonically_increasing_id())
    placed = Scratch(spark, "rank").write(placed, "placed")
    part = F.shiftright("__id", 33).alias("__part")  # the id holds the partition above its lower 33 bits
    starts = placed.groupBy(*group, part).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__start"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = starts.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__part").alias("__p"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) + 1 - F.col("__start")).alias("__shift"))
    cond = part == F.col("__p")
    for g in group:
        cond = cond & placed[g].eqNullSafe(shifts[f"__{g}"])
    return placed.join(shifts, cond).select(*df.columns, (F.col("__id") + F.col("__shift")).alias(name))
