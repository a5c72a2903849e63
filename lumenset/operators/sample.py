"""Quotas, caps, ordinary and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.operators.dedup import preference
from lumenset.operators.ranking import grouped_rank
from lumenset.scratch import Scratch


def _keys(rows: DataFrame) -> DataFrame:
    """What the ranks need: few narrow columns instead of whole rows."""
    return rows.select(F.col("row_idx").alias("__row"), "class_label", "dataset_source", *[c.alias(k) for k, c in preference().items()])


def _rank(keys: DataFrame, group: list[str], name: str, before: tuple[str, ...] = ()) -> DataFrame:
    return grouped_rank(keys, group, [F.col(c) for c in (*before, "k1", "k2", "k3", "k4", "k5")], name)


def _only(rows: DataFrame, picked: DataFrame) -> DataFrame:
    return rows.join(picked.select(F.col("__row").alias("row_idx")), "row_idx", "left_semi").select(*rows.columns)


def class_sample(rows: DataFrame, targets: dict[str, int], source_fraction: float | None = None) -> DataFrame:
    """The best rows of each class up to its target, preferring sources within their cap.

    The cap of a source in a class is floor(fraction * target); what exceeds it is taken only
    while the class falls short, so the cap is soft. A fraction of 0 or None caps nothing. Classes
    without a target, also NULL, are dropped. Rows without a source share one cap. ``row_idx`` must be unique.
    """
    goal = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]) if targets else F.create_map().cast("map<string,int>")
    held = _keys(rows).withColumn("__target", F.try_element_at(goal, F.coalesce("class_label", F.lit("")))).where("__target is not null")
    over = F.lit(0)
    if source_fraction:
        held = _rank(held, ["class_label", "dataset_source"], "__in_source")
        over = (F.col("__in_source") > F.floor(F.col("__target") * F.lit(source_fraction))).cast("int")
    return _only(rows, _rank(held.withColumn("__over", over), ["class_label"], "__in_class", ("__over",)).where("__in_class <= __target"))


def global_cap(rows: DataFrame, most: int | None) -> DataFrame:
    """At most ``most`` rows: each class gets its share rounded down, 1 at least, by rank; then the best of all."""
    if not most:
        return rows
    counts = rows.groupBy("class_label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    if total <= most:
        return rows
    ranked = _rank(_keys(rows), ["class_label"], "__r")
    quota = F.greatest(F.lit(1), F.floor(F.lit(most) * F.col("n") / F.lit(total)))
    within = ranked.join(counts.withColumnRenamed("class_label", "__c"), F.col("class_label").eqNullSafe(F.col("__c"))).where(F.col("__r") <= quota).select("__row", "k1", "k2", "k3", "k4", "k5")
    return _only(rows, _rank(within, [], "__all").where(F.col("__all") <= most))


def arrival_quota(rows: DataFrame, label: str, order: str, per_label: int, most: int | None = None) -> DataFrame:
    """The first ``per_label`` rows of each label in arrival order, then the first ``most`` of all. Filter before this call: only rows that pass count."""
    out = grouped_rank(rows, [label], [F.col(order)], "__n").where(F.col("__n") <= per_label).drop("__n")
    return out if most is None else out.orderBy(order).limit(most)


def limit_resume(rows: DataFrame, existing: int, target: int, order: str) -> DataFrame:
    """The next rows in order until ``target`` is reached, with ``existing`` already there."""
    return rows.orderBy(order).limit(max(0, target - existing))


def even_indices(total: Column, n: Column | int) -> Column:
    """Indices of ``n`` evenly spaced items: floor(i * total / n); all of them if n >= total, none for nothing."""
    n = F.lit(n) if isinstance(n, int) else n
    every = F.sequence(F.lit(0), total.cast("int") - 1)
    spaced = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.floor(i * total / n).cast("int"))
    return F.when((total <= 0) | (n <= 0), F.array().cast("array<int>")).when(n >= total, every).otherwise(spaced)


def hash_fraction(key: Column, seed: int = 42) -> Column:
    """A value in [0, 1) from the digest of seed and key, the same on any cluster and in SQL."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("long") / 4294967296.0


def hash_split(key: Column, ratios: dict[str, float], seed: int = 42) -> Column:
    """A split name by the hash of the key; ratios are scaled to a sum of one."""
    whole, at, out = sum(ratios.values()), 0.0, None
    for name, r in list(ratios.items())[:-1]:
        at += r / whole
        out = F.when(hash_fraction(key, seed) < at, name) if out is None else out.when(hash_fraction(key, seed) < at, name)
    last = list(ratios)[-1]
    return out.otherwise(last) if out is not None else F.lit(last)


def shuffled_order(key: str, seed: int = 42) -> list[Column]:
    """Sort keys of a seeded shuffle."""
    return [F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key)]


def sized_split(rows: DataFrame, key: str, fraction: float, seed: int = 42, up: bool = False) -> DataFrame:
    """Adds ``held_out``: exactly floor (or, with ``up``, ceil) of fraction times the number of rows, by seeded order."""
    scratch = Scratch(rows.sparkSession, "sized-split")
    kept = scratch.write(rows, "rows")
    exact = kept.count() * fraction
    n = int(exact) + (1 if up and exact > int(exact) else 0)
    return grouped_rank(kept.withColumn("__d", shuffled_order(key, seed)[0]), [], [F.col("__d"), F.col(key)], "__n").withColumn("held_out", F.col("__n") <= n).drop("__d", "__n")
