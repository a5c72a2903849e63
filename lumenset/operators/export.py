"""Export plans: which rows, where to, and what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenset.operators.manifest import base_name
from lumenset.operators.ranking import grouped_rank


def capped(rows: DataFrame, most: int | None, compat: bool = False) -> DataFrame:
    """The first ``most`` rows of each split by class, source and quality.

    Quality counts from high to low. ``compat`` sorts it upwards and as text, so the cap keeps the lowest.
    """
    if not most:
        return rows
    quality = F.col("quality_score").cast("string").asc_nulls_first() if compat else F.col("quality_score").desc_nulls_last()
    keys = rows.select("split", "class_label", "dataset_source", "quality_score", "path", "row_idx")
    ranked = grouped_rank(keys, ["split"], [F.col("class_label"), F.col("dataset_source"), quality, F.col("path"), F.col("row_idx")], "__n")
    return rows.join(ranked.where(F.col("__n") <= most).select("row_idx"), "row_idx", "left_semi").select(*rows.columns)


def with_destination(rows: DataFrame, root: str = "export") -> DataFrame:
    """Adds ``destination``: root/split/class/name, and ``_1``, ``_2`` ... before the extension where a name is taken, in the order of path."""
    keys = rows.select(F.col("row_idx").alias("__row"), "path", base_name(F.col("path")).alias("__name"), F.coalesce("split", F.lit("none")).alias("__s"), F.coalesce("class_label", F.lit("unknown")).alias("__c"))
    taken = ["__s", "__c", "__name"]
    several = keys.groupBy(*taken).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*taken)
    # Names that stand alone are what they are; only repeated ones are ranked.
    ranked = grouped_rank(keys.join(several, taken, "left_semi").select(*keys.columns), taken, [F.col("path"), F.col("__row")], "__n")
    cut = F.regexp_extract("__name", r"^(.*?)(\.[^.]*)?$", 1)
    tail = F.regexp_extract("__name", r"^(.*?)(\.[^.]*)?$", 2)
    later = ranked.where("__n > 1").select("__row", F.concat(cut, F.lit("_"), (F.col("__n") - 1).cast("string"), tail).alias("__other"))
    name = F.coalesce("__other", base_name(F.col("path")))
    where = F.concat_ws("/", F.lit(root), F.coalesce("split", F.lit("none")), F.coalesce("class_label", F.lit("unknown")), name)
    return rows.join(later, rows["row_idx"] == later["__row"], "left").select(*rows.columns, where.alias("destination"))


def split_counts(rows: DataFrame) -> DataFrame:
    """(``kind``, ``name``, ``n``) for splits, classes and sources, from one pass."""
    sets = rows.groupingSets([["split"], ["class_label"], ["dataset_source"]], "split", "class_label", "dataset_source").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("g") == 3, "split").when(F.col("g") == 5, "class").otherwise("source")
    return sets.select(kind.alias("kind"), F.coalesce("split", "class_label", "dataset_source").alias("name"), "n")


def copy_rates(planned: DataFrame, copied: DataFrame, key: str = "path") -> DataFrame:
    """(``split``, ``planned``, ``copied``, ``missed``, ``miss_pct``): counts after copying, against the plan."""
    there = copied.select(key).distinct().withColumn("__there", F.lit(1))
    out = planned.join(there, key, "left").groupBy("split").agg(F.count(F.lit(1)).alias("planned"), F.count("__there").alias("copied"))
    return out.select("split", "planned", "copied", (F.col("planned") - F.col("copied")).alias("missed"), F.round((F.col("planned") - F.col("copied")) * 100.0 / F.col("planned"), 6).alias("miss_pct"))


def copy_plan(rows: DataFrame, available: DataFrame, root: str) -> DataFrame:
    """(``path``, ``source``, ``target``): each row's file by its path, else by its name (the smallest path of that name); missing ones have ``source`` NULL."""
    files = available.select("file").where("file is not null").distinct()
    by_name = files.groupBy(base_name(F.col("file")).alias("__name")).agg(F.min("file").alias("__by_name"))
    out = rows.select("path").where("path is not null").distinct().withColumn("__name", base_name(F.col("path")))
    out = out.join(files.select(F.col("file").alias("path"), F.col("file").alias("__by_path")), "path", "left").join(by_name, "__name", "left")
    return out.select("path", F.coalesce("__by_path", "__by_name").alias("source"), F.concat(F.lit(root.rstrip("/") + "/"), "__name").alias("target"))
