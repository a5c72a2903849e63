"""Consolidating pairwise matches into groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lumenset.functions.text import valid_phash
from lumenset.llm.components import connected_components
from lumenset.scratch import Scratch


def cleaned_path(c: Column) -> Column:
    """Without blanks at the ends and then a leading ``./``; blank gives NULL."""
    return F.nullif(F.regexp_replace(F.trim(c), r"^\./", ""), F.lit(""))


def link_groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``group_path``, ``path``) for every text key with a link to another one.

    ``group_path`` is the smallest key (compared byte by byte) linked directly or over
    others. NULL ends and loops are ignored. Keys get 64-bit ids by hash; should two keys
    share an id, which the node table shows, all ids are drawn again with another seed.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "link-groups")
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    for seed in range(16):
        key = lambda c: F.xxhash64(F.col(c), F.lit(seed))
        seen = Observation()
        ends = links.select(F.explode(F.array("a", "b")).alias("path")).groupBy("path").agg(F.lit(1).alias("one"))
        nodes = ends.groupBy(key("path").alias("node")).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
        nodes = scratch.write(nodes.observe(seen, F.max("n").alias("n")), f"nodes{seed}").drop("n")
        if (seen.get["n"] or 1) == 1:
            break
    else:
        raise RuntimeError("no seed gives distinct ids")
    labels = connected_components(links.select(key("a").alias("u"), key("b").alias("v")))
    members = scratch.write(labels.join(nodes, "node").select("component", "path"), "members")
    heads = members.groupBy("component").agg(F.min("path").alias("group_path"))
    return members.join(heads, "component").select("group_path", "path")


def usable_links(pairs: DataFrame, images: DataFrame, max_distance: int = 8) -> DataFrame:
    """Distinct links (``a``, ``b``, smaller first) of a raw match log between known images.

    A row counts if both cleaned paths are in ``images.path`` and differ and ``distance``
    is NULL or at most ``max_distance``. Repeated and reversed rows count once.
    """
    known = images.select("path").where("path is not null")
    log = pairs.where(F.col("distance").isNull() | (F.col("distance") <= max_distance))
    log = log.select(cleaned_path(F.col("path_a")).alias("pa"), cleaned_path(F.col("path_b")).alias("pb")).where("pa <> pb")
    log = log.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
    return log.join(known.withColumnRenamed("path", "a"), "a", "left_semi").join(known.withColumnRenamed("path", "b"), "b", "left_semi")


def match_groups(pairs: DataFrame, images: DataFrame, max_distance: int = 8) -> DataFrame:
    """(``group_path``, ``path``) for every image with a usable link. See ``usable_links`` and ``link_groups``."""
    scratch = Scratch(pairs.sparkSession, "match-groups")
    return link_groups(scratch.write(usable_links(pairs, images, max_distance), "links"))


def grouped_images(pairs: DataFrame, images: DataFrame, max_distance: int = 8) -> DataFrame:
    """(``path``, ``phash``, ``group_path``) for every image; one without links is a group of its own.

    ``phash`` is the smallest valid hash of the image's rows in lower case, or NULL.
    """
    own = F.when(valid_phash(F.col("phash")).isNotNull(), F.lower(F.trim("phash")))
    each = images.where("path is not null").groupBy("path").agg(F.min(own).alias("phash"))
    return each.join(match_groups(pairs, images, max_distance), "path", "left").select("path", "phash", F.coalesce("group_path", "path").alias("group_path"))
