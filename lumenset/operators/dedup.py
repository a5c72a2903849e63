"""Exact and near-duplicate removal, clusters and conflicts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.functions.text import valid_phash
from lumenset.operators.components import components
from lumenset.operators.ranking import grouped_rank
from lumenset.scratch import Scratch


def preference() -> dict[str, Column]:
    """Sort keys by name, best row first: quality, area, bytes, then the smaller path; missing values count as 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return {"k1": -zero("quality_score"), "k2": -zero("width") * zero("height"), "k3": -zero("file_size_bytes"), "k4": F.coalesce("path", F.lit("")), "k5": F.col("row_idx")}


def winners(rows: DataFrame, key: str) -> DataFrame:
    """(``key``, ``winner``, ``n``): row_idx of the best row of each non-NULL key, found by a combinable minimum and not by a sort of the group."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[c.alias(k) for k, c in preference().items()])).alias("w"), F.count(F.lit(1)).alias("n")).select(key, F.col("w.k5").alias("winner"), "n")


def exact_kept(rows: DataFrame, key: str = "md5_hash") -> DataFrame:
    """The best row of each digest, and all rows without one."""
    best = winners(rows, key).select(F.col("winner").alias("row_idx"))
    return rows.where(F.col(key).isNull()).unionByName(rows.where(F.col(key).isNotNull()).join(best, "row_idx", "left_semi").select(*rows.columns))


def exact_removed(rows: DataFrame, key: str = "md5_hash") -> DataFrame:
    best = winners(rows, key).select(F.col("winner").alias("row_idx"))
    return rows.where(F.col(key).isNotNull()).join(best, "row_idx", "left_anti")


def conflicts(rows: DataFrame, key: str = "md5_hash", kind: str = "exact") -> DataFrame:
    """The removed rows of groups that hold more than one class, with what was kept instead.

    ``row_idx``, ``conflict_type``, ``conflict_hash``, ``conflict_paths`` and ``conflict_labels`` (distinct, sorted, joined with ``|``),
    ``winner_path``, ``winner_quality_score``, ``winner_resolution`` as WxH. Only groups with two classes build their
    lists, and these hold distinct values. A missing label is a label of its own for the count.
    """
    keyed = rows.where(F.col(key).isNotNull())
    mixed = keyed.groupBy(key).agg(F.min(F.coalesce("class_label", F.lit(""))).alias("lo"), F.max(F.coalesce("class_label", F.lit(""))).alias("hi")).where("lo <> hi").select(key)
    held = keyed.join(mixed, key, "left_semi")
    lists = held.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("path")), "|").alias("conflict_paths"), F.array_join(F.array_sort(F.collect_set("class_label")), "|").alias("conflict_labels"))
    best = winners(held, key)
    won = rows.select(F.col("row_idx").alias("winner"), F.col("path").alias("winner_path"), F.col("quality_score").alias("winner_quality_score"), F.concat_ws("x", "width", "height").alias("winner_resolution"))
    out = held.select("row_idx", key).join(best, key).where("row_idx <> winner").join(lists, key).join(won, "winner")
    return out.select("row_idx", F.lit(kind).alias("conflict_type"), F.col(key).alias("conflict_hash"), "conflict_paths", "conflict_labels", "winner_path", "winner_quality_score", "winner_resolution")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hexadecimal hashes; 999 if either is missing or none."""
    return F.coalesce(F.bit_count(valid_phash(a).bitwiseXOR(valid_phash(b))).cast("int"), F.lit(999))


def bucket_pairs(rows: DataFrame, bucket_chars: int = 12, threshold: int = 8, key: str = "phash", most_joined: int = 4096) -> DataFrame:
    """(``bucket``, ``h1``, ``h2``, ``distance``): near pairs of different hashes that share their first ``bucket_chars`` digits.

    Equal hashes are one, so a bucket joins at most 16**(16 - bucket_chars) of them (65,536 at the default) whatever
    the number of rows. Where the digits behind the prefix make up 36 bits or more, a bucket may hold many more; those with over
    ``most_joined`` hashes are searched by three blocks of these bits: at most a third of the differences lies in some block, and variants with
    half of that flipped meet on both sides. The result is the same. Hashes that are not 16 hexadecimal digits have no pair.
    """
    each = rows.select(F.col(key).alias("h")).where(valid_phash(F.col("h")).isNotNull()).distinct().select("h", F.substring("h", 1, bucket_chars).alias("bucket"), valid_phash(F.col("h")).alias("bits"))
    distance = F.bit_count(F.col("b1").bitwiseXOR(F.col("b2"))).cast("int")
    rest = 64 - 4 * bucket_chars

    def joined(of: DataFrame, on: list[str]) -> DataFrame:
        a, b = (of.select(*on, F.col("h").alias(f"h{i}"), F.col("bits").alias(f"b{i}")) for i in (1, 2))
        return a.join(b, on).where((F.col("h1") < F.col("h2")) & (distance <= threshold)).select("bucket", "h1", "h2", distance.alias("distance"))

    if rest < 36 or threshold // 3 > 3:
        return joined(each, ["bucket"])
    each = Scratch(rows.sparkSession, "buckets").write(each, "hashes")
    large = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_joined).select("bucket")
    few = joined(each.join(large, "bucket", "left_anti"), ["bucket"])
    width, flips = -(-rest // 3), -(-(threshold // 3) // 2)

    def variants(k: int) -> Column:
        low = k * width
        size = min(width, rest - low)
        masks = [sum(1 << i for i in c) for r in range(flips + 1) for c in combinations(range(size), r)]
        part = F.shiftrightunsigned("bits", low).bitwiseAND(F.lit((1 << size) - 1))
        return F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.struct(F.lit(k).alias("block"), part.bitwiseXOR(m).alias("value")))

    spread = each.join(large, "bucket", "left_semi").select("bucket", "h", "bits", F.explode(F.concat(*[variants(k) for k in range(3)])).alias("v")).select("bucket", "h", "bits", "v.*")
    return few.unionByName(joined(spread, ["bucket", "block", "value"]).distinct())


def near_clusters(rows: DataFrame, bucket_chars: int = 12, threshold: int = 8, singles: bool = False) -> DataFrame:
    """``rows`` with ``cluster_key``: the smallest hash linked to the row's hash within its bucket, directly or over others.

    Rows whose hash is missing or shorter than the bucket have NULL; with ``singles`` each of them is a cluster of its own,
    named by its path. So do rows that share a text which is no hexadecimal number (a marker such as 'hash_error'): it says nothing
    about the image. Such a text on one row alone names that row. Hexadecimal hashes of other lengths are clusters by equality.
    """
    pairs = Scratch(rows.sparkSession, "bucket-pairs").write(bucket_pairs(rows, bucket_chars, threshold), "pairs")
    named = components(pairs, "h1", "h2").select(F.col("node").alias("phash"), "component", F.lit(False).alias("marker"))
    markers = rows.where(~F.lower(F.trim("phash")).rlike("^[0-9a-f]+$")).groupBy("phash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    named = named.unionByName(markers.select("phash", F.lit(None).cast("string").alias("component"), F.lit(True).alias("marker")))
    usable = (F.length("phash") >= bucket_chars) & ~F.coalesce("marker", F.lit(False))
    out = rows.join(named, "phash", "left")
    alone = F.concat(F.lit("path:"), F.col("path")) if singles else F.lit(None).cast("string")
    return out.select(*rows.columns, F.when(usable, F.coalesce("component", "phash")).otherwise(alone).alias("cluster_key"))


def near_kept(rows: DataFrame, bucket_chars: int = 12, threshold: int = 8) -> DataFrame:
    """The best row of each near cluster, and all rows without a usable hash."""
    clustered = Scratch(rows.sparkSession, "near-kept").write(near_clusters(rows, bucket_chars, threshold), "rows")
    return exact_kept(clustered, "cluster_key")


def all_conflicts(rows: DataFrame, bucket_chars: int = 12, threshold: int = 8) -> DataFrame:
    """``conflicts`` of equal digests, and of the near clusters of the rows these leave (``near``, with the removed row's own hash)."""
    scratch = Scratch(rows.sparkSession, "conflicts")
    rows = rows.select("row_idx", "path", "class_label", "width", "height", "file_size_bytes", "quality_score", "md5_hash", "phash")
    once = scratch.write(exact_kept(rows).drop("md5_hash"), "exact")
    clustered = scratch.write(near_clusters(once, bucket_chars, threshold), "rows")
    scratch.drop("exact")
    return conflicts(rows).unionByName(near_conflicts(clustered))


def near_conflicts(clustered: DataFrame) -> DataFrame:
    """``conflicts`` of rows with ``cluster_key``."""
    near = conflicts(clustered, "cluster_key", "near")
    return near.join(clustered.select("row_idx", "phash"), "row_idx").withColumn("conflict_hash", F.col("phash")).drop("phash")


def removed_counts(rows: DataFrame, key: str, removed: str, mixed: str) -> DataFrame:
    """One row: all rows but one of each non-NULL key, and how many of them are in groups of more than one class (the rows of ``conflicts``)."""
    label = F.coalesce("class_label", F.lit(""))
    groups = rows.where(F.col(key).isNotNull()).groupBy(key).agg((F.count(F.lit(1)) - 1).alias("n"), (F.min(label) != F.max(label)).alias("several"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(removed), F.coalesce(F.sum(F.when(F.col("several"), F.col("n"))), F.lit(0)).alias(mixed))


def dedup_summary(rows: DataFrame, bucket_chars: int = 12, threshold: int = 8) -> DataFrame:
    """One row: (``total``, ``kept``, ``exact_removed``, ``near_removed``, ``cross_class``); the last counts removed rows of both kinds of mixed groups."""
    once = Scratch(rows.sparkSession, "dedup").write(exact_kept(rows).select("path", "class_label", "phash"), "exact")
    near = removed_counts(near_clusters(once, bucket_chars, threshold), "cluster_key", "near_removed", "near_mixed")
    # Three single rows.
    joined = rows.agg(F.count(F.lit(1)).alias("total")).crossJoin(removed_counts(rows, "md5_hash", "exact_removed", "exact_mixed")).crossJoin(near)
    kept = F.col("total") - F.col("exact_removed") - F.col("near_removed")
    return joined.select("total", kept.alias("kept"), "exact_removed", "near_removed", (F.col("exact_mixed") + F.col("near_mixed")).alias("cross_class"))


def numbered_clusters(rows: DataFrame, key: str = "cluster_key") -> DataFrame:
    """Adds ``cluster_id`` as ``cluster_00000`` and on, in the order of the smallest path of each cluster."""
    rows = rows.drop("cluster_id")
    heads = rows.groupBy(key).agg(F.min("path").alias("head"))
    ids = grouped_rank(heads, [], [F.col("head"), F.col(key)], "nth")
    return rows.join(ids.select(key, F.format_string("cluster_%05d", F.col("nth") - 1).alias("cluster_id")), key)


def cluster_stats(rows: DataFrame, key: str = "cluster_key") -> DataFrame:
    """One row: clusters, size percentiles (linear interpolation, cut to whole numbers), largest, and clusters of more than one class."""
    label = F.coalesce("class_label", F.lit(""))
    each = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.min(label) != F.max(label)).alias("impure"))
    p = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    stats = each.agg(F.count(F.lit(1)).alias("clusters"), p.alias("p"), F.max("n").alias("largest"), F.count_if("impure").alias("impure"))
    at = lambda i: F.get("p", F.lit(i)).cast("int")
    return stats.select("clusters", at(0).alias("p50"), at(1).alias("p90"), at(2).alias("p99"), "largest", "impure", F.round(F.try_divide(F.col("impure") * 100.0, F.col("clusters")), 6).alias("impure_pct"))
