"""Audit of an exported manifest: matrices, leakage, quality, anomalies and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenset.config import Config
from lumenset.operators.manifest import base_name, is_complete
from lumenset.scratch import Scratch

REQUIRED = ("path", "export_path", "split", "class_label", "dataset_source", "quality_score")


def split_matrix(rows: DataFrame, by: str = "class_label", splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(``by``, one count for each split)."""
    return rows.groupBy(by).agg(*[F.count_if(F.col("split") == s).alias(s) for s in splits])


def imbalance(rows: DataFrame, split_share: float = 0.05, class_share: float = 0.05, source_share: float = 0.01) -> DataFrame:
    """(``kind``, ``name``, ``n``, ``share``) of splits, classes and sources below their least share of all rows."""
    from lumenset.operators.export import split_counts

    counts = split_counts(rows)
    total = F.sum(F.when(F.col("kind") == "split", F.col("n"))).over(Window.partitionBy())  # a row for each split, class and source
    least = F.when(F.col("kind") == "split", split_share).when(F.col("kind") == "class", class_share).otherwise(source_share)
    return counts.withColumn("share", F.col("n") / total).where(F.col("share") < least).select("kind", "name", "n", F.round("share", 6).alias("share"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(``key``, ``n``) of values that occur more than once."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def leak_keys(rows: DataFrame) -> DataFrame:
    """(``kind``, ``key``, ``split``, ``row_idx``): digests of both kinds in one namespace, file names and paths."""
    entry = lambda k, c: F.struct(F.lit(k).alias("kind"), c.alias("key"))
    keys = F.array(entry("hash", F.col("md5_hash")), entry("hash", F.col("sha256")), entry("filename", base_name(F.col("path"))), entry("path", F.col("path")))
    return rows.where("split is not null").select("row_idx", "split", F.explode(keys).alias("e")).select("e.kind", "e.key", "split", "row_idx").where("key is not null")


def leakage(rows: DataFrame) -> DataFrame:
    """(``kind``, ``keys``): how many keys of each kind stand in more than one split."""
    keys = leak_keys(rows).groupBy("kind", "key").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    return keys.groupBy("kind").agg(F.count_if(F.col("lo") != F.col("hi")).alias("keys"))


def leakage_pairs(rows: DataFrame, kind: str = "hash") -> DataFrame:
    """(``pair``, ``n``) with ``a|b``: in the order of rows, each row counts once for every other split its key has been in before.

    A split counts for a row if the key's first row in it comes before. So only the first row of each
    key and split is kept, and no key's rows need be in one place.
    """
    keys = leak_keys(rows).where(F.col("kind") == kind)
    first = keys.groupBy("key", "split").agg(F.min("row_idx").alias("first"))
    several = first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    first = first.join(several, "key", "left_semi").select("key", F.col("split").alias("other"), "first")
    hit = keys.join(first, "key").where("other <> split and first < row_idx")
    return hit.groupBy(F.concat_ws("|", F.least("split", "other"), F.greatest("split", "other")).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def index_percentiles(rows: DataFrame, value: str, points: tuple[int, ...] = (10, 25, 50, 75, 90, 99)) -> DataFrame:
    """One row (``n``, ``p50`` ...): the value at position min(floor(n * p / 100), n - 1) of the sorted ones. NULL without values.

    Equal values are counted first and only different ones are sorted, so a value that most rows have costs one row.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = rows.select(F.col(value).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    placed = Scratch(spark, "percentiles").write(counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "counts")
    sums = placed.groupBy("part").agg(F.sum("k").alias("s"))  # a row for each partition
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy()).alias("n"))
    upto = F.col("before") + F.sum("k").over(Window.partitionBy("part").orderBy("v"))
    each = placed.join(before, "part").select("v", "k", "n", upto.alias("upto"))
    at = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1) + 1
    picks = [F.max(F.when((F.col("upto") >= at(p)) & (F.col("upto") - F.col("k") < at(p)), F.col("v"))).alias(f"p{p}") for p in points]
    return each.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), *picks)


def quality_stats(rows: DataFrame, below: float = 0.7) -> DataFrame:
    """One row: n, min, max, mean, percentiles (p50 is the median), rows below the limit and their share."""
    some = rows.select("quality_score").where("quality_score is not null")
    base = some.agg(F.min("quality_score").alias("min"), F.max("quality_score").alias("max"), F.round(F.avg("quality_score"), 6).alias("mean"), F.count_if(F.col("quality_score") < below).alias("below"))
    both = base.crossJoin(index_percentiles(some, "quality_score"))  # two single rows
    return both.select("n", "min", "max", "mean", "p10", "p25", "p50", "p75", "p90", "p99", "below", F.round(F.try_divide(F.col("below") * 100.0, F.col("n")), 6).alias("below_pct"))


def histogram(rows: DataFrame, value: str, bins: tuple[float, ...] = Config.quality_hist_bins) -> DataFrame:
    """(``bin``, ``lo``, ``hi``, ``n``): half-open bins, the last one closed; values outside are dropped, empty bins stay."""
    spans = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(bins, bins[1:]))]
    which = F.lit(None).cast("int")
    for i, a, b in reversed(spans):
        inside = (F.col(value) >= a) & ((F.col(value) < b) | (F.lit(i == len(spans) - 1) & (F.col(value) == b)))
        which = F.when(inside, i).otherwise(which)
    counts = rows.select(which.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame(spans, "bin int, lo double, hi double")
    return every.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def anomaly_tests(known_sources: tuple[str, ...] = (), splits: tuple[str, ...] = ("train", "val", "test"), export_root: str | None = None) -> list[Column]:
    """Expressions that give an issue, or NULL where a row has none of its kind."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    tests: list[Column] = [
        F.when(blank("class_label"), "Missing class_label"),
        F.when(~F.coalesce(F.col("split").isin(*splits), F.lit(False)), "Invalid split name"),
        F.when(blank("path") | blank("export_path"), "Missing path or export_path"),
        F.when(F.col("width").isNull() | F.col("height").isNull(), "Invalid resolution").when((F.col("width") <= 0) | (F.col("height") <= 0), "Non-positive resolution"),
        *[F.when(blank(c), f"Empty field: {c}") for c in (*REQUIRED, "md5_hash", "sha256", "width", "height")],
    ]
    if known_sources:
        tests.append(F.when(~F.coalesce(F.col("dataset_source").isin(*known_sources), F.lit(False)), "Unknown dataset_source"))
    if export_root:
        tests.append(F.when(escapes(F.col("export_path"), export_root), "Path escape"))
    return tests


def anomalies(rows: DataFrame, known_sources: tuple[str, ...] = (), splits: tuple[str, ...] = ("train", "val", "test"), export_root: str | None = None) -> DataFrame:
    """(``row_idx``, ``issue``): every finding of every row. Cap it for a report with ``first_anomalies``."""
    tests = anomaly_tests(known_sources, splits, export_root)
    return rows.select("row_idx", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("issue"))


def first_anomalies(found: DataFrame, cap: int = 1000) -> DataFrame:
    return found.orderBy("row_idx", "issue").limit(cap)


def escapes(path: Column, root: str) -> Column:
    """Does not lie below the root."""
    return F.coalesce(~path.startswith(root.rstrip("/") + "/"), F.lit(True))


def verdict(rows: DataFrame, config: Config = Config(), missing: int = 0, unreadable: int = 0) -> DataFrame:
    """One row with the counts behind it and ``verdict``: PASS, WARN or FAIL.

    FAIL: no valid rows, or missing files (of valid rows), malformed rows (of all rows) or hashes in several splits (``leaked``) beyond their limits.
    WARN: any imbalance, anomaly, malformed row, missing, unreadable or repeated file, any hash, file name or path in several splits,
    or too many rows of low quality. ``warnings`` counts imbalances and the kinds of keys that leak.
    All malformed rows count, not just listed ones.
    """
    good = is_complete(REQUIRED)
    valid = rows.where(good)
    least = config.min_quality_score or 0.0
    # Three passes: over the rows, over their keys, over splits, classes and sources.
    issues = F.size(F.filter(F.array(*anomaly_tests(config.known_sources, tuple(config.split_ratios))), lambda x: x.isNotNull()))
    base = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~good).alias("malformed"), F.count_if(good & (F.col("quality_score") < least)).alias("low_quality"),
        F.coalesce(F.sum(F.when(good, issues)), F.lit(0)).cast("long").alias("anomalies"),
    )
    places = valid.select("split", F.lit("place").alias("kind"), F.col("export_path").alias("key"))
    keys = leak_keys(valid).select("split", "kind", "key").unionByName(places).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("lo"), F.max("split").alias("hi"))
    leak, twice = F.col("lo") != F.col("hi"), F.col("n") > 1
    leaks = keys.agg(
        F.count_if(leak & (F.col("kind") == "hash")).alias("leaked"), *[F.count_if(leak & (F.col("kind") == k)).alias(f"leaked_{k}") for k in ("filename", "path")],
        F.count_if(twice & F.col("kind").isin("place", "path")).alias("repeated"),
    )
    kinds = F.expr("int(leaked > 0) + int(leaked_filename > 0) + int(leaked_path > 0)")
    facts = base.crossJoin(leaks).crossJoin(imbalance(valid).agg(F.count(F.lit(1)).alias("imbalances")))  # single rows, all of them
    facts = facts.select("rows", "malformed", "low_quality", "leaked", (F.col("imbalances") + kinds).alias("warnings"), "anomalies", "repeated")
    ok_rows = F.col("rows") - F.col("malformed")
    pct = lambda a, b: F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0))
    fail = (ok_rows == 0) | (pct(F.lit(missing), ok_rows) > config.max_missing_pct) | (pct(F.col("malformed"), F.col("rows")) > config.max_malformed_pct) | (F.col("leaked") > config.max_leakage_allowed)
    warn = (F.col("warnings") + F.col("anomalies") + F.col("malformed") + F.col("repeated") + missing + unreadable > 0) | (pct(F.col("low_quality"), ok_rows) > config.max_low_quality_pct)
    return facts.withColumn("verdict", F.when(fail, "FAIL").when(warn, "WARN").otherwise("PASS"))
