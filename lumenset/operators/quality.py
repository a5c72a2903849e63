"""Quality flags, scores and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.config import ImageRules

#: What each flag costs; any other flag costs OTHER_PENALTY.
PENALTIES = {"corrupt": 1.0, "low_resolution": 0.3, "blurry": 0.4, "aspect_ratio_extreme": 0.2, "compressed": 0.1, "opencv_read_failed": 0.5, "not_decoded": 0.0}
OTHER_PENALTY = 0.2


def aspect_ratio(width: Column, height: Column) -> Column:
    """Four decimals; NULL for height 0 or missing sizes."""
    return F.round(F.try_divide(width.cast("double"), F.nullif(height, F.lit(0)).cast("double")), 4)


def resolution_ok(width: Column, height: Column, rules: ImageRules) -> Column:
    return F.coalesce((width.try_cast("int") >= rules.min_width) & (height.try_cast("int") >= rules.min_height), F.lit(False))


def aspect_ok(ratio: Column, rules: ImageRules) -> Column:
    return F.coalesce(ratio.try_cast("double").between(rules.aspect_ratio_min, rules.aspect_ratio_max), F.lit(False))


def is_compressed(fmt: Column, size: Column, width: Column, height: Column, rules: ImageRules) -> Column:
    """A JPEG with few bytes a pixel."""
    pixels = width.cast("long") * height.cast("long")
    thin = F.when((width > 0) & (height > 0), size / pixels < rules.compression_size_per_pixel)
    return F.coalesce((F.lower(fmt) == "jpeg") & thin, F.lit(False))


def quality_flags(rules: ImageRules, blur: Column, corrupt: Column | None = None, undecoded: Column | None = None) -> Column:
    """Flags of a manifest row in fixed order; a missing blur score is a failed read, and ``corrupt`` replaces all others.

    ``undecoded`` are images of a format that cannot be read here; their blur is not known and costs nothing.
    """
    found = [
        F.when(F.lit(False) if undecoded is None else undecoded, "not_decoded").when(blur.isNull(), "opencv_read_failed").when(blur < rules.blur_threshold, "blurry"),
        F.when(~resolution_ok(F.col("width"), F.col("height"), rules), "low_resolution"),
        F.when(~aspect_ok(F.col("aspect_ratio"), rules), "aspect_ratio_extreme"),
    ]
    if rules.compression_heuristic:
        found.append(F.when(is_compressed(F.col("format"), F.col("file_size_bytes"), F.col("width"), F.col("height"), rules), "compressed"))
    flags = F.filter(F.array(*found), lambda x: x.isNotNull())
    return flags if corrupt is None else F.when(corrupt, F.array(F.lit("corrupt"))).otherwise(flags)


def quality_score(flags: Column) -> Column:
    """max(0, 1 - min(sum of penalties, 1)) in doubles; no flags, or only ``ok``, give 1."""
    cost = F.create_map(*[F.lit(x) for kv in {**PENALTIES, "ok": 0.0}.items() for x in kv])
    total = F.aggregate(flags, F.lit(0.0), lambda acc, f: acc + F.coalesce(F.try_element_at(cost, f), F.lit(OTHER_PENALTY)))
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.least(total, F.lit(1.0)))


def validated(rows: DataFrame, rules: ImageRules = ImageRules(), corrupt: Column | None = None, undecoded: Column | None = None) -> DataFrame:
    """Adds ``quality_flag``, ``quality_score``, ``resolution_ok`` and ``aspect_ratio_ok``, each once, from sizes and ``blur_score``."""
    flags = quality_flags(rules, F.col("blur_score"), corrupt, undecoded)
    rows = rows.withColumns({"quality_flag": flags, "resolution_ok": resolution_ok(F.col("width"), F.col("height"), rules), "aspect_ratio_ok": aspect_ok(F.col("aspect_ratio"), rules)})
    return rows.withColumn("quality_score", quality_score(F.col("quality_flag")))


def flag_text(flags: Column) -> Column:
    """Text form: joined with ``|``, ``ok`` when empty."""
    return F.when(F.size(flags) > 0, F.array_join(flags, "|")).otherwise("ok")


def quality_by_group(rows: DataFrame) -> DataFrame:
    """(``level``, ``name``, ``total``, ``flagged``, ``pct``) over all rows, each class and each source, in one pass over grouping sets."""
    flagged = F.count_if(F.size("quality_flag") > 0)
    sets = rows.groupingSets([[], ["class_label"], ["dataset_source"]], "class_label", "dataset_source").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("total"), flagged.alias("flagged"))
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "class").otherwise("source")
    name = F.when(F.col("g") == 1, F.col("class_label")).when(F.col("g") == 2, F.col("dataset_source"))
    return sets.select(level.alias("level"), name.alias("name"), "total", "flagged", F.round(F.col("flagged") * 100.0 / F.col("total"), 6).alias("pct"))


def flag_frequency(rows: DataFrame) -> DataFrame:
    """(``flag``, ``n``, ``pct`` of all rows); the original's flags appear even with no row, others as they occur."""
    total = rows.agg(F.count(F.lit(1)).alias("rows"))
    known = rows.sparkSession.createDataFrame([(f,) for f in PENALTIES if f != "not_decoded"], "flag string")  # a flag of this engine alone
    counts = rows.select(F.explode("quality_flag").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    # One row is broadcast.
    return known.join(counts, "flag", "full").crossJoin(F.broadcast(total)).select("flag", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)) * 100.0, F.col("rows")), F.lit(0.0)), 6).alias("pct"))


def passing(rows: DataFrame, least: float | None) -> DataFrame:
    """Rows of at least this quality; a missing score counts as 0, and no limit keeps all."""
    return rows if least is None else rows.where(F.coalesce(F.col("quality_score").try_cast("double"), F.lit(0.0)) >= least)


def filter_counts(rows: DataFrame, least: float) -> DataFrame:
    """One row: (``kept``, ``skipped``)."""
    ok = F.coalesce(F.col("quality_score").try_cast("double"), F.lit(0.0)) >= least
    return rows.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))
