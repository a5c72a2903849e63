"""Building, checking, merging and patching manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions of images.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tiff", "webp")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def relative_source(path: Column, root: str) -> Column:
    """Relative to the root if below it, else unchanged."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def with_labels(rows: DataFrame, class_map: DataFrame | dict[str, str] | None) -> DataFrame:
    """``class_label`` looked up by ``dataset_source``: ``unknown`` on a miss, the source itself without a map.

    A map given as a dict is bounded by the program that wrote it and is broadcast as an expression; a table is joined as its size calls for.
    """
    rows = rows.drop("class_label")
    if class_map is None:
        return rows.withColumn("class_label", F.col("dataset_source"))
    if isinstance(class_map, dict):
        found = F.try_element_at(F.create_map(*[F.lit(x) for kv in class_map.items() for x in kv]), F.col("dataset_source")) if class_map else F.lit(None).cast("string")
        return rows.withColumn("class_label", F.coalesce(found, F.lit("unknown")))
    return rows.join(class_map.select("dataset_source", "class_label").dropDuplicates(["dataset_source"]), "dataset_source", "left").withColumn("class_label", F.coalesce("class_label", F.lit("unknown")))


def missing_columns(rows: DataFrame, required: tuple[str, ...]) -> list[str]:
    return sorted(set(required) - set(rows.columns))


def check_artifact(rows: DataFrame, required: tuple[str, ...], least: int = 1, stage: str = "") -> DataFrame:
    """Raises ValueError if columns are missing or there are fewer than ``least`` rows; reads no more than that many."""
    if gone := missing_columns(rows, required):
        raise ValueError(f"{stage}: missing columns {gone}")
    if least and rows.limit(least).count() < least:
        raise ValueError(f"{stage}: fewer than {least} rows")
    return rows


def is_complete(required: tuple[str, ...]) -> Column:
    """All required fields are present and not blank."""
    out = F.lit(True)
    for c in required:
        out = out & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return out


def merged(old: DataFrame, new: DataFrame, blank_is_key: bool = False) -> DataFrame:
    """Rows of ``old``, then those of ``new`` whose digests are not there yet; the first of equal digests wins.

    First means the old manifest before the new one, then the smaller ``row_idx``. Rows without any digest are all kept, or with ``blank_is_key``
    collapse into one. Columns of either are kept; those that one lacks are NULL.
    """
    both = old.withColumn("__from", F.lit(0)).unionByName(new.withColumn("__from", F.lit(1)), allowMissingColumns=True)
    key = F.struct(F.coalesce("md5_hash", F.lit("")).alias("m"), F.coalesce("sha256", F.lit("")).alias("s"))
    if not blank_is_key:
        free = "coalesce(md5_hash, '') = '' and coalesce(sha256, '') = ''"
        loose, both = both.where(free), both.where(f"not ({free})")
    # The winner of a key comes from a combinable minimum; the row itself is fetched by its place.
    first = both.groupBy(key.alias("k")).agg(F.min(F.struct("__from", "row_idx")).alias("w")).select(F.col("w.__from").alias("__from"), F.col("w.row_idx").alias("row_idx"))
    out = both.join(first, ["__from", "row_idx"], "left_semi")
    if not blank_is_key:
        out = out.unionByName(loose)
    return out.withColumnRenamed("__from", "origin")


def merged_folders(folders: list[dict[str, DataFrame]], blank_is_key: bool = False) -> dict[str, DataFrame]:
    """The master manifests of many artifact folders: for each kind of manifest (such as ``sampled`` and ``export``) the rows whose digests came first.

    ``folders``: one dict of manifests by kind for each folder, in order; within a folder kinds count in the order of its dict, then ``row_idx``.
    One set of digests holds for all kinds, so a digest kept as sampled is not kept as exported again. Rows without any digest are all kept, or with
    ``blank_is_key`` collapse into one. Columns that a folder lacks are NULL; each result has ``folder``, its place in the list. No folders give an empty dict.
    """
    kinds = list(dict.fromkeys(k for f in folders for k in f))
    tagged = [(k, df.withColumn("folder", F.lit(i)).withColumn("__turn", F.lit(j))) for i, f in enumerate(folders) for j, (k, df) in enumerate(f.items())]
    if not tagged:
        return {}
    digest = F.struct(F.coalesce("md5_hash", F.lit("")).alias("m"), F.coalesce("sha256", F.lit("")).alias("s"))
    keys = [df.select("folder", "__turn", F.col("row_idx").alias("__row"), digest.alias("__key")) for _, df in tagged]
    every = keys[0]
    for more in keys[1:]:
        every = every.unionByName(more)
    blank = (F.col("__key.m") == "") & (F.col("__key.s") == "")
    counted = every if blank_is_key else every.where(~blank)
    first = counted.groupBy("__key").agg(F.min(F.struct("folder", "__turn", "__row")).alias("w")).select("w.*")
    out = {}
    for kind in kinds:
        rows = None
        for k, df in tagged:
            if k == kind:
                rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
        kept = rows.join(first, (rows["folder"] == first["folder"]) & (rows["__turn"] == first["__turn"]) & (rows["row_idx"] == first["__row"]), "left_semi")
        if not blank_is_key:
            kept = kept.unionByName(rows.where("coalesce(md5_hash, '') = '' and coalesce(sha256, '') = ''"))
        out[kind] = kept.drop("__turn")
    return out


def patched(rows: DataFrame, changes: DataFrame, key: str = "export_path") -> DataFrame:
    """Rows with new path, width and height where ``changes`` (``old``, ``new``, ``new_width``, ``new_height``) has the key, and without ``low_resolution`` there.

    A key given twice takes the change with the smaller new path. NULL keys change nothing.
    """
    once = changes.where("old is not null").groupBy("old").agg(F.min(F.struct("new", "new_width", "new_height")).alias("c"))
    out = rows.join(once, rows[key] == once["old"], "left")
    hit = F.col("c").isNotNull()
    values = {key: F.coalesce("c.new", key), "width": F.coalesce("c.new_width", "width"), "height": F.coalesce("c.new_height", "height"), "quality_flag": F.when(hit, F.array_remove("quality_flag", "low_resolution")).otherwise(F.col("quality_flag"))}
    return out.select(*[values[c].alias(c) if c in values else F.col(c) for c in rows.columns])


def upscaled_size(width: Column, height: Column, scale: float, target_width: int | None = None, target_height: int | None = None) -> list[Column]:
    """Target sizes if given, else the scaled ones; unreadable sizes count as 0."""
    side = lambda c, t: F.lit(t) if t else F.floor(F.coalesce(c, F.lit(0)) * scale).cast("int")
    return [side(width, target_width).alias("new_width"), side(height, target_height).alias("new_height")]


def moved_path(path: Column, root: str, new_root: str, suffix: str | None = None) -> Column:
    """The same place below another root, with another extension if given."""
    out = F.concat(F.lit(new_root.rstrip("/") + "/"), relative_source(path, root))
    return F.regexp_replace(out, r"\.[^./]*$", suffix) if suffix else out


def preview(plan: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows of what a dry run would do."""
    return plan.orderBy(order).limit(n)


def pending(inputs: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Inputs whose output is not there yet."""
    return inputs.join(existing.select(key), key, "left_anti")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """Any of the words, in any case."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(c), F.lit(w.lower()))
    return out


def pair_names(text: Column) -> Column:
    """From a JSON list of pairs: ``a_b`` and ``b_a`` for each pair, in order. Malformed text gives NULL."""
    pairs = F.from_json(text, "array<array<string>>")
    return F.flatten(F.transform(pairs, lambda p: F.array(F.concat_ws("_", F.get(p, F.lit(0)), F.get(p, F.lit(1))), F.concat_ws("_", F.get(p, F.lit(1)), F.get(p, F.lit(0))))))


def generator_name(folder: Column, path: Column) -> Column:
    return F.concat(folder, F.lit("__"), base_name(path))


def ingest_ok(least: int, modes: tuple[str, ...] = (), width: str = "width", height: str = "height", mode: str = "format") -> Column:
    """Both sides at least ``least`` and, if given, one of the modes."""
    out = F.coalesce((F.col(width) >= least) & (F.col(height) >= least), F.lit(False))
    return out & F.coalesce(F.col(mode).isin(*modes), F.lit(False)) if modes else out


def upload_ok(width: Column, height: Column, most_pixels: int = 50_000_000) -> Column:
    return F.coalesce((width > 0) & (height > 0) & (width.cast("long") * height.cast("long") <= most_pixels), F.lit(False))
