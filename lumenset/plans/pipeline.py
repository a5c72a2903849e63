"""The staged pipeline: index, validate, deduplicate, sample, split, export plan, audit."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenset import scratch
from lumenset.config import Config
from lumenset.operators import audit, dedup, export, manifest, quality, sample, split
from lumenset.schema import normal_form
from lumenset.sources import files, sinks


def with_pixels(spark: SparkSession, rows: DataFrame, roots: list[str], project_root: str) -> DataFrame:
    """Adds blur score, perceptual hash and whether the image is corrupt, or of a format that the JVM has no reader for (``undecoded``)."""
    each = [files.blur_and_hash(spark, r) for r in roots]
    seen = each[0]
    for more in each[1:]:
        seen = seen.unionByName(more)
    seen = seen.withColumn("path", manifest.relative_source(F.col("path"), project_root))
    out = rows.drop("blur_score").join(seen.dropDuplicates(["path"]), "path", "left")
    unread = F.col("blur_score").isNull()
    readable = F.coalesce(F.upper("format").isin(*files.readable_formats(spark)), F.lit(True))
    return out.withColumn("corrupt", unread & readable).withColumn("undecoded", unread & ~readable).withColumn("phash", F.coalesce("phash", "seen_hash")).drop("seen_hash")


def validate(rows: DataFrame, config: Config) -> DataFrame:
    corrupt, undecoded = (F.col(c) if c in rows.columns else None for c in ("corrupt", "undecoded"))
    return quality.validated(rows, config.image_rules, corrupt, undecoded).drop("corrupt", "undecoded")


def deduplicate(rows: DataFrame, config: Config) -> DataFrame:
    return dedup.near_kept(dedup.exact_kept(rows), config.phash_bucket_chars, config.phash_hamming_threshold).drop("cluster_key")


def draw(rows: DataFrame, config: Config) -> DataFrame:
    good = quality.passing(rows, config.min_quality_score)
    picked = sample.class_sample(good, config.class_targets, config.per_source_max_fraction) if config.class_targets else good
    return sample.global_cap(picked, config.max_total_images)


def divide(rows: DataFrame, config: Config, mode: str = "delta") -> DataFrame:
    """Adds ``cluster_id`` and ``split``; ``mode``: the greedy ``delta`` or ``compat``, which balance size, class and source
    one cluster after the other on the driver, or ``hash`` by cluster, which works in parallel and balances nothing."""
    clustered = dedup.near_clusters(split.usable_rows(rows), config.phash_bucket_chars, config.phash_cluster_threshold, singles=True)
    clustered = dedup.numbered_clusters(clustered)
    if mode == "hash":
        out = clustered.withColumn("split", sample.hash_split(F.col("cluster_key"), config.split_ratios, config.random_seed))
    else:
        out = split.greedy_split(clustered, config.split_ratios, "cluster_key", config.random_seed, mode)
    return out.drop("cluster_key")


def plan_export(rows: DataFrame, config: Config) -> DataFrame:
    return export.with_destination(export.capped(rows, config.max_images_per_split), config.export_root).withColumnRenamed("destination", "export_path")


def run(spark: SparkSession, config: Config, artifacts: str, copy: bool = True, split_mode: str = "delta", dry_run: bool = False) -> dict:
    """``run_stages``, after which the tables that its operators left in the shared folder are deleted, also if it fails."""
    mark = scratch.made()
    try:
        return run_stages(spark, config, artifacts, copy, split_mode, dry_run)
    finally:
        scratch.clear_since(spark, mark)


def run_stages(spark: SparkSession, config: Config, artifacts: str, copy: bool = True, split_mode: str = "delta", dry_run: bool = False) -> dict:
    """Runs all stages and returns the audit report. A stage whose table is in ``artifacts`` is read, not made again; the audit
    looks up every exported file anew, also without ``copy``.

    ``dry_run`` builds every plan and writes nothing. In strict mode a FAIL raises RuntimeError, and so does a missing file while copying.
    """
    roots = [r if r.startswith("/") or "://" in r else f"{config.project_root.rstrip('/')}/{r}" for r in config.source_dirs]
    keep = (lambda name, make: make()) if dry_run else (lambda name, make: sinks.stage(spark, f"{artifacts}/{name}", make))
    rows = keep("index", lambda: files.index(spark, roots, config.project_root, config.class_map or None))
    manifest.check_artifact(rows, ("path", "class_label", "dataset_source"), 0 if dry_run else 1, "index")
    rows = keep("validated", lambda: validate(with_pixels(spark, rows, roots, config.project_root), config))
    keep("conflicts", lambda: dedup.all_conflicts(normal_form(rows), config.phash_bucket_chars, config.phash_hamming_threshold))
    kept = keep("deduped", lambda: deduplicate(normal_form(rows), config))
    drawn = keep("sampled", lambda: draw(kept, config))
    placed = keep("split", lambda: divide(drawn, config, split_mode))
    planned = keep("export", lambda: plan_export(placed, config))
    if dry_run:
        return {"stages": [len(df.columns) for df in (rows, kept, drawn, placed, planned)]}
    if split.leaking_clusters(planned).limit(1).count():
        raise RuntimeError("a cluster stands in two splits")
    if copy:
        plan = planned.select(F.concat(F.lit(config.project_root.rstrip("/") + "/"), "path").alias("source"), F.col("export_path").alias("target"))
        copied = sinks.stage(spark, f"{artifacts}/copied", lambda: sinks.copy_files(plan, config.overwrite_existing, verify=config.verify_hashes))
        if config.strict_mode:
            sinks.require_all(copied)
    # Looked up on each run: copies may have failed, and files may have changed since.
    found = {r["state"]: r["n"] for r in files.export_states(planned.where(manifest.is_complete(audit.REQUIRED))).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    damaged = {k: found.get(k, 0) for k in ("zero_byte", "unreadable", "changed")}
    report = sinks.audit_report(planned, config, found.get("missing", 0), sum(damaged.values()))
    report["not_decoded"] = rows.where(F.array_contains("quality_flag", "not_decoded")).count()
    report["integrity"] = {"missing": found.get("missing", 0), **damaged}
    sinks.write_json(spark, report, f"{artifacts}/audit_report.json")
    for name, table in sinks.audit_tables(planned, config).items():
        sinks.replace(table, f"{artifacts}/{name}")
    about = sinks.manifest_report(planned, asdict(config), config.dataset_version)
    sinks.write_json(spark, about, f"{artifacts}/manifest.json")
    sinks.write_readme(spark, about, f"{artifacts}/README.md")
    if config.strict_mode and report["verdict"] == "FAIL":
        raise RuntimeError("the audit failed")
    return report


def append(spark: SparkSession, old: str, new: DataFrame) -> DataFrame:
    """An earlier export manifest with the rows of a new run whose digests it lacks."""
    return manifest.merged(spark.read.parquet(old), new)
