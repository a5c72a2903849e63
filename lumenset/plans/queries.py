"""Registered queries: (session, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenset.config import Config, ImageRules
from lumenset.functions import images, kernels
from lumenset.operators import audit, dedup, epochs, evaluation, export, manifest, quality, sample, split
from lumenset.operators.drift import drift
from lumenset.schema import normal_form
from lumenset.scratch import Scratch
from lumenset.sources import sinks, tables

RULES = ImageRules(compression_heuristic=True)
TARGETS = {"real": 400, "ai_generated": 300, "ai_edited": 200}
BUCKET, THRESHOLD = 4, 8


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _m(spark: SparkSession, d: str, name: str = "deduped_index") -> DataFrame:
    return normal_form(_t(spark, d, name))


# Manifests and quality


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Flags and scores, exact deduplication, a quality bar, a class sample with soft source caps, counted by class and source."""
    rows = quality.validated(_m(spark, d), RULES)
    good = quality.passing(dedup.exact_kept(rows), 0.7)
    picked = sample.class_sample(good, TARGETS, 0.2)
    return picked.groupBy("class_label", "dataset_source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality_score"), 6).alias("avg_quality"))


def index_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").where("trim(text) <> ''")
    size = lambda c, by, m: (1 + (F.col(c) * by) % m).cast("int")
    rows = docs.select(
        F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"), F.coalesce("source", F.lit("none")).alias("dataset_source"),
        size("doc_id", 13, 1024).alias("width"), size("doc_id", 37, 768).alias("height"), F.octet_length("text").cast("long").alias("file_size_bytes"), F.md5("text").alias("md5_hash"), F.sha2("text", 256).alias("sha256"),
    )
    rows = rows.withColumn("aspect_ratio", quality.aspect_ratio(F.col("width"), F.col("height")))
    return manifest.with_labels(rows, {"issue_tracker": "real", "run_wiki": "ai_generated"})


def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.validated(_m(spark, d), RULES)
    return rows.select("row_idx", quality.flag_text(F.col("quality_flag")).alias("flags"), "quality_score", "resolution_ok", "aspect_ratio_ok")


def quality_by_group(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_by_group(_m(spark, d))


def flag_frequency(spark: SparkSession, d: str) -> DataFrame:
    return quality.flag_frequency(_m(spark, d))


def quality_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.filter_counts(_m(spark, d), 0.7)


def aspect_recomputed(spark: SparkSession, d: str) -> DataFrame:
    return _m(spark, d).select("row_idx", quality.aspect_ratio(F.col("width"), F.col("height")).alias("aspect_ratio"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    parts = {"name": manifest.base_name(p), "parent": manifest.parent_name(p), "stem": manifest.stem(p), "ext": manifest.extension(p), "is_image": manifest.is_image(p), "relative": manifest.relative_source(p, "data_sources"), "moved": manifest.moved_path(p, "data_sources", "upscaled", ".png")}
    return _t(spark, d, "deduped_index").select("row_idx", *[c.alias(n) for n, c in parts.items()])


def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "deduped_index").where(manifest.contains_any(F.col("path"), ("swap", "inpaint", "retouch"))).select("row_idx", "path")


def ingest_filter(spark: SparkSession, d: str) -> DataFrame:
    return _m(spark, d).where(manifest.ingest_ok(256, ("JPEG", "PNG")) & manifest.upload_ok(F.col("width"), F.col("height"), 1_000_000)).select("row_idx", "width", "height", "format")


def complete_rows(spark: SparkSession, d: str) -> DataFrame:
    ok = manifest.is_complete(audit.REQUIRED)
    return _m(spark, d, "export_index").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("malformed"))


# Deduplication


def exact_dedup_kept(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_kept(_m(spark, d)).select("row_idx", "path", "md5_hash")


def exact_dedup_removed(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_removed(_m(spark, d)).select("row_idx", "path", "md5_hash")


def dedup_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return dedup.all_conflicts(_m(spark, d), BUCKET, THRESHOLD)


def dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_summary(_m(spark, d), BUCKET, THRESHOLD)


def phash_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", kernels.vector_hash(F.col("embedding")).alias("hash"))


def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each image's hash to that of the one delivered next."""
    rows = _t(spark, d, "deduped_index").select("row_idx", "phash")
    other = rows.select((F.col("row_idx") - 1).alias("row_idx"), F.col("phash").alias("next"))
    return rows.join(other, "row_idx").select("row_idx", dedup.hamming(F.col("phash"), F.col("next")).alias("distance"))


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.bucket_pairs(_m(spark, d), BUCKET, THRESHOLD)


def near_dup_components(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_clusters(_m(spark, d), BUCKET, THRESHOLD).select("row_idx", "cluster_key")


def near_dup_kept(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_kept(_m(spark, d), BUCKET, THRESHOLD).select("row_idx")


def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cluster_stats(dedup.near_clusters(_m(spark, d), BUCKET, THRESHOLD, singles=True))


def cluster_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup.near_clusters(_m(spark, d), BUCKET, THRESHOLD, singles=True)
    return dedup.numbered_clusters(rows).select("row_idx", "cluster_id")


# Samples and splits


def class_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.class_sample(quality.passing(_m(spark, d), 0.7), TARGETS, 0.2).select("row_idx", "class_label", "dataset_source")


def global_cap_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.global_cap(_m(spark, d), 500).select("row_idx", "class_label")


def label_quota_ingest(spark: SparkSession, d: str) -> DataFrame:
    rows = _m(spark, d).where(manifest.ingest_ok(256))
    return sample.arrival_quota(rows, "class_label", "row_idx", 100, 250).select("row_idx", "class_label")


def limit_resume(spark: SparkSession, d: str) -> DataFrame:
    return sample.limit_resume(_t(spark, d, "deduped_index"), 900, 1000, "row_idx").select("row_idx")


def even_sample(spark: SparkSession, d: str) -> DataFrame:
    total = F.col("epochs_trained")
    return _t(spark, d, "training_summary").select("file_id", F.explode(sample.even_indices(total, 8)).alias("frame"))


def pair_list_explode(spark: SparkSession, d: str) -> DataFrame:
    pairs = _t(spark, d, "nation").select(F.concat(F.lit('[["'), "n_name", F.lit('","'), F.col("n_regionkey").cast("string"), F.lit('"]]')).alias("j"))
    return pairs.select(F.explode(manifest.pair_names(F.col("j"))).alias("name"))


def pair_list_head(spark: SparkSession, d: str) -> DataFrame:
    return manifest.preview(pair_list_explode(spark, d), "name", 20)


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "deduped_index").select("row_idx", sample.hash_split(F.col("path"), {"train": 0.7, "val": 0.15, "test": 0.15}).alias("split"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_idx").alias("sum_idx"))


def sized_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_partkey")
    return sample.sized_split(rows, "p_partkey", 0.2, up=True).groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))


def greedy_split(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup.near_clusters(split.usable_rows(_m(spark, d)), BUCKET, THRESHOLD, singles=True)
    return split.greedy_split(rows, {"train": 0.7, "val": 0.15, "test": 0.15}).select("row_idx", "cluster_key", "split")


def greedy_split_facts(spark: SparkSession, d: str) -> DataFrame:
    """One row of what must hold for the greedy split: no cluster divided, sizes within a hundredth of the ratios, each class within a twentieth of its images or two."""
    ratios = {"train": 0.7, "val": 0.15, "test": 0.15}
    rows = dedup.near_clusters(split.usable_rows(_m(spark, d)), BUCKET, THRESHOLD, singles=True)
    placed = Scratch(spark, "greedy").write(split.greedy_split(rows, ratios).select("cluster_key", "class_label", "split"), "placed")
    clusters = placed.groupBy("cluster_key").agg(F.count_distinct("split").alias("n")).agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") > 1).alias("divided"))
    goal = spark.createDataFrame(list(ratios.items()), "s string, ratio double")
    total = placed.agg(F.count(F.lit(1)).alias("images"), F.count_distinct("split").alias("splits"))
    sizes = placed.groupBy("split").agg(F.count(F.lit(1)).alias("n")).join(goal, F.col("split") == F.col("s")).crossJoin(total)
    far = sizes.agg(F.count_if(F.abs(F.col("n") / F.col("images") - F.col("ratio")) > 0.01).alias("far_splits"))
    whole = placed.groupBy(F.col("class_label").alias("c")).agg(F.count(F.lit(1)).alias("m"))
    each = whole.crossJoin(goal).join(placed.groupBy("class_label", "split").agg(F.count(F.lit(1)).alias("n")), (F.col("c") == F.col("class_label")) & (F.col("s") == F.col("split")), "left")  # classes x splits
    odd = each.agg(F.count_if(F.abs(F.coalesce("n", F.lit(0)) - F.col("m") * F.col("ratio")) > F.greatest(F.lit(2.0), F.col("m") * 0.05)).alias("far_classes"))
    return total.crossJoin(clusters).crossJoin(far).crossJoin(odd)  # single rows


def split_report(spark: SparkSession, d: str) -> DataFrame:
    rows = split.split_report(_m(spark, d, "split_index"))
    text = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), "|").alias(c)
    return rows.select("split", "clusters", "images", text("classes"), text("sources"))


def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    return split.leaking_clusters(_m(spark, d, "split_index"))


# Export, merge, patch


def export_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = export.capped(_m(spark, d, "split_index"), 200)
    return export.with_destination(rows).select("row_idx", "split", "destination")


def export_cap_compat(spark: SparkSession, d: str) -> DataFrame:
    rows = _m(spark, d, "split_index").withColumn("quality_score", F.round("quality_score", 1))
    return export.capped(rows, 200, compat=True).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("quality_score"), 6).alias("quality"))


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return export.split_counts(_m(spark, d, "split_index"))


def copy_rates(spark: SparkSession, d: str) -> DataFrame:
    return export.copy_rates(_m(spark, d, "split_index"), _t(spark, d, "export_index"))


def copy_plan(spark: SparkSession, d: str) -> DataFrame:
    return export.copy_plan(_t(spark, d, "export_index"), _t(spark, d, "split_index").select(F.col("path").alias("file")), "out")


def merge_manifests(spark: SparkSession, d: str) -> DataFrame:
    return manifest.merged(_m(spark, d, "export_index"), _m(spark, d, "split_index")).select("origin", "row_idx")


def merge_many(spark: SparkSession, d: str) -> DataFrame:
    """Two artifact folders, each with what was sampled and what was exported."""
    folders = [{"sampled": _m(spark, d, "sampled_index"), "export": _m(spark, d, "export_index")}, {"sampled": _m(spark, d), "export": _m(spark, d, "split_index")}]
    parts = [df.select(F.lit(k).alias("kind"), "folder", "row_idx") for k, df in manifest.merged_folders(folders).items()]
    return parts[0].unionByName(parts[1])


def dry_run_preview(spark: SparkSession, d: str) -> DataFrame:
    return manifest.preview(copy_plan(spark, d), "path")


def manifest_patch(spark: SparkSession, d: str) -> DataFrame:
    rows = _m(spark, d, "export_index")
    small = rows.where(F.array_contains("quality_flag", "low_resolution"))
    size = manifest.upscaled_size(F.col("width"), F.col("height"), 4)
    changes = small.select(F.col("export_path").alias("old"), manifest.moved_path(F.col("export_path"), "exports", "upscaled", ".png").alias("new"), *size)
    return manifest.patched(rows, changes).select("row_idx", "export_path", "width", "height", quality.flag_text(F.col("quality_flag")).alias("flags"))


def pending_outputs(spark: SparkSession, d: str) -> DataFrame:
    return manifest.pending(_t(spark, d, "deduped_index").select("path").distinct(), _t(spark, d, "export_index"), "path")


# Audit


def split_class_matrix(spark: SparkSession, d: str) -> DataFrame:
    return audit.split_matrix(_m(spark, d, "export_index"))


def split_source_matrix(spark: SparkSession, d: str) -> DataFrame:
    return audit.split_matrix(_m(spark, d, "export_index"), "dataset_source")


def imbalance_warnings(spark: SparkSession, d: str) -> DataFrame:
    return audit.imbalance(_m(spark, d, "export_index"))


def hash_leakage(spark: SparkSession, d: str) -> DataFrame:
    return audit.leakage(_m(spark, d, "export_index"))


def leakage_pairs(spark: SparkSession, d: str) -> DataFrame:
    return audit.leakage_pairs(_m(spark, d, "export_index"))


def quality_stats(spark: SparkSession, d: str) -> DataFrame:
    return audit.quality_stats(_m(spark, d))


def quality_histogram(spark: SparkSession, d: str) -> DataFrame:
    return audit.histogram(_m(spark, d), "quality_score")


def anomalies(spark: SparkSession, d: str) -> DataFrame:
    return audit.anomalies(_m(spark, d, "export_index"), export_root="exports/v2")


def audit_verdict(spark: SparkSession, d: str) -> DataFrame:
    return audit.verdict(_m(spark, d, "export_index"), Config(min_quality_score=0.7))


def duplicate_paths(spark: SparkSession, d: str) -> DataFrame:
    return audit.repeated(_t(spark, d, "export_index"), "export_path")


# Evaluation


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    return e.select(F.concat(F.lit("run_"), (F.col("vec_id") % 4).cast("string")).alias("run"), F.col("vec_id").alias("sample_id"), (F.col("label") % 3).cast("int").alias("y_true"), (kernels.argmax(F.col("embedding")) % 3).alias("y_pred"))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(evaluation.cube(_predictions(spark, d)))


def confusion_row_pct(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion_pct(evaluation.cube(_predictions(spark, d)))


def class_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.class_report(evaluation.cube(_predictions(spark, d)))


def accuracy_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.run_scores(evaluation.cube(_predictions(spark, d)))


def boundary_errors(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.boundary_errors(evaluation.cube(_predictions(spark, d)))


def positional_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _predictions(spark, d)
    return evaluation.paired(p.select("sample_id", "y_true"), p.select("sample_id", "y_pred"))


def present_labels(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.present_labels(_predictions(spark, d))


def accuracy_bars(spark: SparkSession, d: str) -> DataFrame:
    return epochs.bars(evaluation.run_scores(evaluation.cube(_predictions(spark, d))), "accuracy")


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return Scratch(spark, name).root


def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as CSV and read again in the types of its columns."""
    place = _folder(spark, "manifest-csv")
    sinks.write_manifest(_m(spark, d).drop("indexed_at"), place)
    back = normal_form(tables.read_manifest(spark, place))
    return back.select(F.col("row_idx").cast("long").alias("row_idx"), "path", "dataset_source", "class_label", "width", "height", "aspect_ratio", "file_size_bytes", "md5_hash", "quality_score", "phash", "blur_score", "resolution_ok", quality.flag_text(F.col("quality_flag")).alias("flags"))


def predictions_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as two arrays for each run and read again; the position stands for the sample."""
    place = _folder(spark, "predictions")
    written = Scratch(spark, "written").write(sinks.write_predictions(_predictions(spark, d), place.removeprefix("file://")), "runs")
    return tables.read_predictions(spark, place).join(written, "run").select("run", "sample_id", "y_true", "y_pred", "samples")


def epoch_logs_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A folder of CSV files for each run."""
    place = _folder(spark, "logs")
    log = _log(spark, d)
    blank = [F.lit(None).cast("double").alias(c) for c in ("val_f1_macro", "f1_real", "f1_ai_gen", "f1_ai_edit")]
    log.select("run", "epoch", "train_loss", "train_acc", "val_loss", "val_acc", *blank).write.partitionBy("run").option("header", True).csv(place)
    back = tables.read_epochs(spark, f"{place}/*/*.csv").withColumn("run", F.regexp_replace("run", "^run=", ""))
    return back.select("run", "epoch", "train_loss", "val_acc")


# Epoch logs and runs


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    acc = lambda lo: F.round(F.avg((F.col("value") > lo).cast("double")), 6)
    return e.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch")).agg(acc(30).alias("train_acc"), acc(50).alias("val_acc"), F.round(F.avg("value"), 6).alias("val_loss"), F.round(F.max("value"), 6).alias("train_loss"))


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    """One row for each file; ``run`` is unique by its file."""
    t = _t(spark, d, "training_summary")
    return t.select(F.concat_ws("_", "series", "run_no", "file_id").alias("run"), "best_val_acc", "epochs_trained", F.col("file_id").alias("position"), "summary_json", "run_id")


def epoch_weighted_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    batches = e.select(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"), F.col("value").alias("loss"), (F.col("user_id") % 5).alias("correct"), (F.lit(5) + F.col("event_id") % 3).alias("n"))
    return epochs.epoch_metrics(batches)


def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    return epochs.best_epoch(_log(spark, d))


def running_best(spark: SparkSession, d: str) -> DataFrame:
    return epochs.running_best(_log(spark, d)).select("run", "epoch", "best_before", "improved")


def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return epochs.early_stop(_log(spark, d), 5)


def overfit_gap(spark: SparkSession, d: str) -> DataFrame:
    return epochs.overfit_gap(_log(spark, d))


def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    some = log.select("run").distinct().where("run <> 'click'").withColumn("best_val_acc", F.lit(None).cast("double")).withColumn("epochs_trained", F.lit(12))
    return epochs.with_summary(log, some)


def run_filter(spark: SparkSession, d: str) -> DataFrame:
    return epochs.select_runs(_log(spark, d), ("click", "purchase", "view"), ("view",)).select("run", "epoch", "val_acc")


def curves(spark: SparkSession, d: str) -> DataFrame:
    return epochs.long_form(_log(spark, d))


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return epochs.leaderboard(_summaries(spark, d).select("run", "best_val_acc", "position")).select("run", "rank", "shown")


def top2_runs(spark: SparkSession, d: str) -> DataFrame:
    return epochs.top_runs(_summaries(spark, d).select("run", "best_val_acc"), "best_val_acc")


def palette(spark: SparkSession, d: str) -> DataFrame:
    return epochs.palette(_summaries(spark, d))


def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return epochs.latest_run(_summaries(spark, d), "run_id")


def run_dir_from_path(spark: SparkSession, d: str) -> DataFrame:
    r = _summaries(spark, d)
    path = F.when(F.col("position") % 3 == 0, F.concat(F.lit("/x/"), "run_id", F.lit("/best.pth"))).when(F.col("position") % 3 == 1, F.concat(F.lit("models/"), "run", F.lit(".pth"))).otherwise(F.concat(F.lit("models/exp/"), "run", F.lit(".pth")))
    return r.select("position", epochs.run_folder(path).alias("folder"), F.date_format(epochs.run_time(F.col("run_id")), "yyyy-MM-dd HH:mm:ss").alias("at"))


def summary_defaults(spark: SparkSession, d: str) -> DataFrame:
    return _summaries(spark, d).select("position", *epochs.summary_defaults(F.col("summary_json")))


def arch_inference(spark: SparkSession, d: str) -> DataFrame:
    """Weights named after the parts' types and sizes."""
    p = _t(spark, d, "part")
    key = F.when(F.col("p_size") > 40, "features.5.20.w").when(F.col("p_size") > 25, "_orig_mod.features.1").when(F.col("p_size") > 10, "fc.1.weight").otherwise("layer1.conv")
    named = F.create_map(key, F.when(F.col("p_partkey") % 2 == 0, 2048).otherwise(512), F.when(F.col("p_partkey") % 3 == 0, "srm.kernels").otherwise("bn.bias"), F.lit(3))
    return p.select("p_partkey", epochs.architecture(named).alias("a")).select("p_partkey", "a.*")


def name_conflicts(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "training_summary").select(F.concat(F.lit("x__"), F.when(F.col("file_id") % 2 == 0, "srm-gem").otherwise("cbam")).alias("run"), "file_id", F.when(F.col("file_id") % 5 == 0, "gem").alias("attention_head"))
    return epochs.name_conflicts(t)


def _run_counts(spark: SparkSession, d: str) -> DataFrame:
    named = F.element_at(F.create_map(*[F.lit(x) for kv in zip(("run_0", "run_1", "run_2"), ("click", "purchase", "view")) for x in kv]), F.col("run"))
    return evaluation.cube(_predictions(spark, d).withColumn("run", F.coalesce(named, F.lit("other"))))


def run_table(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    some = log.select("run").distinct().where("run <> 'click'").withColumn("best_val_acc", F.lit(None).cast("double")).withColumn("epochs_trained", F.lit(12))
    return epochs.comparison(log, some, _run_counts(spark, d))


def sweep_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Configurations named after the nations; four of them were evaluated."""
    k = F.col("n_nationkey")
    runs = _t(spark, d, "nation").select(F.concat(F.lit("run_"), k.cast("string")).alias("run"), F.array(F.col("n_regionkey") + 0.5, F.lit(1.0), F.lit(2.5)).alias("weights"), F.when(k % 5 != 0, (k % 7) / 10).alias("best_val_acc"), k.alias("position"))
    return epochs.sweep_table(runs, evaluation.cube(_predictions(spark, d))).select("rank", "shown", "weights", "best_val_acc", "f1_macro", "f1_real", "f1_ai_gen", "f1_ai_edit")


def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("run", "epoch", F.round(epochs.cosine_restarts(F.col("epoch") - 1, 0.001, 5), 9).alias("rate"))


def lr_plateau(spark: SparkSession, d: str) -> DataFrame:
    per_run = _log(spark, d).groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "val_loss"))), lambda x: x["val_loss"]).alias("losses"))
    return per_run.select("run", F.posexplode(epochs.plateau_rates(F.col("losses"), 0.001)).alias("step", "rate"))


# Array kernels


def _e(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))


def _logits() -> Column:
    return F.slice("e", 1, 3)


def _flat(df: DataFrame, array: Column, name: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(array).alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias(name))


def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    p = kernels.softmax(_logits())
    return _e(spark, d).select("vec_id", kernels.argmax(_logits()).alias("top"), F.round(F.array_max(p), 6).alias("p_top"), F.round(F.get(p, F.lit(0)), 6).alias("p_0"))


def cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    t, w = F.col("label") % 3, (1.5, 1.0, 1.5)
    e = _e(spark, d).withColumn("t", t.cast("int"))
    ce = kernels.cross_entropy(_logits(), F.col("t"), w, 0.1)
    return e.groupBy("t").agg(F.round(kernels.weighted_mean_loss(ce, F.col("t"), w), 6).alias("loss"), F.round(F.avg(kernels.cross_entropy(_logits(), F.col("t"))), 6).alias("plain"))


def focal_loss(spark: SparkSession, d: str) -> DataFrame:
    t = (F.col("label") % 3).cast("int")
    return _e(spark, d).select("vec_id", F.round(kernels.focal(_logits(), t, 3.0, (1.5, 1.0, 1.5), 0.1), 6).alias("loss"))


def gem_pool(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).select("vec_id", F.round(kernels.gem_pool(F.col("e")), 6).alias("gem"))


def channel_concat_pad(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_e(spark, d), kernels.concat_channels([F.slice("e", 1, 32), F.slice("e", 33, 32)], 3), "value")


def cam_from_arrays(spark: SparkSession, d: str) -> DataFrame:
    maps = F.array(F.slice("e", 1, 16), F.slice("e", 17, 16))
    grads = F.array(F.slice("e", 33, 16), F.slice("e", 49, 16))
    return _flat(_e(spark, d), kernels.class_activation(maps, grads), "cam")


def overlay_blend(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_e(spark, d), kernels.blend(F.slice("e", 1, 32), F.slice("e", 33, 32)), "value")


def normalize_vector(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_e(spark, d), kernels.normalise(F.col("e")), "value")


def minmax_group(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_e(spark, d), kernels.minmax(F.col("e")), "value")


def flip_and_brighten(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_e(spark, d), kernels.brightness(kernels.flip_rows(F.col("e"), 8), 100.0, 20.0), "value")


def brightness_predictor(spark: SparkSession, d: str) -> DataFrame:
    mean = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.abs(x)) * 4
    return _flat(_e(spark, d), kernels.brightness_predictor(mean), "p")


def srm_row(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_e(spark, d), kernels.correlate_1d(F.col("e"), (-0.5, 1.0, -0.5)), "residual")


def _plane(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).withColumn("h", F.lit(8)).withColumn("w", F.lit(8))


def srm_residual(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_plane(spark, d), images.srm("e", "h", "w"), "residual")


def fft_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_plane(spark, d), images.spectrum("e", "h", "w"), "magnitude")


def blur_score(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d).select("vec_id", F.round(images.blur_score("e", "h", "w"), 6).alias("blur"))


def srm_six_channels(spark: SparkSession, d: str) -> DataFrame:
    """Three planes made of each vector: as it is, backwards, and halved."""
    rgb = F.concat("e", F.reverse("e"), F.transform("e", lambda v: v * 0.5))
    return _flat(_plane(spark, d), images.planes_function(images.srm_six_channels, 3)(rgb, "h", "w"), "value")


#: Weights of the attention query, two hidden units for four channels.
ATTENTION = (((0.5, -0.25, 0.75, 0.1), (0.2, 0.3, -0.4, 0.6)), ((0.3, 0.7), (0.5, -0.2), (-0.6, 0.4), (0.1, 0.9)))


def channel_attention(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as four maps of 4 x 4."""
    gate = images.attention(*(np.array(w) for w in ATTENTION))
    return _flat(_e(spark, d), gate("e", F.lit(4), F.lit(4)), "value")


def cam_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The chain for one image: predicted class, activation map, and the map resized, coloured and laid over the image."""
    maps = F.array(F.slice("e", 1, 16), F.slice("e", 17, 16))
    grads = F.array(F.slice("e", 33, 16), F.slice("e", 49, 16))
    image = F.flatten(F.transform("e", lambda v: F.array(F.abs(v) * 100, F.abs(v) * 50, F.lit(20.0))))
    shown = kernels.heat_overlay(image, 8, 8, kernels.class_activation(maps, grads), 4, 4)
    out = _e(spark, d).select("vec_id", kernels.argmax(F.col("e")).alias("top"), F.posexplode(shown).alias("pos", "v"))
    return out.select("vec_id", "top", "pos", F.round("v", 4).alias("value"))


# Schema drift


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return drift(_t(spark, d, "training_summary"))[1]


def p7_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift(_t(spark, d, "training_summary"))[0]


_NAMED = (
    flagship, index_manifest, quality_flags, quality_by_group, flag_frequency, quality_filter_counts, aspect_recomputed, path_parts, keyword_filter, ingest_filter, complete_rows,
    exact_dedup_kept, exact_dedup_removed, dedup_conflicts, dedup_summary, phash_vectors, hamming_pairs, near_dup_pairs, near_dup_components, near_dup_kept, cluster_stats, cluster_numbers,
    class_sample, global_cap_sample, label_quota_ingest, limit_resume, even_sample, pair_list_explode, hash_split, sized_split, greedy_split, greedy_split_facts, split_report, leakage_check,
    merge_many, dry_run_preview, pair_list_head, accuracy_bars, manifest_round_trip, predictions_round_trip, epoch_logs_round_trip, run_table, sweep_ranking, srm_six_channels, channel_attention, cam_overlay,
    export_plan, export_cap_compat, split_counts, copy_rates, copy_plan, merge_manifests, manifest_patch, pending_outputs,
    split_class_matrix, split_source_matrix, imbalance_warnings, hash_leakage, leakage_pairs, quality_stats, quality_histogram, anomalies, audit_verdict, duplicate_paths,
    confusion_matrix, confusion_row_pct, class_report, accuracy_macro_f1, boundary_errors, positional_pairs, present_labels,
    epoch_weighted_metrics, best_epoch, running_best, early_stop, overfit_gap, run_comparison, run_filter, curves, leaderboard, top2_runs, palette, latest_run, run_dir_from_path, summary_defaults, arch_inference, name_conflicts, lr_schedule, lr_plateau,
    softmax_argmax, cross_entropy, focal_loss, gem_pool, channel_concat_pad, cam_from_arrays, overlay_blend, normalize_vector, minmax_group, flip_and_brighten, brightness_predictor, srm_row, srm_residual, fft_magnitude, blur_score,
    p7_found, p7_unified,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMED}
