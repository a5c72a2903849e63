"""Registered queries of this package: (session, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenset.functions.text import folded, folded_source, token_count, valid_phash
from lumenset.llm import capping, content, matches, mixing, overlap, packing, splits, stratified
from lumenset.llm.ballhash import image_pairs, near_groups
from lumenset.scratch import Scratch


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return matches.match_groups(_t(spark, d, "match_pairs"), _t(spark, d, "deduped_index"))


def p1_image_groups(spark: SparkSession, d: str) -> DataFrame:
    return matches.grouped_images(_t(spark, d, "match_pairs"), _t(spark, d, "deduped_index"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "split_index")
    groups = Scratch(spark, "p2").write(splits.related_groups(rows), "groups")
    return splits.split_conflicts(rows, groups)


def p2_new_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_splits(_t(spark, d, "split_index"), _t(spark, d, "split_targets"))


def p2_facts(spark: SparkSession, d: str) -> DataFrame:
    """One row of what must hold for the new splits."""
    rows, targets = _t(spark, d, "split_index"), _t(spark, d, "split_targets")
    placed = Scratch(spark, "p2-facts").write(splits.stratified_splits(rows, targets), "placed")
    groups = placed.groupBy("group_path").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("divided_groups"), F.count(F.lit(1)).alias("groups"))
    images = placed.agg(F.count(F.lit(1)).alias("images"), F.count_distinct("path").alias("paths"), F.count_distinct("split").alias("splits"))
    # Each label in each split within a hundredth of the label's images, or five.
    off = splits.split_shares(placed, rows, targets)
    whole = off.groupBy("label").agg(F.sum("images").alias("total"))
    far = off.join(whole, off["label"].eqNullSafe(whole["label"])).agg(F.count_if(F.abs("off") > F.greatest(F.lit(5.0), F.col("total") * 0.01)).alias("far_shares"))
    return images.crossJoin(groups).crossJoin(far)  # single rows


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    rows, targets = _t(spark, d, "split_index"), _t(spark, d, "split_targets")
    return splits.split_shares(splits.stratified_splits(rows, targets), rows, targets)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(_t(spark, d, "export_index")).select("path_a", "path_b")


def p3_overlap_by_record(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_by_record(_t(spark, d, "export_index"))


def p3_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_t(spark, d, "export_index"))


def p3_text_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """The texts of every hundredth document against those of all others."""
    return overlap.document_overlaps(_t(spark, d, "documents"), F.col("doc_id") % 100 == 0)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return capping.capped_images(_t(spark, d, "sampled_index")).where("not kept").select(F.col("key").alias("path")).distinct()


def p4_kept_by_output_share(spark: SparkSession, d: str) -> DataFrame:
    kept = capping.capped_images(_t(spark, d, "sampled_index"), of_output=True).where("kept")
    return kept.select("source", F.col("key").alias("path"), "score")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    drawn = stratified.draw_sample(_t(spark, d, "sampled_index"), _t(spark, d, "stratum_targets"))
    return drawn.report.where("short").select("stratum_id")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return stratified.draw_sample(_t(spark, d, "sampled_index"), _t(spark, d, "stratum_targets")).sample


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return stratified.draw_sample(_t(spark, d, "sampled_index"), _t(spark, d, "stratum_targets")).report.drop("short")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the sample itself holds of each stratum: images, different ones, and those that are filed elsewhere."""
    rows, targets = _t(spark, d, "sampled_index"), _t(spark, d, "stratum_targets")
    sample = stratified.draw_sample(rows, targets).sample
    filed = rows.select("path", folded(F.col("class_label")).alias("label"), folded_source(F.col("dataset_source")).alias("source")).distinct()
    strata = targets.select("stratum_id", folded(F.col("class_label")).alias("label"), folded_source(F.col("dataset_source")).alias("source"))
    own = filed.join(strata, ["label", "source"]).select("stratum_id", "path", F.lit(True).alias("own"))
    each = sample.join(own, ["stratum_id", "path"], "left").groupBy("stratum_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"), F.count_if(F.col("own").isNull()).alias("foreign"))
    return strata.select("stratum_id").join(each, "stratum_id", "left").na.fill(0)


def _hashed_images(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "deduped_index").select("path", valid_phash(F.col("phash")).alias("h"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return image_pairs(_hashed_images(spark, d)).select("path_a", "path_b")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every image with its near-duplicate group and its number of near images."""
    return near_groups(_hashed_images(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.cut_documents(packing.pack_documents(_t(spark, d, "documents")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_t(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(packing.pack_documents(_t(spark, d, "documents")))


def p8_facts(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return packing.packing_facts(docs, Scratch(spark, "p8-facts").write(packing.pack_documents(docs), "packed"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets")).report.where("short").select("source")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets")).chosen


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets")).report


def p9_facts(spark: SparkSession, d: str) -> DataFrame:
    """For each target source what must hold for the mixture: documents repeated too often, filed elsewhere or with another size, and whether its tokens are off their target by more than two of its largest documents (the cube method leaves two undecided)."""
    docs, targets = _t(spark, d, "documents"), _t(spark, d, "mix_targets")
    mixed = mixing.mix_sources(docs, targets)
    sizes = docs.select(F.col("doc_id").alias("id"), folded(F.col("source")).alias("own"), token_count(F.col("text")).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    plan = targets.select("source", folded(F.col("source")).alias("name"), "target_permille", "max_repeats")
    held = mixed.chosen.select("doc_id", F.col("source").alias("of"), "copies", "tokens").join(sizes, F.col("doc_id") == F.col("id"), "left").join(plan, folded(F.col("of")) == F.col("name"))
    each = held.groupBy("name").agg(
        F.count_if(F.col("copies") > F.col("max_repeats")).alias("too_often"), F.count_if(~F.col("own").eqNullSafe(F.col("name"))).alias("foreign"), F.count_if(~F.col("n").eqNullSafe(F.col("tokens"))).alias("missized"),
        (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("twice"), F.sum(F.col("copies") * F.col("tokens")).alias("drawn"),
    )
    have = sizes.groupBy(F.col("own").alias("name")).agg(F.sum("n").alias("available"), F.max("n").alias("largest"))
    out = plan.join(each, "name", "left").join(have, "name", "left").crossJoin(total).na.fill(0)  # one row of totals
    short = F.col("available") * F.col("max_repeats") * 1000 < F.col("target_permille") * F.col("total")
    off = F.abs(F.col("drawn") * 1000 - F.when(short, F.col("available") * F.col("max_repeats") * 1000).otherwise(F.col("target_permille") * F.col("total"))) > F.col("largest") * 2000
    return out.select("source", short.alias("short"), "too_often", "foreign", "missized", "twice", off.alias("off"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return content.score_texts(docs, content.train_scorer(docs, _t(spark, d, "content_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("score >= 0.5").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return content.rates_by_source(_scored(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_image_groups, p2_found, p2_new_splits, p2_facts, p2_shares, p3_found, p3_overlap_by_record, p3_overlap_report, p3_text_overlaps, p4_found, p4_kept_by_output_share, p5_found, p5_sample, p5_report, p5_counts, p6_found, p6_groups, p8_found, p8_containers, p8_fill, p8_facts, p9_found, p9_mixture, p9_report, p9_facts, p10_found, p10_scores, p10_rates]
    return {f.__name__: f for f in named}
