"""Column types of the manifest and of the side tables, and the readers' normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.functions.text import blank_to_null, finite_score, folded, folded_source


#: The columns of the manifests and logs, in their order, and their types.
INDEX_COLUMNS = ("path", "dataset_source", "class_label", "width", "height", "aspect_ratio", "format", "file_size_bytes", "md5_hash", "sha256", "quality_score", "phash")
VALIDATED_COLUMNS = (*INDEX_COLUMNS, "quality_flag", "blur_score", "resolution_ok", "aspect_ratio_ok")
SPLIT_COLUMNS = (*VALIDATED_COLUMNS, "cluster_id", "split")
EXPORT_COLUMNS = (*SPLIT_COLUMNS, "export_path")

#: Manifest types; the text form of ``quality_flag`` is joined with "|" and "ok" when empty.
MANIFEST_DDL = (
    "path string, dataset_source string, class_label string, width int, height int, aspect_ratio double, format string, file_size_bytes bigint, "
    "md5_hash string, sha256 string, quality_score double, phash string, quality_flag string, blur_score double, resolution_ok boolean, aspect_ratio_ok boolean, "
    "cluster_id string, split string, export_path string"
)
EPOCH_DDL = "epoch int, train_loss double, train_acc double, val_loss double, val_acc double, val_f1_macro double, f1_real double, f1_ai_gen double, f1_ai_edit double"
SUMMARY_DDL = (
    "best_val_acc double, epochs_trained int, final_train_acc double, final_val_acc double, run_id string, config struct<epochs:int, batch_size:int, lr:double, optimizer:string, seed:int, "
    "weight_decay:double, loss_type:string, use_srm:boolean, use_fft:boolean, label_smoothing:double, class_weights:array<double>, dropout_p:double, dropout:double, lr_schedule:string, "
    "backbone:string, focal_gamma:double, augment:string, attention_head:string, gem_p:double, gem_learnable:boolean, cbam_reduction:int, cbam_kernel:int>"
)
LABELS = ("real", "ai_generated", "ai_edited")


def label_index(c: Column) -> Column:
    """0, 1, 2 for the three classes, else NULL."""
    return F.create_map(*[F.lit(x) for i, n in enumerate(LABELS) for x in (n, i)])[c]


def normal_form(rows: DataFrame) -> DataFrame:
    """Text keys in one spelling, blank text and NaN as NULL, flags as an array. Columns that are missing stay missing, others pass through."""
    kinds = dict(rows.dtypes)
    rules = {
        "dataset_source": folded_source(F.col("dataset_source")),
        "class_label": folded(F.col("class_label")),
        "md5_hash": folded(F.col("md5_hash")),
        "sha256": folded(F.col("sha256")),
        "phash": folded(F.col("phash")),
        "split": folded(F.col("split")),
        "format": blank_to_null(F.col("format")),
        "cluster_id": blank_to_null(F.col("cluster_id")),
        "quality_score": finite_score(F.col("quality_score")),
    }
    if kinds.get("quality_flag") == "string":
        rules["quality_flag"] = F.filter(F.split("quality_flag", r"\|"), lambda x: ~x.isin("ok", ""))
    elif "quality_flag" in kinds:
        rules["quality_flag"] = F.filter("quality_flag", lambda x: x != "ok")
    return rows.withColumns({c: e for c, e in rules.items() if c in kinds})
