"""Confusion matrices and what follows from them.

Predictions are (``run``, ``sample_id``, ``y_true``, ``y_pred``). One aggregate makes the cube of
counts by run and label pair; every metric comes from that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired(truth: DataFrame, predicted: DataFrame, key: str = "sample_id") -> DataFrame:
    """Joins labels and predictions by key; one without the other is left out."""
    return truth.join(predicted, key)


def cube(predictions: DataFrame) -> DataFrame:
    """(``run``, ``y_true``, ``y_pred``, ``n``); pairs with a NULL label are left out."""
    return predictions.where("y_true is not null and y_pred is not null").groupBy("run", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion(counts: DataFrame, labels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(``run``, ``y_true``, ``pred_0`` ...), only rows and columns of ``labels``; a label without samples has no row."""
    return counts.where(F.col("y_true").isin(*labels) & F.col("y_pred").isin(*labels)).groupBy("run", "y_true").agg(*[F.coalesce(F.sum(F.when(F.col("y_pred") == k, F.col("n"))), F.lit(0)).cast("long").alias(f"pred_{k}") for k in labels])


def confusion_pct(counts: DataFrame) -> DataFrame:
    """(``run``, ``y_true``, ``y_pred``, ``pct``): share of the true label's samples, in percent."""
    row = Window.partitionBy("run", "y_true")
    return counts.select("run", "y_true", "y_pred", F.round(F.col("n") * 100.0 / F.sum("n").over(row), 6).alias("pct"))


def class_report(counts: DataFrame) -> DataFrame:
    """(``run``, ``label``, ``precision``, ``recall``, ``f1``, ``support``) for each label that is true or predicted; 0 where a division has no meaning."""
    true = counts.groupBy("run", F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))).alias("tp"))
    pred = counts.groupBy("run", F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    both = true.join(pred, ["run", "label"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, r = share(zero("tp"), zero("predicted")), share(zero("tp"), zero("support"))
    f1 = share(2 * zero("tp"), zero("predicted") + zero("support"))
    return both.select("run", "label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), zero("support").cast("long").alias("support"))


def run_scores(counts: DataFrame) -> DataFrame:
    """(``run``, ``accuracy``, ``f1_macro``, ``samples``); macro F1 is the mean over labels that are true or predicted."""
    acc = counts.groupBy("run").agg(F.sum("n").alias("samples"), F.coalesce(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))), F.lit(0)).alias("hits"))
    f1 = class_report(counts).groupBy("run").agg(F.round(F.avg("f1"), 6).alias("f1_macro"))
    return acc.join(f1, "run").select("run", F.round(F.col("hits") / F.col("samples"), 6).alias("accuracy"), "f1_macro", "samples")


def boundary_errors(counts: DataFrame, a: int = 0, b: int = 2) -> DataFrame:
    """(``run``, ``boundary``, ``errors``, ``share``): errors between two classes, of all errors and all samples."""
    wrong = F.col("y_true") != F.col("y_pred")
    between = wrong & F.col("y_true").isin(a, b) & F.col("y_pred").isin(a, b)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    out = counts.groupBy("run").agg(total(between).alias("boundary"), total(wrong).alias("errors"), F.sum("n").alias("samples"))
    return out.select("run", "boundary", "errors", F.round(F.coalesce(F.try_divide(F.col("boundary").cast("double"), F.col("errors")), F.lit(0.0)), 6).alias("share_of_errors"), F.round(F.col("boundary") / F.col("samples"), 6).alias("share_of_samples"))


def present_labels(predictions: DataFrame) -> DataFrame:
    """(``label``): labels that are true or predicted."""
    return predictions.select(F.explode(F.array("y_true", "y_pred")).alias("label")).where("label is not null").distinct()


def expand(counts: DataFrame) -> DataFrame:
    """Back from counts to one row for each sample."""
    return counts.select("run", "y_true", "y_pred", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")).drop("i")
