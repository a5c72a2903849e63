"""Analyses of epoch logs and run summaries.

A log is (``run``, ``epoch``, ``train_loss``, ``train_acc``, ``val_loss``, ``val_acc``). A window covers one
run, and a run has as many rows as it was trained epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenset.operators.ranking import grouped_rank


def _run() -> Window:
    return Window.partitionBy("run").orderBy("epoch")


def epoch_metrics(batches: DataFrame) -> DataFrame:
    """(``run``, ``epoch``, ``loss``, ``acc``, ``n``) from batches (``loss``, ``correct``, ``n``): means weighted by batch size."""
    total = F.sum("n")
    return batches.groupBy("run", "epoch").agg(F.round(F.try_divide(F.sum(F.col("loss") * F.col("n")), total), 6).alias("loss"), F.round(F.try_divide(F.sum("correct").cast("double"), total), 6).alias("acc"), total.alias("n"))


def best_epoch(log: DataFrame) -> DataFrame:
    """(``run``, ``epoch``, ``val_acc``): the first epoch with the highest accuracy; NULL and NaN never win."""
    acc = F.nanvl("val_acc", F.lit(None).cast("double"))
    return log.where(acc.isNotNull()).groupBy("run").agg(F.max(F.struct(acc.alias("a"), (-F.col("epoch")).alias("e"))).alias("b")).select("run", (-F.col("b.e")).alias("epoch"), F.col("b.a").alias("val_acc"))


def running_best(log: DataFrame) -> DataFrame:
    """Adds ``best_before`` (0 at first) and ``improved`` (strictly above it)."""
    before = F.coalesce(F.max("val_acc").over(_run().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = log.withColumn("best_before", F.greatest(before, F.lit(0.0)))
    return out.withColumn("improved", F.coalesce(F.col("val_acc") > F.col("best_before"), F.lit(False)))


def early_stop(log: DataFrame, patience: int = 7) -> DataFrame:
    """(``run``, ``stop_epoch``, ``stopped``): the first epoch with ``patience`` epochs since the last improvement; else the last one."""
    marked = running_best(log).withColumn("nth", F.row_number().over(_run()))
    last = F.coalesce(F.max(F.when(F.col("improved"), F.col("nth"))).over(_run().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    due = marked.withColumn("due", F.col("nth") - last >= patience)
    out = due.groupBy("run").agg(F.min(F.when(F.col("due"), F.col("epoch"))).alias("s"), F.max("epoch").alias("l"))
    return out.select("run", F.coalesce("s", "l").alias("stop_epoch"), F.col("s").isNotNull().alias("stopped"))


def overfit_gap(log: DataFrame) -> DataFrame:
    """(``run``, ``gap``): training minus validation accuracy at the last epoch."""
    return log.groupBy("run").agg(F.round(F.max_by(F.col("train_acc") - F.col("val_acc"), "epoch"), 6).alias("gap"))


def leaderboard(runs: DataFrame, score: str = "best_val_acc", order: str = "position") -> DataFrame:
    """Adds ``rank`` (missing scores count as 0, ties keep the order of input) and ``shown``: the name, with ``*`` before the first."""
    ranked = grouped_rank(runs.withColumn("__s", F.coalesce(F.col(score), F.lit(0.0))), [], [F.col("__s").desc(), F.col(order)], "rank").drop("__s")
    return ranked.withColumn("shown", F.concat(F.when(F.col("rank") == 1, "*").otherwise(""), F.col("run")))


def top_runs(runs: DataFrame, score: str, n: int = 2) -> DataFrame:
    return runs.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), "run").limit(n)


def select_runs(runs: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Runs whose name is included (all, without any) and not excluded."""
    out = runs.where(F.col("run").isin(*include)) if include else runs
    return out.where(~F.col("run").isin(*exclude)) if exclude else out


def with_summary(log: DataFrame, summary: DataFrame) -> DataFrame:
    """(``run``, ``best_val_acc``, ``epochs_trained``): from the summary where it has them, else from the log."""
    own = log.groupBy("run").agg(F.max("val_acc").alias("__best"), F.count(F.lit(1)).alias("__n"))
    out = own.join(summary.select("run", "best_val_acc", "epochs_trained"), "run", "left")
    return out.select("run", F.coalesce("best_val_acc", "__best").alias("best_val_acc"), F.coalesce(F.col("epochs_trained").cast("long"), "__n").alias("epochs_trained"))


def comparison(log: DataFrame, summary: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each logged run: ``best_val_acc`` and ``epochs_trained`` (from the summary if it has them), ``gap`` of the last epoch, ``accuracy``, ``f1_macro`` and ``f1_0`` to ``f1_2`` of its
    evaluation (NULL without one), and ``rank`` by best validation accuracy, ties by name.

    ``counts``: the cube of predictions. Runs without a log are left out.
    """
    from lumenset.operators import evaluation

    per_class = evaluation.class_report(counts).groupBy("run").agg(*[F.max(F.when(F.col("label") == k, F.col("f1"))).alias(f"f1_{k}") for k in range(3)])
    out = with_summary(log, summary).join(overfit_gap(log), "run").join(evaluation.run_scores(counts).select("run", "accuracy", "f1_macro"), "run", "left").join(per_class, "run", "left")
    ranked = grouped_rank(out.withColumn("__s", F.coalesce("best_val_acc", F.lit(0.0))), [], [F.col("__s").desc(), F.col("run")], "rank")
    return ranked.drop("__s")


def bars(runs: DataFrame, score: str) -> DataFrame:
    """(``run``, score, ``position``): runs that have the score, from the lowest bar to the highest, ties by name."""
    ranked = grouped_rank(runs.select("run", score).where(F.col(score).isNotNull()), [], [F.col(score), F.col("run")], "position")
    return ranked.withColumn("position", F.col("position") - 1)


def sweep_table(summary: DataFrame, counts: DataFrame) -> DataFrame:
    """The ranked table of a sweep over class weights: ``rank``, ``shown``, ``weights`` as text, ``best_val_acc`` and the F1 scores of each configuration.

    ``summary``: ``run``, ``weights`` (array), ``best_val_acc``, ``position``. A configuration that was not evaluated has no F1 scores, one that was not trained ranks last.
    """
    from lumenset.operators import evaluation

    per_class = evaluation.class_report(counts).groupBy("run").agg(F.round(F.avg("f1"), 6).alias("f1_macro"), *[F.max(F.when(F.col("label") == k, F.col("f1"))).alias(f"f1_{n}") for k, n in enumerate(("real", "ai_gen", "ai_edit"))])
    text = F.concat(F.lit("["), F.array_join(F.transform("weights", lambda w: w.cast("string")), ","), F.lit("]"))
    return leaderboard(summary.join(per_class, "run", "left").withColumn("weights", F.coalesce(text, F.lit("?"))))


def summary_defaults(json_text: Column) -> list[Column]:
    """Fields of a run summary with the defaults of older generations; text that is no JSON gives the defaults."""
    get = lambda p: F.try_variant_get(F.try_parse_json(json_text), f"$.config.{p}", "string")
    number = lambda p: F.try_variant_get(F.try_parse_json(json_text), f"$.config.{p}", "double")
    return [
        F.coalesce(get("backbone"), F.lit("resnet18")).alias("backbone"),
        F.coalesce(number("dropout_p"), number("dropout"), F.lit(0.0)).alias("dropout"),
        F.coalesce(get("lr_schedule"), F.lit("none")).alias("lr_schedule"),
        F.coalesce(get("augment"), F.lit("none")).alias("augment"),
    ]


def display_name(name: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), name), name) if names else name


def run_folder(model_path: Column) -> Column:
    """``run_<date>_<time>`` if the path holds it, else the folder of the file, else (for ``models`` or none) its stem."""
    found = F.nullif(F.regexp_extract(model_path, r"(run_\d{8}_\d{6})", 1), F.lit(""))
    parts = F.split(model_path, "/")
    folder = F.try_element_at(parts, F.lit(-2))
    name = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.coalesce(found, F.when(~folder.isin("models", "", "."), folder), name)


def run_time(run: Column) -> Column:
    """Timestamp in a run's name, NULL for other names."""
    return F.try_to_timestamp(F.regexp_extract(run, r"^run_(\d{8}_\d{6})$", 1), F.lit("yyyyMMdd_HHmmss"))


def latest_run(names: DataFrame, name: str = "run") -> DataFrame:
    return names.where(F.col(name).rlike(r"^run_\d{8}_\d{6}$")).agg(F.max(name).alias("latest"))


def architecture(weights: Column) -> Column:
    """struct<arch, srm, fft, sequential_head> told by a map from names of weights to the size of their last dimension."""
    keys = F.transform(F.map_keys(weights), lambda k: F.regexp_replace(k, r"^_orig_mod\.", ""))
    has = lambda p: F.exists(keys, lambda k: k.rlike(p))
    wide = F.exists(F.map_entries(weights), lambda e: e["key"].contains("fc") & e["key"].contains("weight") & (e["value"] == 2048))
    arch = F.when(has(r"features\.5\.20"), "convnext_small").when(has(r"features\."), "convnext_tiny").when(wide, "resnet50").otherwise("resnet18")
    return F.struct(arch.alias("arch"), has("(?i)srm").alias("srm"), has("(?i)fft").alias("fft"), has(r"(fc\.1|classifier\.2\.1)\.weight$").alias("sequential_head"))


def name_conflicts(runs: DataFrame, heads: tuple[str, ...] = ("gem", "cbam")) -> DataFrame:
    """Runs whose name holds an attention head that their recorded configuration lacks."""
    said = F.lit(None).cast("string")
    for h in heads:
        said = F.when(F.col("run").rlike(rf"(^|[-_]){h}($|[-_])"), h).otherwise(said)
    return runs.withColumn("named", said).where("named is not null and coalesce(attention_head, 'none') <> named")


def cosine_restarts(epoch: Column, rate: float, first: int = 20, growth: int = 2) -> Column:
    """Rate of an epoch (from 0) under cosine annealing with restarts; cycle i has ``first * growth**i`` epochs."""
    if growth == 1:
        length, at = F.lit(float(first)), epoch % first
    else:
        i = F.floor(F.log(float(growth), epoch * (growth - 1) / F.lit(float(first)) + 1 + 1e-12))
        length = first * F.pow(F.lit(float(growth)), i)
        at = epoch - first * (F.pow(F.lit(float(growth)), i) - 1) / (growth - 1)
    return rate / 2 * (1 + F.cos(F.lit(3.141592653589793) * at / length))


def plateau_rates(losses: Column, rate: float, factor: float = 0.5, patience: int = 2, threshold: float = 1e-4) -> Column:
    """Rate after each of an ordered array of losses: more than ``patience`` epochs without a relative improvement lower it."""
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(rate).alias("rate"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        better = F.coalesce(v < acc["best"] * (1 - threshold), acc["best"].isNull())
        bad = F.when(better, 0).otherwise(acc["bad"] + 1)
        drop = bad > patience
        new = F.when(drop, acc["rate"] * factor).otherwise(acc["rate"])
        return F.struct(F.when(better, v).otherwise(acc["best"]).alias("best"), F.when(drop, 0).otherwise(bad).alias("bad"), new.alias("rate"), F.concat(acc["out"], F.array(new)).alias("out"))

    return F.aggregate(losses, start, step, lambda acc: acc["out"])


def palette(runs: DataFrame, size: int = 10) -> DataFrame:
    """(``run``, ``color``): position in name order modulo the palette's size."""
    return grouped_rank(runs.select("run").distinct(), [], [F.col("run")], "n").select("run", ((F.col("n") - 1) % size).cast("int").alias("color"))


def long_form(log: DataFrame, metrics: tuple[str, ...] = ("train_loss", "val_loss", "train_acc", "val_acc")) -> DataFrame:
    """(``run``, ``epoch``, ``metric``, ``value``) for plotting; metrics that the log lacks are left out."""
    held = [m for m in metrics if m in log.columns]
    return log.select("run", "epoch", F.explode(F.create_map(*[x for m in held for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
