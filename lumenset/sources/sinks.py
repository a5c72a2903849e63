"""Writers of manifests, reports and exported files."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenset.config import redacted
from lumenset.operators.export import split_counts
from lumenset.operators.quality import flag_text
from lumenset.sources.tables import exists


def write_manifest(rows: DataFrame, path: str) -> None:
    """CSV with header; flags in text form."""
    kinds = dict(rows.dtypes)
    if kinds.get("quality_flag", "").startswith("array"):
        rows = rows.withColumn("quality_flag", flag_text(F.col("quality_flag")))
    rows.write.mode("overwrite").option("header", True).csv(path)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at this place, made first if it is not there. A stage that broke off has no _SUCCESS file and is made again."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Writes beside the old table and swaps then, so that a reader finds either."""
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    new, old, keep = jvm.Path(f"{path}.new"), jvm.Path(path), jvm.Path(f"{path}.old")
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(keep, True)
    if fs.exists(old):
        fs.rename(old, keep)
    if not fs.rename(new, old):
        raise OSError(f"cannot replace {path}")
    fs.delete(keep, True)


def copy_files(plan: DataFrame, overwrite: bool = False, link: bool = False, verify: bool = True, backup: bool = False) -> DataFrame:
    """Copies ``source`` to ``target`` (local or mounted paths) and returns (``source``, ``target``, ``sha256``, ``state``).

    States: copied, exists, missing, failed. ``link`` makes hard links and copies where that fails; ``backup`` keeps what it
    overwrites once, with ``.bak``. Write the result once, as each evaluation copies; a copy goes to a temporary name
    first, so an attempt that broke off leaves no half file.
    """

    def one(src: str | None, dst: str) -> tuple[str, str | None]:
        import hashlib

        if not src or not os.path.exists(src):
            return "missing", None
        state = "copied"
        try:
            os.makedirs(os.path.dirname(dst), exist_ok=True)
            if os.path.exists(dst) and not overwrite:
                state = "exists"
            else:
                if backup and os.path.exists(dst) and not os.path.exists(f"{dst}.bak"):
                    shutil.copy2(dst, f"{dst}.bak")
                part = f"{dst}.part{os.getpid()}"
                try:
                    if not link:
                        raise OSError
                    os.link(src, part)
                except OSError:
                    shutil.copy2(src, part)
                os.replace(part, dst)
            digest = None
            if verify:
                with open(dst, "rb") as f:
                    digest = hashlib.file_digest(f, "sha256").hexdigest()
            return state, digest
        except OSError:
            return "failed", None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [one(s, t) for s, t in zip(pdf["source"], pdf["target"])]
            yield pdf.assign(state=[g[0] for g in got], sha256=[g[1] for g in got])[["source", "target", "sha256", "state"]]

    return plan.select("source", "target").mapInPandas(run, "source string, target string, sha256 string, state string")


def write_predictions(predictions: DataFrame, root: str) -> DataFrame:
    """Writes y_true.npy and y_pred.npy into a folder for each run (a local or mounted path) in the order of ``sample_id``; returns (``run``, ``samples``), once evaluated.

    The two arrays of a run are one file each, so a run is a task's work; a file is written beside and swapped.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        run = str(pdf["run"].iloc[0])
        folder = os.path.join(root, run.replace(os.sep, "_"))
        os.makedirs(folder, exist_ok=True)
        pdf = pdf.sort_values("sample_id")
        for name in ("y_true", "y_pred"):
            part = os.path.join(folder, f"{name}.part{os.getpid()}.npy")
            np.save(part, pdf[name].to_numpy(dtype=np.int64))
            os.replace(part, os.path.join(folder, f"{name}.npy"))
        return pd.DataFrame({"run": [run], "samples": [len(pdf)]})

    whole = predictions.where("run is not null and y_true is not null and y_pred is not null").select("run", "sample_id", "y_true", "y_pred")
    return whole.groupBy("run").applyInPandas(one, "run string, samples long")


def write_log(rows: DataFrame, path: str) -> None:
    """A small table (statistics, split or cleaning log) as CSV with header, in one file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def checksum_errors(copied: DataFrame, rows: DataFrame) -> DataFrame:
    """(``target``, ``sha256``, ``expected``) of copies whose digest is not the manifest's; ``rows`` has ``target`` and ``sha256``."""
    want = rows.select("target", F.lower(F.trim("sha256")).alias("expected")).where("expected <> ''")
    return copied.join(want, "target").where(~F.col("sha256").eqNullSafe(F.col("expected"))).select("target", "sha256", "expected")


def require_all(copied: DataFrame) -> None:
    """Raises FileNotFoundError if any file was missing."""
    if n := copied.where("state = 'missing'").count():
        raise FileNotFoundError(f"{n} files are missing")


def manifest_report(rows: DataFrame, config: dict, version: str = "v1") -> dict:
    """Counts by split, class and source with the redacted configuration. One row for each split, class and source reaches the driver."""
    counts: dict[str, dict[str, int]] = {"split": {}, "class": {}, "source": {}}
    for r in split_counts(rows).collect():
        counts[r["kind"]][r["name"] or ""] = r["n"]
    return {
        "timestamp": datetime.now().isoformat(),
        "dataset_version": version,
        "config_snapshot": redacted(config),
        "image_counts_per_split": counts["split"],
        "class_distribution": counts["class"],
        "source_distribution": counts["source"],
    }


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file on whatever file system the path names, written beside and swapped."""
    jvm = spark._jvm.org.apache.hadoop.fs
    new, old = jvm.Path(f"{path}.new"), jvm.Path(path)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(old.getParent())
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(old, False)
    if not fs.rename(new, old):
        raise OSError(f"cannot write {path}")


def write_json(spark: SparkSession, report: dict, path: str) -> None:
    """Sorted keys."""
    write_text(spark, json.dumps(report, indent=2, sort_keys=True, default=str), path)


def write_readme(spark: SparkSession, report: dict, path: str) -> None:
    lines = [f"# Dataset {report['dataset_version']}", "", f"Made {report['timestamp']}."]
    for title, key in (("Splits", "image_counts_per_split"), ("Classes", "class_distribution"), ("Sources", "source_distribution")):
        lines += ["", f"## {title}", "", "| name | images |", "|-|-|", *[f"| {k} | {v} |" for k, v in sorted(report[key].items())]]
    write_text(spark, "\n".join(lines) + "\n", path)


def audit_tables(rows: DataFrame, config) -> dict[str, DataFrame]:
    """All rows of what the report lists only the first of: ``audit_class_by_split``, ``audit_imbalances`` and ``audit_anomalies``."""
    from lumenset.operators import audit

    valid = rows.where(audit.is_complete(audit.REQUIRED))
    return {"audit_class_by_split": audit.split_matrix(valid), "audit_imbalances": audit.imbalance(valid), "audit_anomalies": audit.anomalies(valid, config.known_sources, tuple(config.split_ratios))}


def audit_report(rows: DataFrame, config, missing: int = 0, unreadable: int = 0) -> dict:
    """The audit as one nested dict. Its lists hold the first ``anomaly_cap`` entries in the order of their names, ``listed_of`` tells of how many; ``audit_tables`` has them all."""
    from lumenset.operators import audit

    whole = audit_tables(rows, config)
    facts = audit.verdict(rows, config, missing, unreadable).first().asDict()
    valid = rows.where(audit.is_complete(audit.REQUIRED))
    leaks = [f"{r['kind']} leakage: {r['keys']} in several splits" for r in audit.leakage(valid).where("keys > 0").orderBy("kind").collect()]
    return {
        "summary": facts,
        "verdict": facts["verdict"],
        "distribution": {"class_by_split": [r.asDict() for r in whole["audit_class_by_split"].orderBy("class_label").limit(config.anomaly_cap).collect()]},
        "leakage": {k: {r["pair"]: r["n"] for r in audit.leakage_pairs(valid, k).collect()} for k in ("hash", "filename", "path")},
        "quality": audit.quality_stats(valid, config.min_quality_score or 0.0).first().asDict() | {"histogram": [r["n"] for r in audit.histogram(valid, "quality_score", config.quality_hist_bins).orderBy("bin").collect()]},
        "anomalies": [r.asDict() for r in audit.first_anomalies(whole["audit_anomalies"], config.anomaly_cap).collect()],
        "warnings": [f"{r['kind']} {r['name']}: {r['share']:.4f}" for r in whole["audit_imbalances"].orderBy("kind", "name").limit(config.anomaly_cap).collect()] + leaks,
        "listed_of": {name: table.count() for name, table in whole.items()},
        "thresholds_used": {k: getattr(config, k) for k in ("max_missing_pct", "max_leakage_allowed", "max_malformed_pct", "max_low_quality_pct", "min_quality_score", "quality_hist_bins", "anomaly_cap")},
    }
