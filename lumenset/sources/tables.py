"""Manifests, run logs and arrays as tables."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenset.schema import EPOCH_DDL, MANIFEST_DDL, SUMMARY_DDL


def _ddl(spark: SparkSession, ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_manifest(spark: SparkSession, path: str, corrupt: str | None = None) -> DataFrame:
    """A CSV manifest in the types of its columns, found by header; a column given twice counts once, values that do not parse are NULL, and a missing file is an empty table.

    With ``corrupt`` the rows that do not parse keep their text in that column.
    """
    full = _ddl(spark, MANIFEST_DDL)
    if not exists(spark, path):
        return spark.createDataFrame([], full)
    text = spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(path)
    kinds = {f.name: f.dataType for f in full}
    first: dict[str, str] = {}
    for name, f in zip(spark.read.text(path).first()[0].split(","), text.schema):
        first.setdefault(name.strip().strip('"'), f.name)
    cols = [(F.col(f"`{c}`").try_cast(kinds[n]) if n in kinds else F.col(f"`{c}`")).alias(n) for n, c in first.items()]
    if corrupt:
        bad = F.lit(False)
        for n, c in first.items():
            if n in kinds and not isinstance(kinds[n], T.StringType):
                bad = bad | (F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kinds[n]).isNull())
        cols.append(F.when(bad, F.to_json(F.struct(*[F.col(f"`{c}`") for c in first.values()]))).alias(corrupt))
    return text.select(*cols)


def read_epochs(spark: SparkSession, pattern: str) -> DataFrame:
    """Epoch logs of all runs that match (such as results/*/metrics.csv), with ``run``, the folder's name."""
    df = spark.read.schema(_ddl(spark, EPOCH_DDL)).option("header", True).csv(pattern)
    return df.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """(``run``) of folders right below the root that hold a log, in name order."""
    return read_epochs(spark, f"{root}/*/metrics.csv").select("run").distinct().orderBy("run")


def read_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """Run summaries of any generation in one schema; absent fields are NULL."""
    df = spark.read.schema(_ddl(spark, SUMMARY_DDL)).option("multiLine", True).json(pattern)
    return df.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """(``run``, ``sample_id``, ``y_true``, ``y_pred``) from the y_true.npy and y_pred.npy of each run's folder; arrays of different lengths count as far as both go."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "y_*.npy").option("recursiveFileLookup", True).load(root)
    parts = files.select(F.element_at(F.split("path", "/"), -2).alias("run"), F.regexp_extract("path", r"(y_true|y_pred)\.npy$", 1).alias("kind"), "content").where("kind <> ''")
    both = parts.groupBy("run").agg(F.max(F.when(F.col("kind") == "y_true", F.col("content"))).alias("t"), F.max(F.when(F.col("kind") == "y_pred", F.col("content"))).alias("p")).where("t is not null and p is not null")

    def unpack(frames):
        for pdf in frames:
            for run, t, p in zip(pdf["run"], pdf["t"], pdf["p"]):
                a, b = (np.load(io.BytesIO(x), allow_pickle=False).ravel() for x in (t, p))
                n = min(len(a), len(b))
                yield pd.DataFrame({"run": run, "sample_id": np.arange(n), "y_true": a[:n].astype(np.int32), "y_pred": b[:n].astype(np.int32)})

    return both.mapInPandas(unpack, "run string, sample_id long, y_true int, y_pred int")
