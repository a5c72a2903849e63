"""Intermediate tables in the shared checkpoint folder.

Iterative operators cut their lineage by writing a Parquet table under
``spark.checkpoint.dir`` and reading it back, so that a lost executor costs a
re-read and never a re-computation of all rounds. A returned table may still be
read from there, so the last ones stay until ``clear`` or the end of the folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lumenset-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/lumenset-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all tables that operators of this application left. Call it once their results are written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def made() -> int:
    """How many folders of tables were begun so far; a mark for ``clear_since``."""
    return len(_MADE)


def clear_since(spark: SparkSession, mark: int) -> None:
    """Deletes the tables of operators that ran after the mark, once nothing reads them any more."""
    for root in _MADE[mark:]:
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del _MADE[mark:]


class Scratch:
    """Named tables of one operator run. ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        _MADE.append(self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            p.getFileSystem(conf).delete(p, True)
