"""Manifests and epoch logs that grow while they are read. The reference has no streams; these are the same operators over a growing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lumenset.config import ImageRules
from lumenset.operators.quality import validated
from lumenset.schema import EPOCH_DDL


def validated_stream(spark: SparkSession, folder: str, like: DataFrame, rules: ImageRules = ImageRules()) -> DataFrame:
    """Flags and scores of manifest rows as files arrive; the stage has no state."""
    return validated(spark.readStream.schema(like.schema).parquet(folder), rules)


def epoch_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of epoch logs as they arrive, with ``run``, the folder's name."""
    schema = T.StructType.fromDDL(EPOCH_DDL)
    rows = spark.readStream.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metrics*.csv").csv(folder)
    return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def append_log(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a Parquet log and ends when what is there has been read."""
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
