"""Capping records per dominant contributor."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.functions.text import finite_score, folded_source
from lumenset.operators.ranking import grouped_rank
from lumenset.scratch import Scratch


def water_level(counts: np.ndarray, weights: np.ndarray, share: float) -> int:
    """The greatest cap c with c <= share * sum(min(count, c)), over ``weights`` contributors of each count.

    Lowering the cap lowers the total as well, so a share of the *output* has to be solved
    for; the total is concave in c, and the solution lies between two neighbouring counts.
    With fewer than 1/share contributors no positive cap can meet the share: the cap is
    then the smallest count, where all shares are equal.
    """
    if not len(counts):
        return 0
    order = np.argsort(counts)
    c, w = counts[order].astype(float), weights[order].astype(float)
    above = w.sum() - np.cumsum(w)
    below = np.cumsum(c * w)
    if share * w.sum() < 1 - 1e-12:
        return int(c[0])
    fits = c <= share * (below + c * above) + 1e-9
    if fits.all():
        return int(c[-1])
    k = int(np.argmin(fits))
    under, over = (below[k - 1] if k else 0.0), (above[k - 1] if k else w.sum())
    slope = share * over
    if slope >= 1:
        return int(c[k])
    return max(int(share * under / (1 - slope) + 1e-9), int(c[k - 1]) if k else 0)


def ranked_records(rows: DataFrame, source: Column, score: Column, key: str = "path") -> DataFrame:
    """(``source``, ``key``, ``score``) with one row for each record and contributor it is filed under.

    ``score`` is the highest of all rows of the record, NaN and NULL counting as none.
    Rows with a NULL key are left out, as are NULL contributors.
    """
    each = rows.select(F.col(key).alias("key"), source.alias("source"), finite_score(score).alias("score")).where("key is not null")
    best = each.groupBy("key", "source").agg(F.max("score").alias("score"))
    top = best.groupBy("key").agg(F.max("score").alias("score"), F.collect_set("source").alias("sources"))
    return top.select(F.explode("sources").alias("source"), "key", "score")


def cap_contributors(records: DataFrame, max_count: int | None = None, max_share: float | None = None, slots: int = 64) -> DataFrame:
    """Adds ``rank`` (1 is the best of its contributor) and ``kept`` to (``source``, ``key``, ``score``).

    At most ``max_count`` records of each contributor are kept, or so many that none holds
    more than ``max_share`` of what is kept (``water_level``); both limits may be set.
    Records are ranked by score from high to low, those without a score last, ties by key.
    The water level needs only how many contributors have each count. N records hold at most
    sqrt(2 N) different counts (fewer than 15 million for 10^14), and these alone are read to the driver.
    Contributors within the cap keep everything and get ``rank`` NULL; only the others are ranked.
    """
    if max_count is None and max_share is None:
        raise ValueError("set max_count or max_share")
    spark = records.sparkSession
    scratch = Scratch(spark, "capping")
    records = scratch.write(records.select("source", "key", "score"), "records")
    counts = records.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    cap = max_count
    if max_share is not None:
        hist = counts.groupBy("n").agg(F.count(F.lit(1)).alias("w")).toPandas()
        level = water_level(hist["n"].to_numpy(), hist["w"].to_numpy(), max_share)
        cap = level if cap is None else min(cap, level)
    large = counts.where(F.col("n") > cap).select("source")
    over = records.join(large, "source", "left_semi")
    within = records.join(large, "source", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    ranked = grouped_rank(over, ["source"], [F.col("score").desc_nulls_last(), F.col("key").asc()], "rank")
    return within.unionByName(ranked).withColumn("kept", F.col("rank").isNull() | (F.col("rank") <= cap))


def capped_images(rows: DataFrame, max_permille: int = 50, of_output: bool = False) -> DataFrame:
    """Images ranked within each ``dataset_source`` and capped at a share of all images, or of the output.

    (``source``, ``key``, ``score``, ``rank``, ``kept``); ``key`` is the path.
    """
    images = rows.where("path is not null").agg(F.countDistinct("path").alias("n")).first()["n"]
    records = ranked_records(rows, folded_source(F.col("dataset_source")), F.col("quality_score"))
    if of_output:
        return cap_contributors(records, max_share=max_permille / 1000)
    return cap_contributors(records, max_count=images * max_permille // 1000)
