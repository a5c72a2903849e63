"""Sample matching target category proportions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenset.functions.text import folded, folded_source
from lumenset.operators.ranking import grouped_rank
from lumenset.scratch import Scratch


class StratifiedSample:
    """``sample`` (``stratum_id``, ``path``) and ``report``, one row for each target stratum."""

    def __init__(self, sample: DataFrame, report: DataFrame):
        self.sample, self.report = sample, report


def wanted_counts(strata: DataFrame, size: int) -> DataFrame:
    """Adds ``wanted``: whole numbers that sum to the size (times the sum of ``target_permille`` / 1000, rounded down), in proportion to ``target_permille`` and nowhere below ``min_rows``.

    Strata whose minimum lies above their share get the minimum; the others share the rest in proportion, rounded by the largest
    remainder, then the smaller ``stratum_id``. If the minima alone exceed the size, they are what is wanted. NULL counts as 0. All in whole
    numbers; ``strata`` is a table of targets and is sorted in one task.
    """
    m, t = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("min_rows", "target_permille"))
    every = Window.partitionBy()
    of = strata.withColumn("__m", m).withColumn("__t", t)
    of = of.withColumn("__size", F.expr(f"({size}L * sum(__t) over ()) div 1000"))
    # Highest minimum for its share first; a stratum is at its minimum if that exceeds its share of what those before it leave.
    order = [F.when((F.col("__t") == 0) & (F.col("__m") > 0), 0).when(F.col("__t") > 0, 1).otherwise(2), (F.col("__m") / F.nullif(F.col("__t"), F.lit(0))).desc_nulls_last(), F.col("stratum_id")]
    down = every.orderBy(*order)
    before = F.coalesce(F.sum("__m").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("__t").over(down.rowsBetween(0, Window.unboundedFollowing))
    of = of.withColumn("__fixed", F.col("__m") * onward > F.col("__t") * (F.col("__size") - before))
    of = of.withColumn("__rest", F.col("__size") - F.sum(F.when(F.col("__fixed"), F.col("__m")).otherwise(0)).over(every)).withColumn("__among", F.sum(F.when(F.col("__fixed"), 0).otherwise(F.col("__t"))).over(every))
    of = of.withColumn("__whole", F.expr("if(__fixed or __among = 0, __m, (__t * __rest) div __among)")).withColumn("__part", F.expr("if(__fixed or __among = 0, -1, (__t * __rest) % __among)"))
    of = of.withColumn("__over", F.col("__rest") - F.sum(F.when(F.col("__fixed"), 0).otherwise(F.col("__whole"))).over(every))
    nth = F.row_number().over(every.orderBy(F.desc("__part"), "stratum_id"))
    return of.withColumn("wanted", F.col("__whole") + F.when((F.col("__part") > 0) & (nth <= F.col("__over")), 1).otherwise(0)).select(*strata.columns, "wanted")


def draw_sample(rows: DataFrame, targets: DataFrame, size: int | None = None, fraction: tuple[int, int] = (1, 3), oversampling: float = 0.05, seed: int = 42) -> StratifiedSample:
    """Draws from each stratum of ``targets`` its share ``target_permille`` of the sample size, but ``min_rows`` at least; ``wanted_counts`` makes the counts sum to the size.

    The size is ``size``, or ``fraction`` of the distinct paths rounded down. Each image is accepted
    independently with the ratio of wanted to present images, raised by ``oversampling`` and
    four standard deviations; of the accepted ones exactly the wanted number with the
    smallest random values stays. Should a stratum have accepted too few by chance, its
    other images are ranked as well, so the counts are exact. The random value is a hash of seed,
    stratum and path: the same rows give the same sample on any cluster.
    An image filed under several labels or sources counts in each of their strata. NULL or
    blank labels and sources match no stratum. Two targets of one label and source are drawn alike.
    Report: ``stratum_id``, ``available``, ``wanted``, ``drawn``, ``deficit``, ``min_rows``, ``target_permille`` and ``short``: fewer
    images than the minimum or than the exact share of the size.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "stratified-sample")
    images = rows.where("path is not null").select("path", folded(F.col("class_label")).alias("label"), folded_source(F.col("dataset_source")).alias("source")).distinct()
    images = scratch.write(images, "images")
    if size is None:
        size = images.agg(F.countDistinct("path").alias("n")).first()["n"] * fraction[0] // fraction[1]
    strata = targets.select("stratum_id", folded(F.col("class_label")).alias("label"), folded_source(F.col("dataset_source")).alias("source"), "target_permille", "min_rows")
    present = images.groupBy("label", "source").agg(F.count(F.lit(1)).alias("available"))
    plan = wanted_counts(strata, size).join(present, ["label", "source"], "left").select("stratum_id", "label", "source", "target_permille", "min_rows", F.coalesce("available", F.lit(0)).cast("long").alias("available"), "wanted")
    plan = scratch.write(plan, "plan")
    ratio = F.col("wanted") / F.col("available")
    slack = ratio * (1 + oversampling) + 4 * F.sqrt(ratio / F.col("available"))
    chance = F.when(F.col("available") > F.col("wanted"), F.least(F.lit(1.0), slack)).otherwise(F.lit(1.0))
    value = F.xxhash64(F.lit(seed), "stratum_id", "path").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    # Images of no stratum leave here; the plan has a row a target and joins at whatever its size calls for.
    tried = images.join(plan.where("available > 0"), ["label", "source"]).select("stratum_id", "path", "wanted", "available", value.alias("value"), chance.alias("chance"))
    tried = scratch.write(tried, "tried")
    accepted = tried.where("value < chance")
    counts = tried.groupBy("stratum_id", "wanted", "available").agg(F.count_if(F.col("value") < F.col("chance")).alias("n"))
    missed = counts.where(F.col("n") < F.least("wanted", "available")).select("stratum_id")
    candidates = accepted.unionByName(tried.where("value >= chance").join(missed, "stratum_id", "left_semi"))
    ranked = grouped_rank(candidates.select("stratum_id", "path", "wanted", "value"), ["stratum_id"], [F.col("value"), F.col("path")], "rank")
    sample = scratch.write(ranked.where("rank <= wanted").select("stratum_id", "path"), "sample")
    drawn = sample.groupBy("stratum_id").agg(F.count(F.lit(1)).alias("drawn"))
    report = plan.join(drawn, "stratum_id", "left").select("stratum_id", "available", "wanted", F.coalesce("drawn", F.lit(0)).cast("long").alias("drawn"), "min_rows", "target_permille")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    short = (F.col("available") < zero("min_rows")) | (F.col("available") * 1000 < zero("target_permille") * F.lit(size))
    report = report.withColumn("deficit", F.col("wanted") - F.col("drawn")).withColumn("short", short)
    return StratifiedSample(sample, report)
