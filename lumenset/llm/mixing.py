"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenset.functions.text import folded, token_count
from lumenset.scratch import Scratch

_EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Moves inclusion probabilities to 0 or 1 and keeps their sum and the expected total of sizes, until at most two are left.

    Three undecided units have one direction that changes neither the number nor the
    size drawn (the null space of the two constraints). A step along it, forth or back with
    the chances that keep every probability as expected, decides at least one unit.
    ``land`` ends the rest as well, giving up first the size, then the number.
    """
    p, s = p.astype(float).tolist(), size.astype(float).tolist()
    draws = iter(rng.random(len(p) + 3).tolist())
    live: list[int] = []

    def step(units: list[int], d: list[float]) -> None:
        fore, back = np.inf, np.inf
        for i, x in zip(units, d):
            if x > 0:
                fore, back = min(fore, (1 - p[i]) / x), min(back, p[i] / x)
            elif x < 0:
                fore, back = min(fore, -p[i] / x), min(back, (p[i] - 1) / x)
        by = fore if next(draws) * (fore + back) < back else -back
        for i, x in zip(units, d):
            p[i] += by * x
            p[i] = 0.0 if p[i] < _EPS else 1.0 if p[i] > 1 - _EPS else p[i]
        live[:] = [i for i in live if 0 < p[i] < 1]

    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        live.append(i)
        if len(live) == 3:
            a, b, c = live
            d = [s[b] - s[c], s[c] - s[a], s[a] - s[b]]
            step(live[:], d if any(d) else [1.0, -1.0, 0.0])
    while land and live:
        step(live[:2], [1.0, -1.0][: len(live)])
    return np.array(p)


class Mixture:
    """``chosen`` (``doc_id``, ``source``, ``tokens``, ``copies``) and ``report``, one row for each target source."""

    def __init__(self, chosen: DataFrame, report: DataFrame):
        self.chosen, self.report = chosen, report


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 42, rows_per_block: int = 4096, max_sources: int = 10_000) -> Mixture:
    """A mixture in which each source of ``targets`` holds ``target_permille`` of the tokens of all documents.

    Each document of a source is expected ``goal / tokens of the source`` times: the whole part is
    given, the fraction is drawn by the cube method, balanced on the tokens and the number of documents
    of the source. It flies in blocks of about ``rows_per_block`` documents; the at most two that a block
    leaves undecided go on to the next level, and only the last block of a source lands.
    A source whose goal exceeds its tokens ``max_repeats`` times gives just that and is ``short``.
    Sources are compared in lower case without blanks at the ends; documents of no target source, and
    those without tokens, are not drawn but their tokens count in the total.
    A source without documents draws nothing. Rows with the same id are told apart by their text.
    Targets must be distinct and at most ``max_sources`` (ValueError), as they are read to the driver.
    Report: ``source``, ``target_permille``, ``max_repeats``, ``available`` and ``drawn`` tokens, ``documents`` drawn,
    ``short``, ``share_permille`` of all that was drawn.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    goals = targets.select("source", folded(F.col("source")).alias("name"), F.col("target_permille").cast("long").alias("target_permille"), F.coalesce("max_repeats", F.lit(0)).cast("long").alias("max_repeats")).where("name is not null and target_permille is not null")
    listed = goals.limit(max_sources + 1).collect()
    if len({r["name"] for r in listed}) != len(listed) or len(listed) > max_sources:
        raise ValueError(f"targets must be distinct and at most {max_sources}")
    sized = docs.select("doc_id", F.xxhash64("text").alias("what"), folded(F.col("source")).alias("name"), token_count(F.col("text")).cast("long").alias("tokens")).where("tokens > 0")
    sized = scratch.write(sized, "sized")
    held = {r["name"]: (r["t"], r["n"]) for r in _bounded(sized.groupBy("name").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")), goals)}
    total = sized.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    plan = []
    for r in listed:
        tokens, n = held.get(r["name"], (0, 0))
        short = tokens * r["max_repeats"] * 1000 < r["target_permille"] * total
        rate = float(r["max_repeats"]) if short else r["target_permille"] * total / (1000 * tokens) if tokens else 0.0
        plan.append((r["source"], r["name"], r["target_permille"], r["max_repeats"], tokens, short, int(rate), rate - int(rate), max(1, -(-n // rows_per_block))))
    schema = "source string, name string, target_permille long, max_repeats long, available long, short boolean, whole long, part double, blocks long"
    plan_df = spark.createDataFrame(plan, schema)
    # At most max_sources rows, checked above.
    units = sized.join(F.broadcast(plan_df.select("source", "name", "whole", "part", "blocks")), "name")
    units = units.select("doc_id", "what", "source", "tokens", "whole", F.col("part").alias("p"), "blocks")
    units = scratch.write(units, "level0")
    blocks, level = max([r[-1] for r in plan], default=1), 0
    settled = [units.where("p = 0")]
    rest = units.where("p > 0")
    while True:
        last = blocks <= 1
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "what", F.lit(seed), F.lit(level)), F.col("blocks")))

        def fly(key: tuple[pa.Scalar, ...], t: pa.Table, level: int = level, last: bool = last) -> pa.Table:
            t = t.sort_by([("doc_id", "ascending"), ("what", "ascending")])
            name = int.from_bytes(str(key[0].as_py()).encode(), "little")
            rng = np.random.default_rng([seed, level, key[1].as_py(), name])
            p = flight(t.column("p").to_numpy(), t.column("tokens").to_numpy(), rng, last)
            return t.drop_columns(["block"]).set_column(t.schema.get_field_index("p"), "p", pa.array(p))

        seen = Observation()
        nxt = dealt.groupBy("source", "block").applyInArrow(_typed(fly), units.schema)
        nxt = nxt.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("blocks") * 2 / rows_per_block).cast("long")))
        nxt = scratch.write(nxt.observe(seen, F.max("blocks").alias("blocks")), f"level{level + 1}")
        settled.append(nxt.where("p = 0 or p = 1"))
        if last:
            break
        rest, level, blocks = nxt.where("p > 0 and p < 1"), level + 1, seen.get["blocks"] or 1
    chosen = settled[0]
    for part in settled[1:]:
        chosen = chosen.unionByName(part)
    chosen = chosen.select("doc_id", "source", "tokens", (F.col("whole") + F.col("p").cast("long")).alias("copies"))
    drawn = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn"), F.count_if(F.col("copies") > 0).alias("documents"))
    report = plan_df.join(drawn, "source", "left").select("source", "target_permille", "max_repeats", "available", F.coalesce("drawn", F.lit(0)).cast("long").alias("drawn"), F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), "short")
    report = scratch.write(report, "report")
    everything = report.agg(F.sum("drawn").alias("all")).first()["all"] or 0
    report = report.withColumn("share_permille", F.round(F.col("drawn") * 1000.0 / F.lit(max(everything, 1)), 3))
    return Mixture(chosen.where("copies > 0"), report)


def _typed(f):  # the signature tells Spark to pass the key
    def with_key(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return f(key, table)

    return with_key


def _bounded(counts: DataFrame, goals: DataFrame) -> list:
    """Counts of the target sources only, so their number is that of the targets."""
    return counts.join(goals.select("name"), "name", "left_semi").collect()
