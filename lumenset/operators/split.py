"""Cluster-wise splits and their reports."""

from __future__ import annotations

import json
import math
import random
from array import array
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenset.operators.ranking import grouped_rank
from lumenset.scratch import Scratch

#: Fixed value: clusters that the greedy split's lists hold at most; a place in one fits a short.
CHUNK = 32_768


def usable_rows(rows: DataFrame) -> DataFrame:
    """Rows with path, class and source."""
    return rows.where("trim(path) <> '' and trim(class_label) <> '' and trim(dataset_source) <> ''")


def greedy_assign(clusters: list[tuple[str, int, dict[str, int], dict[str, int]]], ratios: dict[str, float], seed: int = 42, mode: str = "delta") -> dict[str, str]:
    """Split of each cluster (key, size, counts by class, counts by source), one after the other in seeded order.

    ``compat`` takes the split whose own distance from its targets is smallest once the cluster is in it, which favours
    small splits; ``delta`` takes the one whose distance shrinks most, which meets the ratios. Ties go to the smaller name.
    """
    order = sorted(range(len(clusters)), key=lambda i: clusters[i][0])
    names = sorted(ratios)
    placed = _place(order, [c[1:] for c in clusters], [1] * len(clusters), ratios, seed, mode)
    return {clusters[i][0]: names[n] for i, n in zip(order, placed)}


def _place(codes: Sequence[int], kinds: list[tuple[int, dict[str, int], dict[str, int]]], times: list[int], ratios: dict[str, float], seed: int, mode: str) -> array:
    """The rule of ``greedy_assign``: place in ``sorted(ratios)`` of each cluster, in the order of ``codes``.

    ``codes`` has the composition of each cluster, in the order of their keys, as its place in ``kinds`` (size, counts by class,
    counts by source); ``times`` says how many clusters are of each.
    """
    slots: dict[tuple[int, str], int] = {(0, ""): 0}  # the size, then classes, then sources
    for part in (1, 2):
        for kind in kinds:
            for x in kind[part]:
                slots.setdefault((part, x), len(slots))
    adds = [[(0, size), *((slots[1, x], n) for x, n in k.items()), *((slots[2, x], n) for x, n in s.items())] for size, k, s in kinds]
    totals = [0] * len(slots)
    for add, t in zip(adds, times):
        for x, n in add:
            totals[x] += n * t
    state = []
    for name in sorted(ratios):
        want = [ratios[name] * v for v in totals]
        over = [w + 1e-9 if w else math.inf for w in want]  # no target, no distance
        state.append(([0] * len(totals), want, over, [abs(w) / o for w, o in zip(want, over)]))
    # Four bytes for a cluster's turn and two for its split; shuffled as a list would be.
    order = array("Q" if len(codes) >> 32 else "I", range(len(codes)))
    random.Random(seed).shuffle(order)
    out = array("h", bytes(2 * len(codes)))
    for at in order:
        add = adds[codes[at]]
        best, least = 0, math.inf
        for i, (held, want, over, now) in enumerate(state):
            cost = 0.0
            if mode == "delta":
                # Classes and sources that the cluster lacks change nothing.
                for x, n in add:
                    cost += abs(held[x] + n - want[x]) / over[x] - now[x]
            else:
                then = now.copy()
                for x, n in add:
                    then[x] = abs(held[x] + n - want[x]) / over[x]
                for c in then:
                    cost += c
            if cost < least:
                best, least = i, cost
        held, want, over, now = state[best]
        for x, n in add:
            held[x] += n
            now[x] = abs(held[x] - want[x]) / over[x]
        out[at] = best
    return out


def greedy_split(rows: DataFrame, ratios: dict[str, float], key: str = "cluster_key", seed: int = 42, mode: str = "delta", max_clusters: int | None = None) -> DataFrame:
    """Adds ``split`` by ``greedy_assign``; NULL labels and sources count as ''. A NULL key raises ValueError.

    The rule is sequential, so it runs on one machine, but over numbers only: clusters are ranked by key in Spark, and the driver
    gets the different compositions and two bytes for each cluster, keeps about ten and returns two. Keys never leave the executors.
    More than ``max_clusters``, if given, raise ValueError.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(key, F.coalesce("class_label", F.lit("")).alias("c"), F.coalesce("dataset_source", F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    vectors = counts.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct("c", "s", "n")))).alias("v"))
    vectors = Scratch(spark, "greedy-split").write(vectors, "vectors")
    total, bare = vectors.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
    if max_clusters is not None and total > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters")
    if bare:
        raise ValueError(f"rows without {key}")
    nth = F.col("nth") - 1
    ranked = grouped_rank(vectors, [], [F.col(key)], "nth").select(key, "v", F.floor(nth / CHUNK).cast("int").alias("chunk"), (nth % CHUNK).cast("short").alias("at"))
    # A cluster is a place in its chunk, listed under its composition.
    listed = ranked.groupBy("chunk", "v").agg(F.collect_list("at").alias("at")).toArrow()
    texts = sorted(pc.unique(listed.column("v")).to_pylist())
    codes = np.empty(total, np.uint16 if len(texts) <= 1 << 16 else np.uint32)
    times = [0] * len(texts)
    for batch in listed.to_batches():
        places, ends = batch.column("at").flatten().to_numpy(), np.cumsum(pc.list_value_length(batch.column("at")).to_numpy())
        kinds = pc.index_in(batch.column("v"), pa.array(texts, batch.column("v").type)).to_pylist()
        for chunk, kind, start, end in zip(batch.column("chunk").to_pylist(), kinds, [0, *ends[:-1].tolist()], ends.tolist()):
            codes[chunk * CHUNK : (chunk + 1) * CHUNK][places[start:end]] = kind
            times[kind] += end - start
    del listed
    parsed = []
    for text in texts:
        k, s = Counter(), Counter()
        for x in json.loads(text):
            k[x["c"]] += x["n"]
            s[x["s"]] += x["n"]
        parsed.append((sum(k.values()), k, s))
    placed = np.frombuffer(_place(memoryview(codes), parsed, times, ratios, seed, mode), np.int16)
    starts = np.arange(0, total, CHUNK)
    splits = pa.ListArray.from_arrays(pa.array([*starts.tolist(), total], pa.int32()), pa.array(placed, pa.int16()))
    placed = spark.createDataFrame(pa.table({"chunk": pa.array(starts // CHUNK, pa.int32()), "splits": splits}))
    names = F.array(*[F.lit(n) for n in sorted(ratios)])
    return rows.drop("split").join(ranked.join(placed, "chunk").select(key, F.get(names, F.get("splits", "at")).alias("split")), key)


def split_report(rows: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(``split``, ``clusters``, ``images``, ``classes``, ``sources``); the last two are maps of counts."""
    base = rows.groupBy("split").agg(F.count_distinct(key).alias("clusters"), F.count(F.lit(1)).alias("images"))
    each = rows.groupingSets([["split", "class_label"], ["split", "dataset_source"]], "split", "class_label", "dataset_source").agg(F.grouping("class_label").alias("g"), F.count(F.lit(1)).alias("n"))
    pair = lambda g, c: F.map_from_entries(F.collect_list(F.when(F.col("g") == g, F.struct(F.coalesce(c, F.lit("")), "n"))))
    maps = each.groupBy("split").agg(pair(0, "class_label").alias("classes"), pair(1, "dataset_source").alias("sources"))
    return base.join(maps, base["split"].eqNullSafe(maps["split"])).select(base["split"], "clusters", "images", "classes", "sources")


def leaking_clusters(rows: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(``key``, ``splits``) of clusters in more than one split. Must be empty after a split."""
    return rows.where(F.col(key).isNotNull() & F.col("split").isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")
