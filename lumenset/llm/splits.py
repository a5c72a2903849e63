"""Splits that keep related records together: grouped iterative stratification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenset.functions.text import blank_to_null, folded, valid_phash
from lumenset.llm.components import connected_components
from lumenset.operators.ranking import grouped_rank
from lumenset.scratch import Scratch


def related_groups(rows: DataFrame) -> DataFrame:
    """(``group_path``, ``path``) for every distinct path: images that share a ``cluster_id`` or a valid ``phash``, directly or over others.

    Every image is linked to a node for each of its keys, so a key that a third of all rows
    share costs one edge a row and never a pair. An image without relatives, also one
    without any key, is a group of its own. Rows with a NULL path are left out.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "related")
    keys = F.array(F.concat(F.lit("c"), blank_to_null(F.col("cluster_id"))), F.concat(F.lit("h"), valid_phash(F.col("phash")).cast("string")))
    keyed = rows.where("path is not null").select("path", F.explode(keys).alias("key")).where("key is not null").distinct()
    for seed in range(16):
        node = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c), F.lit(seed))
        seen = Observation()
        # Both kinds of nodes are checked for ids that collide.
        texts = rows.where("path is not null").select(F.lit("p").alias("kind"), F.col("path").alias("text")).union(keyed.select(F.lit("k"), "key")).distinct()
        ids = texts.groupBy(F.xxhash64("kind", "text", F.lit(seed)).alias("node")).agg(F.min(F.when(F.col("kind") == "p", F.col("text"))).alias("path"), F.count(F.lit(1)).alias("n"))
        ids = scratch.write(ids.observe(seen, F.max("n").alias("n")), f"nodes{seed}").drop("n")
        if (seen.get["n"] or 1) == 1:
            break
    else:
        raise RuntimeError("no seed gives distinct ids")
    labels = connected_components(keyed.select(node("p", "path").alias("u"), node("k", "key").alias("v")))
    members = ids.where("path is not null").join(labels, "node", "left").select(F.coalesce("component", "node").alias("component"), "path")
    members = scratch.write(members, "members")
    heads = members.groupBy("component").agg(F.min("path").alias("group_path"))
    return members.join(heads, "component").select("group_path", "path")


def split_conflicts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(``group_path``, ``path``) for every image of a group whose rows hold two or more different non-blank splits."""
    splits = rows.where("path is not null").select("path", folded(F.col("split")).alias("split")).where("split is not null").distinct()
    mixed = groups.join(splits, "path").groupBy("group_path").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi")
    return groups.join(mixed.select("group_path"), "group_path", "left_semi").select("group_path", "path")


def _level_out(need: np.ndarray, v: float, n: int) -> np.ndarray:
    """How many of n equal items each split gets when each goes to the split with the greatest need and lowers it by v."""
    given = np.zeros(len(need), dtype=np.int64)
    if n > 4 * len(need):
        order = np.sort(need)[::-1]
        for k in range(len(order), 0, -1):
            level = (order[:k].sum() - v * n) / k
            if level <= order[k - 1]:
                break
        given = np.maximum(0, np.floor((need - level) / v)).astype(np.int64)
        over = int(given.sum()) - n
        for s in np.argsort(need - v * given)[: max(over, 0)]:
            given[s] -= 1
    for _ in range(n - int(given.sum())):
        given[int(np.argmax(need - v * given))] += 1
    return given


class Ledger:
    """What each split has been given so far of each label and in all, against its share of the total."""

    def __init__(self, totals: dict[str, int], ratios: list[float]):
        self.totals, self.ratios = totals, np.asarray(ratios, float)
        self.every = sum(totals.values())
        self.given = {k: np.zeros(len(ratios), np.int64) for k in totals}
        self.all = np.zeros(len(ratios), np.int64)

    def place(self, vector: dict[str, int], n: int, label: str) -> np.ndarray:
        """How many of ``n`` groups with this label vector go to each split: each to the one that needs ``label`` most."""
        need = self.ratios * self.totals[label] - self.given[label]
        # The need of all records breaks ties between splits that need the label alike.
        got = _level_out(need + 1e-9 * (self.ratios * self.every - self.all), vector[label], n)
        self.add(vector, got)
        return got

    def add(self, vector: dict[str, int], got: np.ndarray) -> None:
        for k, c in vector.items():
            self.given[k] += got * c
        self.all += got * sum(vector.values())


def _vector(kind: tuple[str, ...]) -> dict[str, int]:
    return {k: int(c) for k, _, c in (x.rpartition("=") for x in kind)}


def _in_turn(kind: tuple[str, ...], label: str) -> tuple:
    """Order of the kinds that hold a label: those with most of it first, then the larger ones."""
    v = _vector(kind)
    return -v[label], -sum(v.values()), kind


def allot(kinds: list[tuple[tuple[str, ...], int]], splits: list[str], ledger: Ledger, label: str) -> list[tuple]:
    """(kind, split, first, last) for kinds that all hold ``label``, placed one after the other in ``_in_turn`` order."""
    out = []
    for kind, n in sorted(kinds, key=lambda x: _in_turn(x[0], label)):
        at = 0
        for s, g in zip(splits, ledger.place(_vector(kind), n, label)):
            if g:
                out.append((list(kind), s, at + 1, at + int(g)))
                at += int(g)
    return out


def rarest(left: dict[str, int]) -> str | None:
    """The label with the fewest outstanding records, the smaller name if equal."""
    some = [(c, k) for k, c in left.items() if c > 0]
    return min(some)[1] if some else None


def stratify(kinds: pd.DataFrame, splits: list[str], ratios: list[float]) -> pd.DataFrame:
    """Allots kinds of groups to splits. ``kinds``: ``kind`` (label=count items), ``n`` groups of it.

    The label with the fewest outstanding records comes first; of the kinds that hold it,
    those with most of it come first; each group goes to the split that needs the label most.
    """
    todo = {tuple(k): int(n) for k, n in zip(kinds["kind"], kinds["n"])}
    left: dict[str, int] = {}
    for kind, n in todo.items():
        for k, c in _vector(kind).items():
            left[k] = left.get(k, 0) + c * n
    ledger, out = Ledger(dict(left), ratios), []
    while (label := rarest(left)) is not None:
        here = [(k, n) for k, n in todo.items() if label in _vector(k)]
        out += allot(here, splits, ledger, label)
        for kind, n in here:
            del todo[kind]
            for k, c in _vector(kind).items():
                left[k] -= c * n
    return pd.DataFrame(out, columns=["kind", "new_split", "first", "last"])


def _stratify_in_turns(kinds: DataFrame, splits: list[str], ratios: list[float], per_task: int, scratch: Scratch) -> DataFrame:
    """``stratify`` for more kinds than one task should hold, with the same result: tasks follow one another and hand on what each split has been given.

    A round for each label; within it, tasks of ``per_task`` kinds in order. What reaches the driver has a row for each label, or for each label and split.
    """
    parsed = kinds.withColumn("vector", F.map_from_entries(F.transform("kind", lambda x: F.struct(F.regexp_extract(x, "(?s)^(.*)=", 1).alias("k"), F.regexp_extract(x, "([0-9]+)$", 1).cast("long").alias("c")))))
    todo = scratch.write(parsed.withColumn("turn", F.lit(None).cast("string")), "todo")
    outstanding = lambda t: {r["k"]: r["n"] for r in t.select(F.explode("vector").alias("k", "c"), "n").groupBy("k").agg(F.sum(F.col("c") * F.col("n")).alias("n")).collect()}
    left = outstanding(todo)
    ledger, made, step = Ledger(dict(left), ratios), None, 0
    schema = "kind array<string>, new_split string, first long, last long"
    while (label := rarest(left)) is not None:
        here = todo.where(F.map_contains_key("vector", F.lit(label))).select("kind", "n", (-F.element_at("vector", F.lit(label))).alias("k1"), (-F.aggregate(F.map_values("vector"), F.lit(0).cast("long"), lambda a, x: a + x)).alias("k2"))
        ranked = scratch.write(grouped_rank(here, [], [F.col("k1"), F.col("k2"), F.col("kind")], "nth"), f"ranked{step}")
        for at in range(0, ranked.count(), per_task):
            part = ranked.where(F.col("nth").between(at + 1, at + per_task)).coalesce(1)

            def run(frames, state=(dict(ledger.given), ledger.all.copy())):
                now = Ledger(ledger_totals, ratios)
                now.given, now.all = {k: v.copy() for k, v in state[0].items()}, state[1].copy()
                got = [(tuple(k), int(n)) for f in frames for k, n in zip(f["kind"], f["n"])]
                yield pd.DataFrame(allot(got, splits, now, label), columns=["kind", "new_split", "first", "last"])

            ledger_totals = ledger.totals
            done = scratch.write(part.select("kind", "n").mapInPandas(run, schema), f"done{step}_{at}")
            each = done.select("new_split", F.explode("kind").alias("x"), (F.col("last") - F.col("first") + 1).alias("n"))
            sums = each.groupBy("new_split", F.regexp_extract("x", "(?s)^(.*)=", 1).alias("k")).agg(F.sum(F.col("n") * F.regexp_extract("x", "([0-9]+)$", 1).cast("long")).alias("n"))
            for r in sums.collect():
                ledger.given[r["k"]][splits.index(r["new_split"])] += r["n"]
                ledger.all[splits.index(r["new_split"])] += r["n"]
            made = done if made is None else made.unionByName(done)
        todo = scratch.write(todo.where(~F.map_contains_key("vector", F.lit(label))), f"todo{step}")
        left, step = outstanding(todo), step + 1
    return made if made is not None else scratch.spark.createDataFrame([], schema)


def stratified_splits(rows: DataFrame, targets: DataFrame, kinds_per_task: int = 50_000) -> DataFrame:
    """(``path``, ``group_path``, ``split``): one split for every distinct path, the same within a group.

    Groups with equal label vectors are interchangeable, so the allotment works on kinds of
    groups (a label vector and how many groups have it), not on groups. More than
    ``kinds_per_task`` kinds are placed by tasks that follow one another and hand on the remaining need, so the result is the same at any value of it.
    Which groups of a kind go where follows the hash of ``group_path``.
    An image without a usable label counts as ``unknown``; with several, the smallest counts.
    Ratios are scaled to a sum of one; no rows give no rows. ``targets`` must be small (it is
    read to the driver; more than 1,000 rows raise ValueError), as must be the split names, NULL or blank ones and ratios that are not positive are left out.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "stratified")
    wanted = targets.select(folded(F.col("split")).alias("split"), F.col("ratio").cast("double").alias("ratio")).where("split is not null and ratio > 0").groupBy("split").agg(F.sum("ratio").alias("ratio")).limit(1001).collect()
    if not 0 < len(wanted) <= 1000:
        raise ValueError("targets must hold 1 to 1,000 splits")
    wanted = sorted((r["split"], r["ratio"]) for r in wanted)
    names, ratios = [s for s, _ in wanted], [r / sum(x for _, x in wanted) for _, r in wanted]
    groups = scratch.write(related_groups(rows), "groups")
    label = rows.where("path is not null").groupBy("path").agg(F.coalesce(F.min(folded(F.col("class_label"))), F.lit("unknown")).alias("label"))
    counts = groups.join(label, "path").groupBy("group_path", "label").agg(F.count(F.lit(1)).alias("c"))
    vectors = counts.groupBy("group_path").agg(F.array_sort(F.collect_list(F.concat_ws("=", "label", F.col("c").cast("string")))).alias("kind"))
    vectors = scratch.write(vectors, "vectors")
    seen = Observation()
    kinds = scratch.write(vectors.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).observe(seen, F.count(F.lit(1)).alias("kinds")), "kinds")
    if (seen.get["kinds"] or 0) > kinds_per_task:
        dealt = _stratify_in_turns(kinds, names, ratios, kinds_per_task, scratch)
    else:
        dealt = kinds.groupBy().applyInPandas(lambda p: stratify(p, names, ratios), "kind array<string>, new_split string, first long, last long")
        dealt = scratch.write(dealt, "dealt")
    ranked = grouped_rank(vectors, ["kind"], [F.xxhash64("group_path"), F.col("group_path")], "rank")
    placed = ranked.join(dealt, "kind").where("rank between first and last").select("group_path", F.col("new_split").alias("split"))
    return groups.join(placed, "group_path").select("path", "group_path", "split")


def split_shares(placed: DataFrame, rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(``split``, ``label``, ``images``, ``wanted``, ``off``): images of each label in each target split, its share of them, and how far the two lie apart.

    ``placed`` as ``stratified_splits`` gives it. ``label`` NULL stands for all images.
    """
    label = rows.where("path is not null").groupBy("path").agg(F.coalesce(F.min(folded(F.col("class_label"))), F.lit("unknown")).alias("label"))
    goal = targets.select(folded(F.col("split")).alias("split"), F.col("ratio").cast("double").alias("ratio")).where("split is not null and ratio > 0").groupBy("split").agg(F.sum("ratio").alias("ratio"))
    goal = goal.crossJoin(goal.agg(F.sum("ratio").alias("whole")))  # a row for each split
    each = placed.join(label, "path").cube("split", "label").agg(F.count(F.lit(1)).alias("images"), F.grouping("split").alias("g"), F.grouping("label").alias("h"))
    every = each.where("g = 1").select(F.when(F.col("h") == 0, F.col("label")).alias("label"), F.col("images").alias("total"))
    held = each.where("g = 0").select("split", F.when(F.col("h") == 0, F.col("label")).alias("of"), "images")
    plan = every.crossJoin(goal).join(held.withColumnRenamed("split", "s"), (F.col("split") == F.col("s")) & F.col("label").eqNullSafe(F.col("of")), "left")  # labels x splits
    wanted = F.col("total") * F.col("ratio") / F.col("whole")
    out = plan.select("split", "label", F.coalesce("images", F.lit(0)).cast("long").alias("images"), F.round(wanted, 6).alias("wanted"))
    return out.withColumn("off", F.round(F.col("images") - F.col("wanted"), 6))
