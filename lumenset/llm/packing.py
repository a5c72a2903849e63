"""Filling fixed-capacity containers with texts, by swap-based local search."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenset.functions.text import token_count
from lumenset.scratch import Scratch


class _Shelf:
    """Open bins by free space: ``by_gap[g]`` holds the bins with g units free."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []
        self.gap: list[int] = []
        self.by_gap: dict[int, set[int]] = {}
        self.gaps: list[int] = []

    def place(self, b: int) -> None:
        g = self.gap[b]
        if g not in self.by_gap:
            self.by_gap[g] = set()
            insort(self.gaps, g)
        self.by_gap[g].add(b)

    def take(self, b: int) -> None:
        g = self.gap[b]
        self.by_gap[g].discard(b)
        if not self.by_gap[g]:
            del self.by_gap[g]
            self.gaps.pop(bisect_left(self.gaps, g))

    def fitting(self, size: int, but: int = -1) -> int:
        """The bin with the smallest gap of at least ``size``, or -1."""
        for g in self.gaps[bisect_left(self.gaps, size) :]:
            for b in self.by_gap[g]:
                if b != but:
                    return b
        return -1

    def change(self, b: int, out: list[tuple[int, int]], into: list[tuple[int, int]]) -> None:
        self.take(b)
        for x in out:
            self.items[b].remove(x)
        self.items[b] += into
        self.gap[b] += sum(s for s, _ in out) - sum(s for s, _ in into)
        self.place(b)


def pack(sizes: np.ndarray, capacity: int, tries: int | None = None) -> np.ndarray:
    """The bin of each item. Sizes must be 1 to ``capacity``.

    Starts with best fit in decreasing order. Then the emptiest bin is dissolved item by item:
    an item moves to the fullest bin with room, or goes in exchange for a smaller one,
    or two of its items go for one of the other bin. Each exchange raises the sum of squared fills,
    so the search ends; a bin whose last item moves away is gone. Each item is held against all
    underfull bins, fullest first, or with ``tries`` against so many of them.
    """
    shelf = _Shelf(capacity)
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        b = shelf.fitting(s)
        if b < 0:
            b = len(shelf.items)
            shelf.items.append([])
            shelf.gap.append(capacity)
            shelf.place(b)
        shelf.change(b, [], [(s, int(i))])
    for victim in sorted(range(len(shelf.items)), key=lambda b: -shelf.gap[b]):
        if shelf.gap[victim] == 0:
            break
        improved = True
        while improved and shelf.items[victim]:
            improved = False
            for x in sorted(shelf.items[victim], reverse=True):
                b = shelf.fitting(x[0], victim)
                if b >= 0 and capacity - shelf.gap[b] >= capacity - shelf.gap[victim] - x[0]:
                    shelf.change(b, [], [x])
                    shelf.change(victim, [x], [])
                    improved = True
                    continue
                if _exchange(shelf, victim, x, tries):
                    improved = True
                    break
        if not shelf.items[victim]:
            shelf.take(victim)
            shelf.gap[victim] = -1
    out = np.full(len(sizes), -1, dtype=np.int64)
    n = 0
    for items in shelf.items:
        if items:
            for _, i in items:
                out[i] = n
            n += 1
    return out


def _exchange(shelf: _Shelf, victim: int, x: tuple[int, int], tries: int | None) -> bool:
    """One-for-one, then two-for-one, out of ``victim`` into a bin at least as full."""
    seen = 0
    full = shelf.capacity - shelf.gap[victim]
    for g in shelf.gaps:
        if g == 0:
            continue
        for b in shelf.by_gap[g]:
            if b == victim or shelf.capacity - g < full:
                continue
            seen += 1
            if tries is not None and seen > tries:
                return False
            swaps = [y for y in shelf.items[b] if 0 < x[0] - y[0] <= g]
            if swaps:
                y = min(swaps)
                shelf.change(b, [y], [x])
                shelf.change(victim, [x], [y])
                return True
            for z in shelf.items[victim]:
                if z is x:
                    continue
                swaps = [y for y in shelf.items[b] if 0 < x[0] + z[0] - y[0] <= g]
                if swaps:
                    y = min(swaps)
                    shelf.change(b, [y], [x, z])
                    shelf.change(victim, [x, z], [y])
                    return True
    return False


def pack_documents(docs: DataFrame, capacity: int = 2048, tokens_per_task: int = 4_000_000, tries: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``piece``, ``pieces``, ``first_token``, ``tokens``, ``container_id``): where each text, or each cut of one beyond the capacity, is put.

    A text of more than ``capacity`` tokens is cut into full pieces and a rest; no other is cut.
    Pieces from 0; ``first_token`` counts from 0. A full piece is a container of its own. The others are dealt by
    hash into tasks of about ``tokens_per_task`` tokens, each packed by local search for itself, so
    at most the last bin of a task is badly filled (one in 2,000 at the defaults). Repeated ids are told
    apart by their text and count as often as they occur. NULL, empty and blank texts have no token and need no
    container: they come with 0 pieces and ``container_id`` NULL. No documents give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    sized = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("what"), token_count(F.col(text)).alias("n"))
    sized = scratch.write(sized, "sized")
    total = sized.agg(F.sum("n").alias("n")).first()["n"] or 0
    tasks = max(1, -(-total // tokens_per_task))
    pieces = F.ceil(F.col("n") / capacity).cast("int")
    cut = sized.where("n > 0").select("doc_id", "what", "n", pieces.alias("pieces"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    cut = cut.withColumn("first_token", F.col("piece") * capacity).withColumn("tokens", F.least(F.lit(capacity), F.col("n") - F.col("first_token")))
    cut = cut.withColumn("task", F.pmod(F.xxhash64("doc_id", "what", "piece"), F.lit(tasks)).cast("long"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("what", "ascending"), ("piece", "ascending")])
        bins = pack(table.column("tokens").to_numpy(), capacity, tries)
        # Bins of all tasks get different ids without a count of those before.
        ids = bins * tasks + table.column("task").to_numpy()
        return table.select(["doc_id", "piece", "pieces", "first_token", "tokens"]).append_column("container_id", pa.array(ids, pa.int64()))

    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, pieces int, first_token int, tokens int, container_id long"
    packed = cut.select("doc_id", "what", "piece", "pieces", "first_token", "tokens", "task").groupBy("task").applyInArrow(lambda t: fill(t), schema)
    blank = sized.where("n = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("pieces"), F.lit(0).alias("first_token"), F.lit(0).alias("tokens"), F.lit(None).cast("long").alias("container_id"))
    return packed.unionByName(blank)


def cut_documents(packed: DataFrame) -> DataFrame:
    """(``doc_id``) of the texts that had to be cut."""
    return packed.where("pieces > 1").select("doc_id").distinct()


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: (``containers``, ``tokens``, ``least``, ``fill``); ``least`` is the number of containers without any space left over."""
    each = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("t"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("tokens"), F.ceil(F.coalesce(F.sum("t"), F.lit(0)) / capacity).cast("long").alias("least"), F.round(F.coalesce(F.sum("t") / (F.count(F.lit(1)) * capacity), F.lit(0.0)), 6).alias("fill"))


def packing_facts(docs: DataFrame, packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row of what must hold: ``rows`` and ``tokens`` of the pieces, and how many containers are overfull, texts cut without need, pieces out of place and non-blank texts without a container."""
    sized = docs.select("doc_id", token_count(F.col("text")).alias("n"))
    texts = sized.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("texts"))
    held = packed.groupBy("doc_id").agg(F.sum("tokens").cast("long").alias("got"), F.count_if((F.col("pieces") > 0) & (F.col("piece") == 0) & F.col("container_id").isNotNull()).alias("placed"))
    lost = texts.join(held, texts["doc_id"].eqNullSafe(held["doc_id"]), "full").agg(F.count_if(~F.col("n").eqNullSafe(F.col("got")) | ~F.col("texts").eqNullSafe(F.col("placed"))).alias("lost"))
    load = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > capacity).alias("overfull"))
    odd = (F.col("first_token") != F.col("piece") * capacity) | (F.col("tokens") > capacity) | ((F.col("piece") < F.col("pieces") - 1) & (F.col("tokens") < capacity))
    base = packed.agg(F.count_if(F.col("pieces") > 0).alias("pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.count_if(odd).alias("odd"))
    return base.crossJoin(load).crossJoin(lost)  # three single rows
