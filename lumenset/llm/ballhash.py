"""Near-duplicate fingerprints by meet-in-the-middle ball hashing.

All variants within half of the radius 8 would be 679,121 for each 64-bit fingerprint.
The fingerprint is therefore cut into three blocks first: of 8 differing bits at most 2
fall into some block, and within that block variants of one flipped bit meet in the
middle. So 67 variants find every pair, without a cap. For very many fingerprints there are two
blocks of 32 bits instead: of 8 differing bits at most 4 fall into one, variants of two flipped
bits meet, and of 14 times fewer pairs that meet by chance each costs as much; the result is the same.

The variants are not shuffled one by one. The upper bits of a block are its *route*: the
shuffle sends a fingerprint to its own route and to those one flipped bit away, and the
variants of the lower bits are made where it arrives. A pair is reported at one place
only, in the first block that holds at most two of its differences and on the smallest
route on which it meets, so the result needs no global deduplication.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lumenset.llm.components import connected_components
from lumenset.scratch import Scratch

RADIUS = 8


@dataclass(frozen=True)
class Layout:
    """Lowest bit and width of each block, and how many bits a variant flips in one."""

    blocks: tuple[tuple[int, int], ...]
    reach: int

    def others(self, block: int) -> list[tuple[int, int]]:
        """The bits outside a block in two parts, one of which holds at most 4 of 8 differences."""
        rest = [b for k, b in enumerate(self.blocks) if k != block]
        return rest if len(rest) == 2 else [(rest[0][0], rest[0][1] // 2), (rest[0][0] + rest[0][1] // 2, rest[0][1] - rest[0][1] // 2)]


THREE, TWO = Layout(((0, 21), (21, 21), (42, 22)), 1), Layout(((0, 32), (32, 32)), 2)


def _flips(width: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` set bits."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return np.array(masks, dtype=np.uint64)


def _meetings(keys: np.ndarray, items: np.ndarray, dense: int | None) -> Iterator[tuple[np.ndarray, np.ndarray] | np.ndarray]:
    """Pairs of items under one key, in pieces; runs longer than ``dense`` come as the array of their items instead."""
    order = np.argsort(keys, kind="stable")
    keys, items = keys[order], items[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    if dense is not None and (sizes > dense).any():
        for s, n in zip(starts[sizes > dense], sizes[sizes > dense]):
            yield np.unique(items[s : s + n])
        keep = np.repeat(sizes <= dense, sizes)
        keys, items = keys[keep], items[keep]
    here, k = np.arange(len(keys)), 1
    while len(here := here[here + k < len(keys)]):
        here = here[keys[here] == keys[here + k]]
        for i in range(0, len(here), 1 << 22):
            part = here[i : i + (1 << 22)]
            yield items[part], items[part + k]
        k += 1


def _close(h: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    near = np.bitwise_count(h[i] ^ h[j]) <= radius
    return i[near], j[near]


def _dense_pairs(h: np.ndarray, members: np.ndarray, block: int, radius: int, layout: Layout = THREE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All close pairs among many fingerprints that agree in one block: the other two parts meet in the middle with two flipped bits.

    A run that is dense again agrees nearly in two parts, so its members differ in the third
    alone and mostly are near; those are compared with each other in slices.
    """
    for low, width in layout.others(block):
        masks = _flips(width, 2)
        step = max(1, (1 << 22) // len(masks))
        part = (h[members] >> np.uint64(low)) & np.uint64((1 << width) - 1)
        passes = -(-len(members) * len(masks) // (1 << 24))
        for turn in range(passes):  # the keys of one residue at a time, so memory stays the same for any run
            keys, items = [], []
            for i in range(0, len(members), step):
                k = (part[i : i + step, None] ^ masks).ravel()
                own = np.flatnonzero(k % np.uint64(passes) == np.uint64(turn))
                keys.append(k[own])
                items.append(members[i + own // len(masks)])
            for met in _meetings(np.concatenate(keys), np.concatenate(items), 4096):
                if isinstance(met, tuple):
                    yield _close(h, *met, radius)
                    continue
                for s in range(0, len(met), 256):
                    a = np.repeat(met[s : s + 256], len(met))
                    b = np.tile(met, len(met[s : s + 256]))
                    yield _close(h, a[a < b], b[a < b], radius)


def near_pairs_on_route(h: np.ndarray, side: np.ndarray, slot: np.ndarray, block: int, route: int, bits: int, radius: int = RADIUS, slots: tuple[int, int] | None = None, layout: Layout = THREE) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs that this route reports. ``side`` 0 pairs with all; else a pair needs bit 1 on one end and bit 2 on the other.

    ``slots``: of a route that is spread over several tasks, the two slots that this task compares.
    """
    low, width = layout.blocks[block]
    value = (h >> np.uint64(low)) & np.uint64((1 << width) - 1)
    lower = width - bits
    high, rest = value >> np.uint64(lower), value & np.uint64((1 << lower) - 1)
    # What a fingerprint has flipped on its way to the route it can't flip again.
    away = np.bitwise_count(high ^ np.uint64(route))
    keys, items = [], []
    for spent in range(layout.reach + 1):
        own, masks = np.flatnonzero(away == spent), _flips(lower, layout.reach - spent)
        keys.append((rest[own, None] ^ masks).ravel())
        items.append(np.repeat(own, len(masks)))
    keys, items = np.concatenate(keys), np.concatenate(items)
    found = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        i, j = _close(h, i, j, radius)
        i, j = np.where(h[i] < h[j], i, j), np.where(h[i] < h[j], j, i)
        ok = h[i] != h[j]
        x = h[i] ^ h[j]
        for k in range(block):
            w = (x >> np.uint64(layout.blocks[k][0])) & np.uint64((1 << layout.blocks[k][1]) - 1)
            ok &= np.bitwise_count(w) > 2 * layout.reach
        ok &= np.bitwise_count((x >> np.uint64(low)) & np.uint64((1 << width) - 1)) <= 2 * layout.reach
        i, j, ok = i[ok], j[ok], ok[ok]
        # The smallest route between theirs on which both are present.
        ok &= _between(high[i], high[j], layout.reach) == np.uint64(route)
        si, sj = side[i], side[j]
        ok &= ((si == 0) & (sj == 0)) | ((si & 1 > 0) & (sj & 2 > 0)) | ((si & 2 > 0) & (sj & 1 > 0))
        if slots is not None:
            ok &= (np.minimum(slot[i], slot[j]) == slots[0]) & (np.maximum(slot[i], slot[j]) == slots[1])
        if ok.any():
            found.append(np.unique(np.stack([i[ok], j[ok]], 1), axis=0))

    for met in _meetings(keys, items, 1024):
        if isinstance(met, tuple):
            keep(*met)
        else:
            for pair in _dense_pairs(h, met, block, radius, layout):
                keep(*pair)
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 0], both[:, 1]


def _between(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """The smallest value that takes each bit from one of the two and differs from either in at most ``reach`` bits; they differ in at most twice as many.

    Bits in which they differ become 0 where that is allowed; of those set in one of them alone all but ``reach`` stay, the lowest ones.
    """
    out = a & b
    for one in (a & ~b, b & ~a):
        rest = one.copy()
        for _ in range(reach):  # what remains after the lowest bits that stay is at most ``reach`` bits
            low = rest & (~rest + np.uint64(1))
            stays = np.bitwise_count(rest) > reach
            out |= np.where(stays, low, np.uint64(0))
            rest = np.where(stays, rest ^ low, rest)
    return out


def _flipped(own: Column, above: int):
    return lambda f: own.bitwiseXOR(f).bitwiseOR(F.lit(above))


def _routes(h: Column, bits: int, layout: Layout = THREE) -> Column:
    """Array of route ids: block and upper bits of the block, own and with up to ``reach`` bits flipped."""
    out = []
    for k, (low, width) in enumerate(layout.blocks):
        own = F.shiftrightunsigned(h, low + width - bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        out.append(F.transform(F.lit(_flips(bits, layout.reach).astype(np.int32).tolist()).cast("array<int>"), _flipped(own, k << bits)))
    return F.concat(*out)


def near_pairs(hashes: DataFrame, radius: int = RADIUS, side: str | None = None, rows_per_task: int = 250_000, route_bits: int | None = None, layout: Layout | None = None) -> DataFrame:
    """(``h1``, ``h2``, ``distance``), h1 before h2 as unsigned numbers, for all pairs of different fingerprints at most ``radius`` bits apart.

    ``hashes``: ``h`` (64 bits as a signed long) and, if only pairs across two sides are
    wanted, the column that ``side`` names: 1, 2 or 3 for both. Other columns are ignored. Repeated fingerprints count once (with the union of
    their sides), NULL ones not at all; no rows give no rows. ``radius`` may be 0 to 8.

    A route is a task's work, and the number of route bits grows with the number of
    fingerprints so that a route holds about ``rows_per_task`` of them. Where many fingerprints share
    a route they are dealt into slots by hash, and each two slots are compared in a task of
    their own. The counts of routes behind this are at most 3 * 2**bits rows (196,608), which is what is broadcast.
    ``layout`` is ``THREE`` blocks, or ``TWO`` beyond 100 million fingerprints, where chance meetings cost more than the additional copies.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("radius must be 0 to 8")
    spark = hashes.sparkSession
    scratch = Scratch(spark, "near-pairs")
    seen = Observation()
    sides = F.bit_or(side).cast("int") if side else F.lit(0)
    once = hashes.where("h is not null").groupBy("h").agg(sides.alias("side"))
    once = scratch.write(once.observe(seen, F.count(F.lit(1)).alias("n")), "once")
    n = seen.get["n"]
    layout = layout or (THREE if n <= 100_000_000 else TWO)
    copies = lambda bits: len(_flips(bits, layout.reach))
    bits = 4
    while bits < 16 and n * copies(bits) > rows_per_task << bits:
        bits += 1
    bits = route_bits or bits
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * copies(bits) // (rows_per_task * 8)))
    sent = once.repartition(parts) if n > rows_per_task else once
    sent = sent.select("h", "side", F.explode(_routes(F.col("h"), bits, layout)).alias("route"))
    hot = 0
    if n > 4 * rows_per_task:  # else no route can hold as many
        sizes = once.select(F.explode(_routes(F.col("h"), bits, layout)).alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * rows_per_task)
        some = Observation()
        large = scratch.write(sizes.select("route", F.ceil(F.col("n") / (2 * rows_per_task)).cast("int").alias("slots")).observe(some, F.count(F.lit(1)).alias("n")), "large")
        hot = some.get["n"]
    if hot:
        # At most a row for each route: 3 * 2**16.
        sent = sent.join(F.broadcast(large), "route", "left")
        slots = F.coalesce("slots", F.lit(1))
        slot = F.pmod(F.xxhash64("h"), slots).cast("int")
        duty = F.transform(F.sequence(F.lit(0), slots - 1), lambda o: F.least(slot, o) * 65536 + F.greatest(slot, o))
        sent = sent.withColumn("slot", slot).withColumn("duty", F.explode(duty)).drop("slots")
    else:
        sent = sent.withColumn("slot", F.lit(0)).withColumn("duty", F.lit(0))

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        route, duty = key[0].as_py(), key[1].as_py()
        h = table.column("h").to_numpy().view(np.uint64)
        i, j = near_pairs_on_route(h, table.column("side").to_numpy(), table.column("slot").to_numpy(), route >> bits, route & ((1 << bits) - 1), bits, radius, divmod(duty, 65536) if hot else None, layout)
        return pa.table({"h1": h[i].view(np.int64), "h2": h[j].view(np.int64), "distance": np.bitwise_count(h[i] ^ h[j]).astype(np.int32)})

    return sent.groupBy("route", "duty").applyInArrow(solve, "h1 long, h2 long, distance int")


def image_pairs(images: DataFrame, radius: int = RADIUS, side: str | None = None) -> DataFrame:
    """(``path_a``, ``path_b``, ``distance``), smaller path first, for all pairs of different images with near hashes.

    ``images``: ``path``, ``h`` (NULL where there is no valid hash) and, if ``side`` names it, a column as in ``near_pairs``.
    Pairs are searched among distinct hashes and carried over to the images by joins.
    With several hashes of one image the smallest distance counts.
    """
    spark = images.sparkSession
    scratch = Scratch(spark, "image-pairs")
    sided = side is not None
    images = images.where("path is not null and h is not null").select("path", "h", *([F.col(side).alias("side")] if sided else []))
    pairs = near_pairs(images, radius, "side" if sided else None)
    shared = images.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("h1"), F.col("h").alias("h2"), F.lit(0).alias("distance"))
    pairs = scratch.write(pairs.unionByName(shared), "pairs")
    a = images.select(F.col("h").alias("h1"), F.col("path").alias("pa"), *([F.col("side").alias("sa")] if sided else []))
    b = images.select(F.col("h").alias("h2"), F.col("path").alias("pb"), *([F.col("side").alias("sb")] if sided else []))
    joined = pairs.join(a, "h1").join(b, "h2").where("pa <> pb and (h1 <> h2 or pa < pb" + (" or sa <> sb)" if sided else ")"))
    if sided:
        joined = joined.where("(sa & 1 > 0 and sb & 2 > 0) or (sa & 2 > 0 and sb & 1 > 0)")
    return joined.groupBy(F.least("pa", "pb").alias("path_a"), F.greatest("pa", "pb").alias("path_b")).agg(F.min("distance").alias("distance"))


def near_groups(images: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(``path``, ``group_path``, ``links``): for every image the smallest path it is near to, directly or over others, and how many images are near it.

    ``images``: ``path``, ``h`` as in ``image_pairs``. The work is done on distinct hashes, so copies are counted and never paired,
    however many there are. An image without a hash is a group of its own. An image with several hashes joins their groups, and one that is
    near by two of them counts once for each. NULL paths are left out.
    """
    scratch = Scratch(images.sparkSession, "near-groups")
    images = scratch.write(images.where("path is not null").select("path", "h").distinct(), "images")
    held = images.where("h is not null")
    pairs = scratch.write(near_pairs(held.select("h"), radius).select("h1", "h2"), "pairs")
    several = held.groupBy("path").agg(F.min("h").alias("h1"), F.max("h").alias("top")).where("h1 <> top").select("path", "h1")
    same = held.join(several, "path").where("h <> h1").select("h1", F.col("h").alias("h2"))
    named = connected_components(pairs.unionByName(same), "h1", "h2").select(F.col("node").alias("h"), "component")
    copies = scratch.write(held.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("least")), "copies")
    ways = pairs.unionByName(pairs.select(F.col("h2").alias("h1"), F.col("h1").alias("h2")))
    beside = ways.join(copies.select(F.col("h").alias("h2"), "n"), "h2").groupBy(F.col("h1").alias("h")).agg(F.sum("n").alias("beside"))
    kinds = copies.join(named, "h", "left").join(beside, "h", "left").select("h", F.coalesce("component", "h").alias("component"), "least", (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("links"))
    kinds = scratch.write(kinds, "kinds")
    heads = kinds.groupBy("component").agg(F.min("least").alias("group_path"))
    each = held.join(kinds.join(heads, "component").select("h", "group_path", "links"), "h")
    each = each.groupBy("path").agg(F.min("group_path").alias("group_path"), F.sum("links").alias("links"))
    alone = images.where("h is null").select("path").join(held.select("path"), "path", "left_anti").select("path", F.col("path").alias("group_path"), F.lit(0).cast("long").alias("links"))
    return each.unionByName(alone)
