"""Same or near-same records across splits.

Digests are matched by winnowing. Hashes of 64 bits with up to 8 changed bits are beyond it: the
longest run that two of them must share has 7 bits, and seeds of 7 bits select nothing. They
are matched by ball hashing instead; the alignment is then that of equal bit positions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenset.functions.text import folded, folded_source, valid_phash
from lumenset.llm.ballhash import RADIUS, image_pairs, near_pairs
from lumenset.scratch import Scratch


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive characters along the last axis."""
    n = codes.shape[-1] - k + 1
    grams = np.zeros((*codes.shape[:-1], n), np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + codes[..., i : i + n] + np.uint64(1)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    return grams


def winnow_all(texts: list[str], k: int, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``winnow`` of each text; texts of one length that fill no more than one window, as digests do, are hashed together."""
    out: list = [None] * len(texts)
    short: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        if len(t) < window + k:
            short.setdefault(len(t), []).append(i)
        else:
            out[i] = winnow(_codes(t), k, window)
    for n, at in short.items():
        grams = _grams(_codes("".join(texts[i] for i in at)).reshape(len(at), n), min(k, n))
        place = grams.shape[1] - 1 - grams[:, ::-1].argmin(1)
        least = grams[np.arange(len(at)), place]
        for row, i in enumerate(at):
            out[i] = (least[row : row + 1], place[row : row + 1])
    return out


def winnow(codes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions): of each ``window`` consecutive rolling hashes of k characters the smallest, each place once.

    Every common substring of ``window + k - 1`` characters shares a selected hash. Of equal hashes the one that the window
    before selected stays, else the last is taken, so a monotonous text has one seed a window and not one a place. A text
    shorter than k has one seed, the hash of all it holds.
    """
    grams = _grams(codes, min(k, len(codes)))
    w = min(window, len(grams))
    spans = np.lib.stride_tricks.sliding_window_view(grams, w)
    best = np.arange(len(spans)) + w - 1 - spans[:, ::-1].argmin(1)
    at = best[np.flatnonzero(np.r_[True, best[1:] != best[:-1]])]
    if len(at) > 1 and (grams[at[1:]] == grams[at[:-1]]).any():
        kept, now = [], -1
        for i, p in enumerate(best.tolist()):
            if now < i or grams[now] != grams[p]:
                now = p
                kept.append(p)
        at = np.array(kept)
    return grams[at], at


def text_seeds(texts: DataFrame, k: int, window: int) -> DataFrame:
    """(``id``, ``side``, ``text``, ``hashes``, ``places``) of (``id``, ``side``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds = winnow_all(b.column("text").to_pylist(), k, window)
            hashes = pa.array([h.view(np.int64) for h, _ in seeds], pa.list_(pa.int64()))
            places = pa.array([p.astype(np.int32) for _, p in seeds], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, hashes, places], names=[*b.schema.names, "hashes", "places"])

    return texts.select("id", F.col("side").cast("int").alias("side"), "text").mapInArrow(run, "id long, side int, text string, hashes array<long>, places array<int>")


def _rows(a: Sequence, b: Sequence, keep: bool) -> tuple[int, list[int]]:
    """Bit-parallel longest common subsequence: bit i of a row is 0 where a[: i + 1] gains one on a[:i]. The last row, or all if they are kept."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, []
    for y in b:
        u = v & where.get(y, 0)
        if u:
            v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return v, rows


def common_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence."""
    return len(a) - _rows(a, b, False)[0].bit_count()


def common_chain(a: Sequence, b: Sequence, most_bits: int = 1 << 28) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, in order. Beyond ``most_bits`` of rows the second sequence is halved first, so memory is bounded."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) * len(y) > most_bits and len(y) > 1:
        half = len(y) // 2
        gains = lambda v: np.concatenate([[0], np.cumsum([c == "0" for c in reversed(f"{v:0{len(x)}b}")])])
        front, back = gains(_rows(x, y[:half], False)[0]), gains(_rows(x[::-1], y[half:][::-1], False)[0])
        cut = int(np.argmax(front + back[::-1]))
        mid = common_chain(x[:cut], y[:half], most_bits) + [(i + cut, j + half) for i, j in common_chain(x[cut:], y[half:], most_bits)]
    else:
        rows = _rows(x, y, True)[1]
        mid, i, j = [], len(x), len(y)
        while i and j:
            if rows[j - 1] >> (i - 1) & 1:
                i -= 1
            else:
                j -= 1
                if not (j and not rows[j - 1] >> (i - 1) & 1):
                    i -= 1
                    mid.append((i, j))
        mid.reverse()
    ends = [(len(a) - tail + t, len(b) - tail + t) for t in range(tail)]
    return [(t, t) for t in range(head)] + [(i + head, j + head) for i, j in mid] + ends


def aligned_coverage(a: str, b: str, seeds_a: tuple[np.ndarray, np.ndarray], seeds_b: tuple[np.ndarray, np.ndarray], k: int, least: float = 0.0) -> float:
    """Part of the longer text that agrees in an alignment along the longest collinear chain of common seeds.

    Seeds of the chain anchor the alignment, on as many diagonals as there are insertions and removals; between anchors and at
    both ends it is extended by the longest common subsequence of what lies there. That may miss agreement in texts that repeat
    themselves; so where it stays below ``least``, the subsequence of the whole texts decides.
    """
    if a == b:
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return min(len(a), len(b)) / max(len(a), len(b))  # an upper bound
    chain = common_chain(seeds_a[0].tolist(), seeds_b[0].tolist())
    agree, ea, eb = 0, 0, 0
    for i, j in chain:
        pa_, pb = int(seeds_a[1][i]), int(seeds_b[1][j])
        on = min(k, len(a) - pa_, len(b) - pb)
        if pa_ - ea == pb - eb and pa_ < ea:  # overlaps the anchor before it on the same diagonal
            step = pa_ + on - ea
            agree, ea, eb = agree + max(0, step), max(ea, pa_ + on), max(eb, pb + on)
        elif pa_ >= ea and pb >= eb and a[pa_ : pa_ + on] == b[pb : pb + on]:
            agree += common_length(a[ea:pa_], b[eb:pb]) + on
            ea, eb = pa_ + on, pb + on
    agree += common_length(a[ea:], b[eb:])
    if agree < least * max(len(a), len(b)) - 1e-9:
        agree = common_length(a, b)
    return agree / max(len(a), len(b))


def text_overlaps(texts: DataFrame, min_coverage: float = 1.0, k: int = 16, window: int = 17, min_shared: float | None = None, pairs_per_slot: int = 20_000) -> DataFrame:
    """(``text_a``, ``text_b``, ``coverage``): texts of side 1 and side 2 of which ``min_coverage`` or more of the longer one agrees.

    ``texts``: ``text``, ``side`` (1, 2, or 3 for both); equal texts count once, so copies never multiply. NULL and empty texts match nothing.
    Both texts must share ``min_shared`` of the different seeds of that which has more (all for a coverage of 1, else three in ten by default), and each
    pair that does is looked at: two such texts share one of the rarest ``1 - min_shared`` of the seeds of each, so only these are joined,
    which keeps phrases that many texts have out of the join without losing a pair. A seed that is still frequent is dealt
    into slots of ``pairs_per_slot`` texts. ``aligned_coverage`` gives the coverage.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark, "overlaps")
    share = min_shared if min_shared is not None else 1.0 if min_coverage >= 1 else 0.3
    once = texts.where("text is not null and text <> ''").groupBy("text").agg(F.bit_or("side").cast("int").alias("side"))
    once = scratch.write(once.withColumn("id", F.monotonically_increasing_id()), "texts")
    seeds = scratch.write(text_seeds(once, k, window).withColumn("different", F.array_distinct("hashes")), "seeds")
    each = seeds.select("id", "side", F.explode("different").alias("hash"))
    common = each.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.bit_or("side").alias("both")).where("both = 3")
    # Seeds of one side alone are the rarest that a pair can't share; they count towards the length of the prefix and join nothing.
    held = each.join(common, "hash").groupBy("id", "side").agg(F.array_sort(F.collect_list(F.struct("texts", "hash"))).alias("known"))
    n = F.size("different")
    prefix = n - F.ceil(n * share - 1e-9).cast("int") + 1 - (n - F.size("known"))
    rare = held.join(seeds.select("id", "different"), "id").where(prefix > 0).select("id", "side", F.explode(F.slice("known", F.lit(1), prefix)).alias("s")).select("id", "side", "s.*")
    slots = F.ceil(F.col("texts") / pairs_per_slot).cast("int")
    a = rare.where("side & 1 > 0").select("hash", F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"))
    b = rare.where("side & 2 > 0").select("hash", F.col("id").alias("b"), F.pmod(F.xxhash64("id"), slots).cast("int").alias("slot"))
    pairs = scratch.write(a.join(b, ["hash", "slot"]).select("a", "b").distinct(), "pairs")
    side = lambda x: seeds.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("text", "hashes", "places", "different")])
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    enough = F.size(F.array_intersect("different_a", "different_b")) >= F.greatest(F.size("different_a"), F.size("different_b")) * share - 1e-9
    met = met.where(enough).select("text_a", "text_b", "hashes_a", "places_a", "hashes_b", "places_b")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            seed = lambda x, i: (c[f"hashes_{x}"][i].values.to_numpy(), c[f"places_{x}"][i].values.to_numpy())
            out = [aligned_coverage(c["text_a"][i].as_py(), c["text_b"][i].as_py(), seed("a", i), seed("b", i), k, min_coverage) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([c["text_a"], c["text_b"], pa.array(out, pa.float64())], names=["text_a", "text_b", "coverage"])

    return met.mapInArrow(align, "text_a string, text_b string, coverage double").where(F.col("coverage") >= min_coverage - 1e-9)


def document_overlaps(docs: DataFrame, evaluation: Column, min_coverage: float = 0.8, k: int = 16, window: int = 17) -> DataFrame:
    """(``evaluation_id``, ``train_id``, ``coverage``, ``evaluation_copies``, ``train_copies``): texts of ``evaluation`` rows that other rows hold too, wholly or by ``min_coverage``.

    A pair stands for all rows with its two texts: it has the smallest ``doc_id`` on each side and the number of rows there. A NULL condition counts as
    false; rows without an id or text are left out. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "document-overlaps")
    rows = docs.where("doc_id is not null and trim(text) <> ''").select("doc_id", "text", F.when(F.coalesce(evaluation, F.lit(False)), 2).otherwise(1).alias("side"))
    kinds = scratch.write(rows.groupBy("text", "side").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "kinds")
    met = scratch.write(text_overlaps(kinds.select("text", "side"), min_coverage, k, window), "met")
    side = lambda s, text, name: kinds.where(F.col("side") == s).select(F.col("text").alias(text), F.col("least").alias(f"{name}_id"), F.col("n").alias(f"{name}_copies"))
    both = met.join(side(1, "text_a", "train"), "text_a").join(side(2, "text_b", "evaluation"), "text_b")
    return both.select("evaluation_id", "train_id", F.round("coverage", 6).alias("coverage"), "evaluation_copies", "train_copies")


def sided_images(rows: DataFrame) -> DataFrame:
    """(``path``, ``md5``, ``h``, ``side``): each image with each of its digests and hashes; side 1 is train, 2 is val or test, 3 both. Images without a split are left out."""
    side = F.when(F.col("s") == "train", 1).when(F.col("s").isin("val", "test"), 2)
    each = rows.where("path is not null").select("path", folded(F.col("md5_hash")).alias("md5"), valid_phash(F.col("phash")).alias("h"), folded(F.col("split")).alias("s"))
    sides = each.select("path", side.alias("side")).where("side is not null").groupBy("path").agg(F.bit_or("side").alias("side"))
    return each.select("path", "md5", "h").distinct().join(sides, "path")


def cross_split_pairs(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(``path_a``, ``path_b``, ``coverage``), smaller path first: different images, one in train and one in val or test, with the same digest or near hashes.

    ``coverage`` is 1 for equal digests, else the share of the 64 bits that agree; the larger one counts.
    NULL, blank and malformed digests and hashes match nothing; an image in both sides
    pairs with images of either. Copies pair with each other, as each such pair is a result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "cross-split")
    images = scratch.write(sided_images(rows), "images")
    near = image_pairs(images.select("path", "h", "side").distinct(), radius, "side").select("path_a", "path_b", (1 - F.col("distance") / 64).alias("coverage"))
    digests = images.where("md5 is not null").select("path", "md5", "side").distinct()
    same = text_overlaps(digests.select(F.col("md5").alias("text"), "side"))
    a = digests.where("side & 1 > 0").select(F.col("md5").alias("text_a"), F.col("path").alias("pa"))
    b = digests.where("side & 2 > 0").select(F.col("md5").alias("text_b"), F.col("path").alias("pb"))
    equal = same.join(a, "text_a").join(b, "text_b").where("pa <> pb").select(F.least("pa", "pb").alias("path_a"), F.greatest("pa", "pb").alias("path_b"), "coverage")
    return near.unionByName(equal).groupBy("path_a", "path_b").agg(F.max("coverage").alias("coverage"))


def _met_kinds(kinds: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(``id``, ``partners``, ``apart``) of kinds of images: how many train images each image of the kind meets, and the fewest bits between them.

    ``kinds``: ``id``, ``ms`` and ``hs`` (digests and hashes), ``side``, ``n`` (images of the kind). Kinds with at most one digest and one hash are counted by
    those that share the digest, plus those with a near hash, less those with both, so neither copies nor images that share a hash or digest are ever paired. Only
    kinds with several digests or hashes are listed against the kinds they meet.
    """
    of_train, of_evaluation, own = "side & 1 > 0", "side & 2 > 0", (F.col("side") == 3).cast("int")
    hashes = kinds.select(F.explode("hs").alias("h"), "side")
    near = near_pairs(hashes, radius, "side").select("h1", "h2", "distance")
    same = hashes.groupBy("h").agg(F.bit_or("side").alias("side")).where("side = 3").select(F.col("h").alias("h1"), F.col("h").alias("h2"), F.lit(0).alias("distance"))
    ways = near.unionByName(near.select(F.col("h2").alias("h1"), F.col("h1").alias("h2"), "distance")).unionByName(same)
    ways = scratch.write(ways.select(F.col("h1").alias("hx"), F.col("h2").alias("hy"), F.col("distance").alias("d")), "ways")
    single = kinds.where("not several").select("id", F.get("ms", F.lit(0)).alias("m"), F.get("hs", F.lit(0)).alias("hx"), "side", "n")
    x, y = single.where(of_evaluation).withColumn("own", own), single.where(of_train).select("m", F.col("hx").alias("hy"), "n")
    left = lambda n, at: n - F.when(at, F.col("own")).otherwise(0)
    by_hash = x.drop("n").join(ways, "hx").join(y.where("hy is not null").groupBy("hy").agg(F.sum("n").alias("n")), "hy").select("id", "d", left(F.col("n"), F.col("hx") == F.col("hy")).alias("k"))
    by_digest = x.drop("n").join(y.where("m is not null").groupBy("m").agg(F.sum("n").alias("n")), "m").select("id", F.lit(0).alias("d"), (F.col("n") - F.col("own")).alias("k"))
    by_both = x.drop("n").where("m is not null").join(ways, "hx").join(y.where("m is not null and hy is not null").groupBy("m", "hy").agg(F.sum("n").alias("n")), ["m", "hy"])
    by_both = by_both.select("id", F.lit(None).cast("int").alias("d"), (-left(F.col("n"), F.col("hx") == F.col("hy"))).alias("k"))
    # Kinds of several digests or hashes, on either side.
    end = lambda c, k, cond: kinds.where(cond).select(F.col("id").alias(f"id{k}"), "several", "n", "side", F.explode(c).alias(f"{c}{k}")).withColumnsRenamed({n: f"{n}{k}" for n in ("several", "n", "side")})
    listed = None
    for this, that in (("several", "true"), ("not several", "several")):
        hx = end("hs", "x", f"{of_evaluation} and {this}").withColumnRenamed("hsx", "hx").join(ways, "hx").join(end("hs", "y", f"{of_train} and {that}").withColumnRenamed("hsy", "hy"), "hy").select("idx", "idy", "ny", "sidex", "d")
        mx = end("ms", "x", f"{of_evaluation} and {this}").withColumnRenamed("msx", "m").join(end("ms", "y", f"{of_train} and {that}").withColumnRenamed("msy", "m"), "m").select("idx", "idy", "ny", "sidex", F.lit(0).alias("d"))
        listed = hx.unionByName(mx) if listed is None else listed.unionByName(hx).unionByName(mx)
    listed = listed.groupBy("idx", "idy").agg(F.min("d").alias("d"), F.max("ny").alias("n"), F.max("sidex").alias("side"))
    listed = listed.select(F.col("idx").alias("id"), "d", (F.col("n") - F.when((F.col("idx") == F.col("idy")) & (F.col("side") == 3), 1).otherwise(0)).alias("k"))
    every = by_hash.where("k > 0").unionByName(by_digest.where("k > 0")).unionByName(by_both).unionByName(listed.where("k > 0"))
    return every.groupBy("id").agg(F.sum("k").alias("partners"), F.min("d").alias("apart")).where("partners > 0")


def overlap_by_record(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(``path``, ``split``, ``dataset_source``, ``partners``, ``coverage``): for every row's image in an evaluation split, how many train images it meets and how closely at best.

    The same relation as ``cross_split_pairs``, but counted on kinds of images (equal digests, hashes and sides) and never listed for images with one digest and one hash.
    """
    scratch = Scratch(rows.sparkSession, "overlap-record")
    images = sided_images(rows).groupBy("path").agg(F.array_sort(F.collect_set("md5")).alias("ms"), F.array_sort(F.collect_set("h")).alias("hs"), F.max("side").alias("side"))
    images = scratch.write(images, "images")
    kinds = images.groupBy("ms", "hs", "side").agg(F.count(F.lit(1)).alias("n")).withColumn("several", (F.size("ms") > 1) | (F.size("hs") > 1)).withColumn("id", F.monotonically_increasing_id())
    kinds = scratch.write(kinds, "kinds")
    met = kinds.join(_met_kinds(kinds, radius, scratch), "id").select("ms", "hs", "side", "partners", (1 - F.col("apart") / 64).alias("coverage"))
    found = images.where("side & 2 > 0").join(met, ["ms", "hs", "side"]).select("path", "partners", "coverage")
    each = rows.select("path", folded(F.col("split")).alias("split"), folded_source(F.col("dataset_source")).alias("dataset_source")).where("path is not null").distinct()
    held = each.where(F.col("split").isin("val", "test"))
    return held.join(found, "path", "left").select("path", "split", "dataset_source", F.coalesce("partners", F.lit(0)).cast("long").alias("partners"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def overlap_report(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(``split``, ``dataset_source``, ``images``, ``overlapping``, ``pairs``, ``mean_coverage``) for val and test; NULL sources form a row of their own."""
    return overlap_by_record(rows, radius).groupBy("split", "dataset_source").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("partners") > 0).alias("overlapping"), F.sum("partners").alias("pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
