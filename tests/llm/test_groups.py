"""Matches, splits and near copies against brute force on small tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql.functions import col as spark_col

from lumenset.llm.ballhash import TWO, image_pairs, near_groups, near_pairs
from lumenset.llm.components import connected_components
from lumenset.llm.matches import grouped_images, match_groups
from lumenset.llm.overlap import aligned_coverage, common_chain, common_length, cross_split_pairs, document_overlaps, overlap_by_record, overlap_report, text_overlaps, winnow, winnow_all
from lumenset.llm.splits import related_groups, split_conflicts, split_shares, stratified_splits, stratify


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


PAIRS = "path_a string, path_b string, distance int, matcher string, side string, h long"
IMAGES = "path string, phash string, component long, extra int"


@pytest.mark.parametrize("kind", ["chain", "random", "star", "loops", "none"])
def test_components(spark, kind):
    r = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(-20, 60)],
        "random": [(r.randrange(200), r.randrange(200)) for _ in range(150)] * 2,
        "star": [(5, i) for i in range(100, 300)] + [(1000, 999), (999, 5)],
        "loops": [(1, 1), (None, 2), (3, None)],
        "none": [],
    }[kind]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == union_find(edges)


def test_match_groups(spark):
    images = spark.createDataFrame([("a", "0" * 16, 1, 1), ("b", "F" * 16, 1, 2), ("b", None, 1, 2), ("c", "", 1, 3), ("d", "zz", 1, 4), ("e", None, 1, 5), (None, None, 0, 0)], IMAGES)
    pairs = [("./b", " a ", 3, None, "x", 1), ("a", "b", None, "m", "x", 1), ("c", "b", 8, "m", "x", 1), ("d", "c", 9, "m", "x", 1), ("d", "d", 0, "m", "x", 1), ("d", "unknown", 0, "m", "x", 1), (None, "d", 0, "m", "x", 1), ("", "d", 0, "m", "x", 1), ("./d", "d", 1, None, None, None)]
    pairs = spark.createDataFrame(pairs, PAIRS)
    assert rows(match_groups(pairs, images)) == [("a", "a"), ("a", "b"), ("a", "c")]
    assert rows(grouped_images(pairs, images).select("path", "group_path")) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e")]
    assert dict(rows(grouped_images(pairs, images).where("phash is not null").select("path", "phash"))) == {"a": "0" * 16, "b": "f" * 16}
    assert rows(match_groups(pairs.where("false"), images)) == []
    assert rows(match_groups(pairs, images.where("false"))) == []


SPLITS = "path string, cluster_id string, phash string, split string, class_label string, kind string"


def test_related_groups_and_conflicts(spark):
    data = [
        ("a", "c1", None, "train", "x", ""), ("b", "c1", "0" * 15 + "A", " VAL", "x", ""), ("c", None, "0" * 15 + "a ", "val", "y", ""), ("d", " ", "nohash", "test", "y", ""),
        ("e", None, None, "train", None, ""), ("e", None, None, "Test", None, ""), ("f", "c2", None, None, "x", ""), ("g", "c2", None, "", "x", ""), (None, "c1", None, "train", "x", ""),
    ]
    t = spark.createDataFrame(data, SPLITS)
    groups = related_groups(t)
    assert rows(groups) == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("e", "e"), ("f", "f"), ("f", "g")]
    assert rows(split_conflicts(t, groups)) == [("a", "a"), ("a", "b"), ("a", "c"), ("e", "e")]
    assert rows(related_groups(t.where("false"))) == []


def test_stratified_splits(spark):
    r = random.Random(5)
    data = [(f"p{i:04}", f"c{r.randrange(150)}" if r.random() < 0.5 else None, None, None, r.choice(["x", "x", "x", "y", "Y ", None]), "") for i in range(900)]
    data += [(f"hot{i:04}", "hot", None, None, "x", "") for i in range(60)]
    t = spark.createDataFrame(data + data[:50], SPLITS)
    targets = spark.createDataFrame([("train", 0.7, 1), ("val", 0.15, 2), ("Test ", 0.15, 3), (None, 1.0, 4), ("", 1.0, 4)], "split string, ratio double, path int")
    out = [x.asDict() for x in stratified_splits(t, targets).collect()]
    assert sorted(x["path"] for x in out) == sorted({d[0] for d in data})
    place = {}
    for x in out:
        assert place.setdefault(x["group_path"], x["split"]) == x["split"]
    label = {d[0]: (d[4] or "unknown").strip().lower() for d in data}
    for name in ("x", "y", "unknown"):
        mine = [x["split"] for x in out if label[x["path"]] == name]
        for s, want in (("train", 0.7), ("val", 0.15), ("test", 0.15)):
            assert abs(mine.count(s) / len(mine) - want) < 0.03, (name, s)
    # However many tasks place the kinds, the result is the same.
    for per_task in (2, 7):
        assert rows(stratified_splits(t, targets, kinds_per_task=per_task).select("path", "split")) == sorted((x["path"], x["split"]) for x in out)
    shares = {(x["split"], x["label"]): x for x in split_shares(stratified_splits(t, targets), t, targets).collect()}
    assert shares["train", None]["images"] + shares["val", None]["images"] + shares["test", None]["images"] == len({d[0] for d in data})
    assert len(shares) == 12 and max(abs(x["off"]) for x in shares.values()) <= 8
    assert stratified_splits(t.where("false"), targets).collect() == []
    with pytest.raises(ValueError):
        stratified_splits(t, targets.where("false"))


def test_stratify_deals_all_groups():
    import pandas as pd

    kinds = pd.DataFrame({"kind": [["a=1"], ["a=2", "b=1"], ["b=5"]], "n": [1000, 7, 3]})
    out = stratify(kinds, ["s", "t"], [0.75, 0.25])
    for k, n in zip(kinds["kind"], kinds["n"]):
        mine = out[[x == k for x in out["kind"]]]
        assert sum(b - a + 1 for a, b in zip(mine["first"], mine["last"])) == n


def brute(h, radius, side=None):
    out = set()
    for i in range(len(h)):
        for j in range(i + 1, len(h)):
            ok = side is None or (side[i] & 1 and side[j] & 2) or (side[i] & 2 and side[j] & 1)
            if ok and h[i] != h[j] and bin(h[i] ^ h[j]).count("1") <= radius:
                out.add((min(h[i], h[j]), max(h[i], h[j])))
    return out


def some_hashes(n=250, seed=1):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n)]
    near = []
    for b in base:
        for _ in range(2):
            x = b
            for bit in r.sample(range(64), r.randrange(0, 11)):
                x ^= 1 << bit
            near.append(x)
    crowd = [(base[0] & 0x3FFFFF) | (r.getrandbits(21) << 21) for _ in range(100)]
    return sorted({*base, *near, *crowd, 0, 2**64 - 1, 1})


def frame(spark, h, side=None):
    signed = [x - 2**64 if x >= 2**63 else x for x in h]
    return spark.createDataFrame([(x, int(s), "x") for x, s in zip(signed, side if side is not None else [0] * len(h))], "h long, where int, side string")


@pytest.mark.parametrize("options", [{}, {"rows_per_task": 40, "route_bits": 4}, {"route_bits": 9}, {"radius": 3}, {"radius": 0}, {"layout": TWO}, {"layout": TWO, "rows_per_task": 40, "route_bits": 5}, {"layout": TWO, "route_bits": 9, "radius": 5}])
def test_near_pairs_are_complete(spark, options):
    h = some_hashes()
    got = [(r["h1"] % 2**64, r["h2"] % 2**64) for r in near_pairs(frame(spark, h + h[:20]), **options).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(h, options.get("radius", 8))


def test_near_pairs_across_sides(spark):
    h = some_hashes(seed=2)
    side = [random.Random(i).choice([1, 2, 3]) for i in range(len(h))]
    got = [(r["h1"] % 2**64, r["h2"] % 2**64) for r in near_pairs(frame(spark, h, side), side="where").collect()]
    assert set(got) == brute(h, 8, side) and len(got) == len(set(got))


def test_near_pairs_without_rows(spark):
    assert near_pairs(frame(spark, [])).collect() == []
    assert near_pairs(spark.createDataFrame([(None,)], "h long")).collect() == []


def test_dense_runs_are_complete():
    from lumenset.llm import ballhash

    r = np.random.default_rng(0)
    h = np.unique((r.integers(0, 2**21, 3000).astype(np.uint64) << np.uint64(42)) | np.uint64(77))
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if int(h[i] ^ h[j]).bit_count() <= 8}
    got = set()
    for i, j in ballhash._dense_pairs(h, np.arange(400), 0, 8):
        got |= set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
    assert got == want


def test_image_pairs(spark):
    data = [("a", 5, 1), ("b", 5, 2), ("b", 5, 2), ("c", 4, 2), ("d", -1, 1), ("e", None, 1), (None, 5, 1), ("c", 7, 2)]
    t = spark.createDataFrame(data, "path string, h long, side int")
    assert rows(image_pairs(t)) == [("a", "b", 0), ("a", "c", 1), ("b", "c", 1)]
    assert rows(image_pairs(t, side="side")) == [("a", "b", 0), ("a", "c", 1)]


def test_near_groups_count_copies_without_pairing_them(spark):
    h = some_hashes(40, 7)
    data = [(f"p{i:04}", x - 2**64 if x >= 2**63 else x, 1) for i, x in enumerate(h + h[:15])] + [(f"copy{i:05}", 1, 1) for i in range(3000)] + [("none", None, 1), ("none", None, 1), (None, 1, 1), ("both", 3, 1), ("both", None, 1)]
    t = spark.createDataFrame(data, "path string, h long, component int")
    named = sorted({(p, x) for p, x, _ in data if p and x is not None})
    want = union_find([(a, b) for i, (a, x) in enumerate(named) for b, y in named[i + 1 :] if ((x ^ y) & (2**64 - 1)).bit_count() <= 8 and not (a.startswith("copy") and b.startswith("copy") and a != "copy00000")])
    got = {r["path"]: (r["group_path"], r["links"]) for r in near_groups(t).collect()}
    assert {p: g for p, (g, _) in got.items()} == {p: want.get(p, p) for p in got} and len(got) == len({p for p, _ in named}) + 1
    assert got["copy00007"][1] == sum(((x ^ 1) & (2**64 - 1)).bit_count() <= 8 for _, x in named) - 1 and got["none"] == ("none", 0)
    assert near_groups(t.where("false")).collect() == []


EXPORT = "path string, md5_hash string, phash string, split string, dataset_source string, hash string"


def test_cross_split_pairs(spark):
    data = [
        ("a", "M1", None, "train", "s", ""), ("b", " m1", None, "val ", "s", ""), ("c", "m1", None, "TRAIN", "s", ""), ("d", "", "00000000000000ff", "test", "t", ""), ("e", " ", "000000000000000F", "train", "t", ""),
        ("f", None, "00000000000000fe", None, "t", ""), ("g", "short", None, "test", None, ""), ("h", "short", None, "train", None, ""), ("i", "x", "bad", "dev", "s", ""), ("j", "x", None, "train", "s", ""),
        ("k", "k", None, "train", "s", ""), ("k", "k", None, "test", "s", ""), ("l", "k", None, "test", "s", ""), (None, "m1", None, "test", "s", ""),
    ]
    t = spark.createDataFrame(data, EXPORT)
    got = rows(cross_split_pairs(t))
    assert [(a, b) for a, b, _ in got] == [("a", "b"), ("b", "c"), ("d", "e"), ("g", "h"), ("k", "l")]
    assert {(a, b): c for a, b, c in got}["d", "e"] == 1 - 4 / 64
    report = {(r["split"], r["dataset_source"]): r for r in overlap_report(t).collect()}
    assert report["val", "s"]["overlapping"] == 1 and report["val", "s"]["pairs"] == 2
    assert report["test", None]["overlapping"] == 1
    assert rows(cross_split_pairs(t.where("false"))) == []


def test_text_overlaps_align_shifted_texts(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh") for _ in range(5000))
    data = [(long, 1), ("xyz" + long[:4000], 2), ("q" * 50, 1), ("z" * 50, 2), ("tiny", 1), ("tiny", 2), (None, 1), ("", 2), (long, 1), ("=" * 9000, 1), ("=" * 9001, 2)]
    got = rows(text_overlaps(spark.createDataFrame(data, "text string, side int"), 0.5, 16, 20))
    assert sorted((a[:4], b[:4]) for a, b, _ in got) == sorted([(long[:4], "xyz" + long[0]), ("tiny", "tiny"), ("====", "====")])
    assert {a[:4]: c for a, b, c in got}[long[:4]] == 4000 / 5000


def common_by_table(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(p[j] + 1 if x == y else max(p[j + 1], q[j]))
        p = q
    return p[-1]


def edited(r, text, n, letters="xyz "):
    b = list(text)
    for _ in range(n):
        at = r.randrange(len(b) + 1)
        if r.random() < 0.5 or not b:
            b.insert(at, r.choice(letters))
        else:
            b.pop(min(at, len(b) - 1))
    return "".join(b)


def test_chains_and_alignment():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(0, 40))) for _ in range(2))
        want = common_by_table(a, b)
        assert common_length(a, b) == want
        for most in (1 << 28, 20):
            c = common_chain(a, b, most)
            assert len(c) == want and all(a[i] == b[j] for i, j in c) and all(x < y and z < w for (x, z), (y, w) in zip(c, c[1:]))
    seeds = lambda t: winnow(np.frombuffer(t.encode("utf-32-le"), np.uint32), 16, 17)
    for i in range(60):
        a = "".join(r.choice("abcdefgh ") for _ in range(r.randrange(20, 500))) if i % 2 else "ab " * r.randrange(10, 200)
        b = edited(r, a, r.randrange(0, 8))
        want = common_by_table(a, b) / max(len(a), len(b))
        got = aligned_coverage(a, b, seeds(a), seeds(b), 16)
        assert got <= want + 1e-9 and (i % 2 == 0 or got > want - 0.02)
        assert (aligned_coverage(a, b, seeds(a), seeds(b), 16, want) >= want - 1e-9) and aligned_coverage(a, b, seeds(a), seeds(b), 16, want + 0.01) < want + 0.01


def test_seeds_keep_every_place():
    r = random.Random(4)
    part = "".join(r.choice("abcdefgh") for _ in range(60))
    text = part + "1" * 5 + part + "2" * 7 + part + "3" * 3 + part
    h, at = winnow(np.frombuffer(text.encode("utf-32-le"), np.uint32), 16, 17)
    inner = {x for x, p in zip(h.tolist(), at.tolist()) if p + 33 <= 60}
    assert inner and all(h.tolist().count(x) == 4 for x in inner)
    some = ["a", "tiny", "0123456789abcdef" * 2, "fedcba9876543210" * 2, "same" * 8, text, "x" * 33, "x" * 32, "é😀" * 10]
    for (g, p), t in zip(winnow_all(some, 16, 17), some):
        one = winnow(np.frombuffer(t.encode("utf-32-le"), np.uint32), 16, 17)
        assert g.tolist() == one[0].tolist() and p.tolist() == one[1].tolist(), t
    same = winnow(np.frombuffer(("=" * 1000).encode("utf-32-le"), np.uint32), 16, 17)[1]
    assert np.diff(same).max() <= 17 and len(same) < 70


def test_text_overlaps_find_all_edited_texts(spark):
    r = random.Random(7)
    foot = "sent from the archive of the image group, do not reply to this address. " * 2
    base = ["".join(r.choice("abcdefghij klmnop") for _ in range(r.randrange(200, 900))) for _ in range(40)]
    left = [b + foot for b in base[:30]] + [base[30] * 3, "=" * 400, "short"]
    right = [edited(r, t, r.randrange(0, 14)) for t in left] + [b + foot for b in base[31:]] + ["q" + base[0][:100] + foot]
    data = [(t, 1) for t in left] + [(t, 2) for t in right] + [("both sides", 3), (left[0], 2), (None, 2), ("", 1)]
    want = {(a, b) for a in {*left, "both sides"} for b in {*right, left[0], "both sides"} if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and common_length(a, b) >= 0.8 * max(len(a), len(b)) - 1e-9}
    t = spark.createDataFrame([(*d, 1) for d in data], "text string, side int, id int")
    seeds = lambda x: set(winnow(np.frombuffer(x.encode("utf-32-le"), np.uint32), 16, 17)[0].tolist())
    shared = {(a, b) for a, b in want if len(seeds(a) & seeds(b)) >= 0.3 * max(len(seeds(a)), len(seeds(b)))}
    for options in ({}, {"pairs_per_slot": 3}):
        got = [(x["text_a"], x["text_b"]) for x in text_overlaps(t, 0.8, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == shared
    assert len(shared) >= 0.9 * len(want) > 27


def test_document_overlaps(spark):
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh ") for _ in range(600))
    data = [(100, long), (101, edited(r, long, 6)), (102, long), (200, long), (103, "other " + long[:100]), (300, None), (400, " "), (None, long), (104, None)]
    t = spark.createDataFrame([(*d, 5, "x") for d in data], "doc_id long, text string, side int, least string")
    out = document_overlaps(t, spark_col("doc_id") % 100 == 0)
    assert [(x["evaluation_id"], x["train_id"], x["evaluation_copies"], x["train_copies"]) for x in out.orderBy("train_id").collect()] == [(100, 101, 2, 1), (100, 102, 2, 1)]
    assert out.orderBy("train_id").collect()[1]["coverage"] == 1.0
    assert document_overlaps(t.where("false"), spark_col("doc_id") % 100 == 0).collect() == []


def test_overlaps_are_counted_as_if_listed(spark):
    """Few digests and hashes among many images, some delivered with several of them or in several splits, against the listed pairs."""
    r = random.Random(12)
    hashes = [f"{r.getrandbits(64):016x}" for _ in range(6)]
    hashes += [f"{int(h, 16) ^ 0b1011:016x}" for h in hashes[:4]] + [f"{int(hashes[0], 16) ^ 0x1F0000:016x}"]
    data = [(f"p{r.randrange(90):03}", r.choice(["m1", "m2", "m3", "M1 ", None, ""]), r.choice([*hashes, None, "bad"]), r.choice(["train", "train", "val", "test", None]), r.choice(["s", "t", None]), "") for _ in range(140)]
    data += [(f"hot{i:03}", f"d{i % 40}", hashes[0], "train" if i % 3 else "test", "hot", "") for i in range(200)]
    t = spark.createDataFrame(data, EXPORT)
    side = {}
    for p, _, _, s, _, _ in data:
        if s:
            side[p] = side.get(p, 0) | (1 if s == "train" else 2)
    want = {}
    for a, b, c in rows(cross_split_pairs(t)):
        for x, y in ((a, b), (b, a)):
            if side[x] & 2 and side[y] & 1:
                n, best = want.get(x, (0, 0.0))
                want[x] = (n + 1, max(best, c))
    got = {x["path"]: (x["partners"], x["coverage"]) for x in overlap_by_record(t).collect()}
    assert got == {p: want.get(p, (0, 0.0)) for p, k in side.items() if k & 2}
    assert overlap_by_record(t.where("false")).collect() == []
