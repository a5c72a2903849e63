"""Curation operators on the edge rows every stage must survive."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenset import config as conf
from lumenset.operators import audit, dedup, export, manifest, quality, sample, split
from lumenset.operators.components import components
from lumenset.operators.ranking import grouped_rank
from lumenset.plans import pipeline, queries
from lumenset.schema import normal_form

ROWS = "row_idx long, path string, dataset_source string, class_label string, width int, height int, aspect_ratio double, format string, file_size_bytes long, md5_hash string, sha256 string, quality_score double, phash string, quality_flag array<string>, blur_score double, split string, cluster_id string, export_path string"
NAMES = [x.split(" ")[0] for x in ROWS.split(", ")]


def table(spark, *rows):
    base = dict(dataset_source="s", class_label="real", width=300, height=300, aspect_ratio=1.0, format="PNG", file_size_bytes=10, quality_score=1.0, blur_score=100.0, quality_flag=[])
    return normal_form(spark.createDataFrame([tuple({"row_idx": i, "path": f"p{i}", **base, **r}.get(n) for n in NAMES) for i, r in enumerate(rows)], ROWS))


def ids(df):
    return sorted(r["row_idx"] for r in df.collect())


@pytest.mark.parametrize("flags,score", [([], 1.0), (["ok"], 1.0), (["low_resolution"], 0.7), (["blurry"], 0.6), (["aspect_ratio_extreme", "compressed"], 0.7), (["low_resolution", "compressed"], 0.6), (["corrupt"], 0.0), (["new"], 0.8)])
def test_quality_score(spark, flags, score):
    df = spark.createDataFrame([(flags,)], "f array<string>")
    got = df.select(quality.quality_score(F.col("f")).alias("s"), (quality.quality_score(F.col("f")) >= 0.7).alias("ok")).first()
    assert abs(got["s"] - score) < 1e-9 and got["ok"] == (score >= 0.7)


def test_validated(spark):
    t = table(spark, {}, dict(width=100), dict(blur_score=None), dict(height=0, aspect_ratio=None), dict(format="JPEG", file_size_bytes=5), dict(width=None), dict(blur_score=79.9, aspect_ratio=2.0))
    rules = conf.ImageRules(compression_heuristic=True)
    out = {r["row_idx"]: quality_text(r) for r in quality.validated(t, rules).collect()}
    assert out == {0: "ok", 1: "low_resolution", 2: "opencv_read_failed", 3: "low_resolution|aspect_ratio_extreme", 4: "compressed", 5: "low_resolution", 6: "blurry"}
    broken = quality.validated(t, rules, F.col("row_idx") < 2).where("row_idx < 2").collect()
    assert all(r["quality_flag"] == ["corrupt"] and r["quality_score"] == 0 for r in broken)
    assert quality.filter_counts(table(spark, dict(quality_score=None), dict(quality_score=float("nan")), {}), 0.5).first() == (1, 2)


def quality_text(r):
    return "|".join(r["quality_flag"]) or "ok"


def test_counts_by_group(spark):
    t = table(spark, dict(quality_flag=["blurry"]), {}, dict(class_label=None, quality_flag=["odd", "blurry"]))
    got = {(r["level"], r["name"]): (r["total"], r["flagged"]) for r in quality.quality_by_group(t).collect()}
    assert got == {("all", None): (3, 2), ("class", "real"): (2, 1), ("class", None): (1, 1), ("source", "s"): (3, 2)}
    freq = {r["flag"]: r["n"] for r in quality.flag_frequency(t).collect()}
    assert freq["blurry"] == 2 and freq["odd"] == 1 and freq["corrupt"] == 0


def test_exact_dedup(spark):
    t = table(spark, dict(md5_hash="A", path="z"), dict(md5_hash="a ", path="b"), dict(md5_hash=""), dict(md5_hash=None), dict(md5_hash="c", width=100, height=100), dict(md5_hash="c", width=50, height=200, file_size_bytes=20, class_label="fake"), dict(md5_hash="c", quality_score=None))
    assert ids(dedup.exact_kept(t)) == [1, 2, 3, 5]
    assert ids(dedup.exact_removed(t)) == [0, 4, 6]
    c = dedup.conflicts(t).collect()
    assert sorted(r["row_idx"] for r in c) == [4, 6] and {r["winner_resolution"] for r in c} == {"50x200"} and {r["conflict_labels"] for r in c} == {"fake|real"}
    again = dedup.exact_kept(dedup.exact_kept(t))
    assert ids(again) == [1, 2, 3, 5]
    assert ids(dedup.exact_kept(t.where("false"))) == []


def test_hamming(spark):
    df = spark.createDataFrame([("ff00ff00ff00ff0f", "FF00ff00ff00ff00"), ("", "0" * 16), ("xyz", "0" * 16), (None, "0" * 16)], "a string, b string")
    assert [r[0] for r in df.select(dedup.hamming(F.col("a"), F.col("b"))).collect()] == [4, 999, 999, 999]


def test_near_clusters_are_transitive_within_buckets(spark):
    base = "abcdabcdabcd"
    t = table(spark, dict(phash=base + "0000"), dict(phash=base + "00ff"), dict(phash=base + "ffff"), dict(phash="bbcdabcdabcd0000"), dict(phash=None), dict(phash="abc"), dict(phash=base + "0000", quality_score=0.1), dict(phash=base + "zz00"))
    got = {r["row_idx"]: r["cluster_key"] for r in dedup.near_clusters(t).collect()}
    assert got[0] == got[1] == got[2] == got[6] == base + "0000" and got[3] != got[0] and got[4] is None and got[5] is None and got[7] == base + "zz00"
    assert ids(dedup.near_kept(t)) == [0, 3, 4, 5, 7]
    single = dedup.near_clusters(t, singles=True)
    assert {r["cluster_key"] for r in single.where("row_idx in (4, 5)").collect()} == {"path:p4", "path:p5"}
    stats = dedup.cluster_stats(single).first()
    assert (stats["clusters"], stats["largest"]) == (5, 4)
    numbers = {r["row_idx"]: r["cluster_id"] for r in dedup.numbered_clusters(single).collect()}
    assert numbers[0] == numbers[6] == "cluster_00000" and sorted(set(numbers.values())) == [f"cluster_{i:05}" for i in range(5)]


def test_large_buckets_are_searched_by_blocks(spark):
    import random

    r = random.Random(4)
    base = [r.getrandbits(48) | 0xABCD << 48 for _ in range(60)]
    h = {*base, *[b ^ sum(1 << i for i in r.sample(range(48), r.randrange(1, 11))) for b in base for _ in range(3)], 5, 6}
    t = spark.createDataFrame([(f"{x:016x}",) for x in h] * 2, "phash string")
    want = {(f"{min(a, b):016x}", f"{max(a, b):016x}") for a in h for b in h if a != b and a >> 48 == b >> 48 and (a ^ b).bit_count() <= 8}
    for most in (1, 4096):
        got = [(x["h1"], x["h2"]) for x in dedup.bucket_pairs(t, 4, 8, most_joined=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert dedup.bucket_pairs(t.where("false"), 4, 8, most_joined=1).collect() == []


def test_percentiles_count_equal_values_once(spark):
    import random

    r = random.Random(2)
    values = [float(r.choice([0.1, 0.5, 0.5, 0.9, r.random()])) for _ in range(997)]
    got = audit.index_percentiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v").first()
    assert got["n"] == 997 and all(got[f"p{p}"] == sorted(values)[min(997 * p // 100, 996)] for p in (10, 25, 50, 75, 90, 99))


def test_conflicts_of_near_copies(spark):
    a, b = "abcdabcdabcd0000", "abcdabcdabcd000f"
    t = table(spark, dict(md5_hash="m", phash=a), dict(md5_hash="m", class_label="fake", phash=a), dict(md5_hash="n", class_label="fake", phash=b, quality_score=0.5), dict(md5_hash="o", phash="hash_error"), dict(md5_hash="q", class_label="fake", phash="hash_error"))
    got = {(r["row_idx"], r["conflict_type"]): r for r in dedup.all_conflicts(t, 4).collect()}
    assert set(got) == {(1, "exact"), (2, "near")}
    near = got[2, "near"]
    assert (near["conflict_hash"], near["conflict_paths"], near["conflict_labels"], near["winner_path"]) == (b, "p0|p2", "fake|real", "p0")
    assert dedup.dedup_summary(t, 4).first()["cross_class"] == 2


def test_markers_are_no_near_copies(spark):
    t = table(spark, *[dict(phash="hash_error", md5_hash=f"m{i}") for i in range(3)], dict(phash="12345678"), dict(phash="12345678"), dict(phash="ab" * 8), dict(phash="ab" * 8))
    assert ids(dedup.near_kept(t, 4)) == [0, 1, 2, 3, 5]
    got = {r["row_idx"]: r["cluster_key"] for r in dedup.near_clusters(t, 4, singles=True).collect()}
    assert [got[i] for i in range(3)] == ["path:p0", "path:p1", "path:p2"] and got[3] == got[4] == "12345678" and got[5] == got[6]
    summary = dedup.dedup_summary(t, 4).first()
    assert (summary["kept"], summary["near_removed"]) == (5, 2)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(9, i) for i in range(20)] + [(100, 101), (None, 3)]])
def test_components(spark, edges):
    up = {}
    for a, b in edges:
        if a is not None and a != b:
            for x in (a, b):
                up.setdefault(x, x)
    change = True
    while change:
        change = False
        for a, b in edges:
            if a in up and b in up and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                change = True
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == up


def test_grouped_rank_in_hot_and_null_groups(spark):
    r = random.Random(1)
    data = [(r.choice(["hot"] * 8 + [None, "b"]), r.randrange(50), i, "part") for i in range(800)]
    df = spark.createDataFrame(data, "g string, v int, i int, part string")
    got = {x["i"]: x["n"] for x in grouped_rank(df, ["g"], [F.col("v").desc(), F.col("i")], "n", partitions=7).collect()}
    for g in ("hot", None, "b"):
        want = sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2]))
        assert [got[x[2]] for x in want] == list(range(1, len(want) + 1))
    assert grouped_rank(df.where("false"), ["g"], [F.col("i")], "n").collect() == []
    assert sorted(x["n"] for x in grouped_rank(df, [], [F.col("i")], "n").collect()) == list(range(1, 801))


def test_class_sample_refills_soft_caps(spark):
    rows = [dict(dataset_source="big", quality_score=1.0 - i / 100) for i in range(10)] + [dict(dataset_source="small", quality_score=0.1)] * 2 + [dict(class_label="other"), dict(class_label=None)]
    t = table(spark, *rows)
    assert ids(sample.class_sample(t, {"real": 6}, 0.5)) == [0, 1, 2, 3, 10, 11]
    assert ids(sample.class_sample(t, {"real": 4}, 0)) == [0, 1, 2, 3]
    assert ids(sample.class_sample(t, {})) == []
    assert len(sample.global_cap(t, 5).collect()) == 5 and sample.global_cap(t, None) is t
    assert ids(sample.arrival_quota(t, "class_label", "row_idx", 3, 4)) == [0, 1, 2, 12]
    assert ids(sample.limit_resume(t, 9, 12, "row_idx")) == [0, 1, 2] and ids(sample.limit_resume(t, 9, 3, "row_idx")) == []


@pytest.mark.parametrize("total,n,want", [(10, 4, [0, 2, 5, 7]), (3, 20, [0, 1, 2]), (0, 4, []), (5, 0, [])])
def test_even_indices(spark, total, n, want):
    assert spark.range(1).select(sample.even_indices(F.lit(total), n)).first()[0] == want


def test_greedy_modes():
    clusters = [(f"c{i:05}", 1, {"a": 1}, {"s": 1}) for i in range(4000)]
    share = lambda out, s: sum(v == s for v in out.values()) / len(out)
    compat = split.greedy_assign(clusters, {"train": 0.7, "val": 0.15, "test": 0.15}, mode="compat")
    assert abs(share(compat, "train") - 0.4005) < 0.001 and abs(share(compat, "val") - 0.29975) < 0.001
    old = split.greedy_assign(clusters, {"train": 0.8, "val": 0.1, "test": 0.1}, mode="compat")
    assert abs(share(old, "train") - 0.6005) < 0.001
    delta = split.greedy_assign(clusters, {"train": 0.7, "val": 0.15, "test": 0.15})
    assert abs(share(delta, "train") - 0.7) < 0.01


def test_splits_keep_clusters(spark):
    t = table(spark, *[dict(phash=f"{i // 3:016x}", class_label=random.Random(i).choice(["a", "b"])) for i in range(60)])
    out = split.greedy_split(dedup.near_clusters(t, singles=True, threshold=0), {"train": 0.5, "test": 0.5})
    assert split.leaking_clusters(out, "cluster_key").collect() == [] and out.count() == 60
    report = {r["split"]: r for r in split.split_report(out.withColumn("cluster_id", F.col("cluster_key"))).collect()}
    assert sum(r["images"] for r in report.values()) == 60 and sum(sum(r["classes"].values()) for r in report.values()) == 60
    with pytest.raises(ValueError):
        split.greedy_split(out.drop("split"), {"train": 1.0}, max_clusters=3)


def plain_greedy(clusters, ratios, seed, mode):
    """The rule word by word: each cluster in seeded order to the split of least distance, or of least growth of it."""
    whole = [sum((c[p] for c in clusters.values()), Counter()) for p in range(3)]
    held = {s: [Counter(), Counter(), Counter()] for s in ratios}
    miss = lambda s, add: sum(abs(held[s][p][x] + add[p][x] - ratios[s] * n) / (ratios[s] * n + 1e-9) for p in range(3) for x, n in whole[p].items())
    order, none, out = sorted(clusters), [Counter()] * 3, {}
    random.Random(seed).shuffle(order)
    for key in order:
        cost = {s: miss(s, clusters[key]) - (miss(s, none) if mode == "delta" else 0) for s in ratios}
        out[key] = min(sorted(ratios), key=lambda s: round(cost[s], 9))
        for p in range(3):
            held[out[key]][p].update(clusters[key][p])
    return out


@pytest.mark.parametrize("mode", ["delta", "compat"])
def test_greedy_split_is_the_plain_rule(spark, monkeypatch, mode):
    monkeypatch.setattr(split, "CHUNK", 7)  # places of many chunks, the last one not full
    r = random.Random(3)
    rows = [(f"{'kKé'[r.randrange(3)]}{r.randrange(60)}", r.choice(["a", "b", None]), r.choice("uvwxyz"), "old") for _ in range(150)]
    clusters = defaultdict(lambda: [Counter(), Counter(), Counter()])
    for key, label, source, _ in rows:
        for p, x in enumerate(("", label or "", source)):
            clusters[key][p][x] += 1
    ratios = {"train": 0.53, "val": 0.29, "test": 0.18}
    got = split.greedy_split(spark.createDataFrame(rows, "cluster_key string, class_label string, dataset_source string, split string"), ratios, seed=5, mode=mode).collect()
    assert len(got) == 150 and {(x["cluster_key"], x["split"]) for x in got} == set(plain_greedy(clusters, ratios, 5, mode).items())


def test_greedy_split_of_no_rows_and_no_keys(spark):
    bare = spark.createDataFrame([(None, "a", "s"), ("k", "a", "s")], "cluster_key string, class_label string, dataset_source string")
    assert split.greedy_split(bare.where("false"), {"train": 1.0}).collect() == []
    with pytest.raises(ValueError):
        split.greedy_split(bare, {"train": 1.0})


def test_greedy_split_of_more_than_a_million_clusters(spark):
    label = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int"))
    rows = spark.range(1_000_001).select(F.format_string("k%d", "id").alias("cluster_key"), label.alias("class_label"), F.lit("s").alias("dataset_source"))
    ratios = {"train": 0.7, "val": 0.15, "test": 0.15}
    n = {r["split"]: r["n"] for r in split.greedy_split(rows, ratios).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(n.values()) == 1_000_001 and all(abs(n[s] / 1_000_001 - r) < 0.001 for s, r in ratios.items())


def test_greedy_split_facts_of_more_than_a_million_clusters(spark, tmp_path):
    few = lambda n: F.concat(F.lit("s"), F.col("id") % n)
    rows = spark.range(1_000_005).select(F.col("id").alias("row_idx"), F.format_string("p%d", "id").alias("path"), few(5).alias("dataset_source"), few(3).alias("class_label"), F.when(F.col("id") < 4, "ab" * 8).alias("phash"))
    rows.write.parquet(f"{tmp_path}/deduped_index.parquet")
    facts = queries.greedy_split_facts(spark, str(tmp_path)).first().asDict()
    assert facts == {"images": 1_000_005, "splits": 3, "clusters": 1_000_002, "divided": 0, "far_splits": 0, "far_classes": 0}


def test_pipeline_balances_splits(spark):
    rows = [dict(phash="ab" * 8, class_label="fake")] * 10 + [dict(class_label="rare")] * 4 + [dict(class_label="real")] * 26
    c = conf.Config(split_ratios={"train": 0.5, "val": 0.25, "test": 0.25})
    placed = pipeline.divide(table(spark, *[{**r, "path": f"p{i:02}"} for i, r in enumerate(rows)]), c).collect()
    n = lambda s, k=None: sum(r["split"] == s and k in (None, r["class_label"]) for r in placed)
    assert all(abs(n(s) - 40 * r) <= 3 for s, r in c.split_ratios.items()), [n(s) for s in c.split_ratios]
    assert [n(s, "rare") for s in ("train", "val", "test")] == [2, 1, 1]
    assert len({r["split"] for r in placed if r["class_label"] == "fake"}) == 1


def test_export(spark):
    t = table(spark, dict(path="a/x.jpg", split="train"), dict(path="b/x.jpg", split="train"), dict(path="c/x", split="val"), dict(path="d/x", split="val"), dict(path="e/x.jpg", split=None, class_label=None))
    got = {r["row_idx"]: r["destination"] for r in export.with_destination(t).collect()}
    assert got == {0: "export/train/real/x.jpg", 1: "export/train/real/x_1.jpg", 2: "export/val/real/x", 3: "export/val/real/x_1", 4: "export/none/unknown/x.jpg"}
    q = table(spark, *[dict(split="train", quality_score=s) for s in (0.2, 0.9, 0.5)])
    assert ids(export.capped(q, 1)) == [1] and ids(export.capped(q, 1, compat=True)) == [0] and ids(export.capped(q, None)) == [0, 1, 2]
    plan = export.copy_plan(t, spark.createDataFrame([("a/x.jpg",), ("q/x",)], "file string"), "out")
    assert {r["path"]: r["source"] for r in plan.collect()} == {"a/x.jpg": "a/x.jpg", "b/x.jpg": "a/x.jpg", "c/x": "q/x", "d/x": "q/x", "e/x.jpg": "a/x.jpg"}
    rates = {r["split"]: (r["planned"], r["missed"]) for r in export.copy_rates(t, t.where("row_idx < 3")).collect()}
    assert rates == {"train": (2, 0), "val": (2, 1), None: (1, 1)}


def test_merge_and_patch(spark):
    old = table(spark, dict(md5_hash="a", sha256="1"), dict(), dict())
    new = table(spark, dict(md5_hash="a", sha256="1"), dict(md5_hash="a", sha256="2"), dict())
    got = sorted((r["origin"], r["row_idx"]) for r in manifest.merged(old, new).collect())
    assert got == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2)]
    assert sorted((r["origin"], r["row_idx"]) for r in manifest.merged(old, new, blank_is_key=True).collect()) == [(0, 0), (0, 1), (1, 1)]
    t = table(spark, dict(export_path="e/a.jpg", quality_flag=["low_resolution", "blurry"]), dict(export_path=None))
    changes = spark.createDataFrame([("e/a.jpg", "u/a.png", 600, 600), (None, "x", 1, 1)], "old string, new string, new_width int, new_height int")
    r = {x["row_idx"]: x for x in manifest.patched(t, changes).collect()}
    assert (r[0]["export_path"], r[0]["width"], r[0]["quality_flag"]) == ("u/a.png", 600, ["blurry"]) and r[1]["width"] == 300


def test_merged_folders(spark):
    a, b = table(spark, dict(md5_hash="m", sha256="s"), dict(md5_hash=None, sha256=None), dict(md5_hash="n", sha256=None)), table(spark, dict(md5_hash="m", sha256="s"), dict(md5_hash="o", sha256="s"), dict(md5_hash="o", sha256="s"))
    c = b.withColumn("extra", b["row_idx"])
    out = manifest.merged_folders([{"sampled": a, "export": b}, {"sampled": c}])
    got = {k: sorted((r["folder"], r["row_idx"]) for r in df.collect()) for k, df in out.items()}
    first = b.agg({"row_idx": "min"}).first()[0]
    # What was sampled in the first folder comes first, so its export keeps "o" alone, once, and the second folder nothing.
    assert got["sampled"] == sorted((0, r["row_idx"]) for r in a.collect()) and got["export"] == [(0, first + 1)]
    assert "extra" in out["sampled"].columns and len(manifest.merged_folders([{"export": a}, {"export": a}], blank_is_key=True)["export"].collect()) == 3
    assert manifest.merged_folders([]) == {} and manifest.merged_folders([{"export": a.where("false")}])["export"].collect() == []


def test_manifest_helpers(spark):
    df = spark.createDataFrame([('[["000","003"]]', "src"), ("broken", "other")], "j string, dataset_source string")
    assert [r[0] for r in df.select(manifest.pair_names(F.col("j"))).collect()] == [["000_003", "003_000"], None]
    assert [r["class_label"] for r in manifest.with_labels(df, {"src": "real"}).collect()] == ["real", "unknown"]
    assert [r["class_label"] for r in manifest.with_labels(df, None).collect()] == ["src", "other"]
    assert manifest.missing_columns(df, ("j", "x")) == ["x"]
    for bad in (("x",), ("j",)):
        with pytest.raises(ValueError):
            manifest.check_artifact(df.where("false"), bad)


def test_audit_percentiles_and_histogram(spark):
    t = table(spark, *[dict(quality_score=float(x)) for x in (1, 2, 3, 4)], dict(quality_score=None))
    r = audit.quality_stats(t).first()
    assert (r["p50"], r["p10"], r["n"]) == (3.0, 1.0, 4)
    h = {r["bin"]: r["n"] for r in audit.histogram(table(spark, *[dict(quality_score=x) for x in (0.7, 1.0, 0.5, 1.5, None)]), "quality_score").collect()}
    assert h == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    assert audit.quality_stats(t.where("false")).first()["n"] == 0


def test_leakage(spark):
    t = table(spark, dict(md5_hash="m", split="train"), dict(md5_hash="m", split="val"), dict(md5_hash="m", split="val"), dict(md5_hash="n", split="test"), dict(md5_hash="n", split=None))
    assert {r["pair"]: r["n"] for r in audit.leakage_pairs(t).collect()} == {"train|val": 2}
    assert {r["kind"]: r["keys"] for r in audit.leakage(t).collect()}["hash"] == 1
    assert audit.leakage_pairs(t.where("false")).collect() == []


def verdict(df, **k):
    return audit.verdict(df, conf.Config(**k)).first()["verdict"]


def test_verdict_table(spark):
    good = [dict(md5_hash=f"h{i}", sha256=f"s{i}", split=s, export_path=f"e/{i}") for i, s in enumerate(["train"] * 8 + ["val", "test"])]
    assert verdict(table(spark, *good)) == "PASS"
    assert verdict(table(spark, *good).where("false")) == "FAIL"
    assert verdict(table(spark, *good, dict(path=None))) == "FAIL" and verdict(table(spark, *good, dict(path=None)), max_malformed_pct=50.0) == "WARN"
    leak = [*good, dict(md5_hash="h0", sha256="t", split="val", export_path="e/99")]
    assert verdict(table(spark, *leak)) == "FAIL" and verdict(table(spark, *leak), max_leakage_allowed=1) == "WARN"
    assert verdict(table(spark, *good[:-1], {**good[-1], "export_path": "e/0"})) == "WARN"
    assert verdict(table(spark, *good[:-1], {**good[-1], "width": 0})) == "WARN"
    low = [{**g, "quality_score": 0.1} for g in good]
    assert verdict(table(spark, *low), min_quality_score=0.5) == "WARN" and verdict(table(spark, *low)) == "PASS"
    assert audit.verdict(table(spark, *good), conf.Config(), missing=5).first()["verdict"] == "FAIL"
    assert len(audit.first_anomalies(audit.anomalies(table(spark, *[dict(split="bad")] * 30)), 7).collect()) == 7


def test_verdict_counts_leaked_keys(spark):
    good = [dict(md5_hash=f"h{i}", sha256=f"s{i}", split=s, export_path=f"e/{i}") for i, s in enumerate(["train"] * 8 + ["val", "test"])]
    leak = [*good, *[dict(md5_hash=f"h{i}", sha256=f"t{i}", split="val", export_path=f"e/9{i}") for i in range(5)]]
    assert verdict(table(spark, *leak), max_leakage_allowed=4) == "FAIL" and verdict(table(spark, *leak), max_leakage_allowed=5) == "WARN"
    facts = audit.verdict(table(spark, *leak), conf.Config()).first()
    assert (facts["leaked"], facts["warnings"]) == (5, 1)
    name = [{**g, "path": f"d{i}/same.png" if i > 7 else f"d{i}/n{i}.png"} for i, g in enumerate(good)]
    assert verdict(table(spark, *name)) == "WARN"
    low = [{**g, "quality_score": 0.1} for g in good]
    assert verdict(table(spark, *low), min_quality_score=0.5) == "WARN" and verdict(table(spark, *low)) == "PASS"
    assert verdict(table(spark, *good)) == "PASS" and audit.verdict(table(spark, *good), conf.Config(), missing=5).first()["verdict"] == "FAIL"


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"source_dirs": ["a"], "artifacts_dir": "x", "export_root": "y", "image_rules": {"min_width": 5, "target_resolution": 9}, "split_ratios": {"train": 1.0}, "other": 1}')
    c = conf.load_config(str(p))
    assert c.image_rules.min_width == 5 and c.phash_bucket_chars == 12 and c.source_dirs == ("a",)
    p.write_text('{"source_dirs": []}')
    with pytest.raises(ValueError):
        conf.load_config(str(p))
    assert conf.redacted({"a": 1, "api_key": 2, "n": {"Token": 3, "b": 4}}) == {"a": 1, "n": {"b": 4}}
    assert conf.choose(None, 0, 5) == 0
