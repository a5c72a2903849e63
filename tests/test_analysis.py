"""Evaluation, epoch logs, kernels, drift and files."""

from __future__ import annotations

import json
import os
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenset.config import Config, ImageRules
from lumenset.functions import images, kernels
from lumenset.operators import drift, epochs, evaluation
from lumenset.plans import pipeline
from lumenset.sources import archives, files, sinks, tables
from lumenset.sources.headers import read_header

#: Published confusion matrices and what follows from them.
MATRICES = {
    "a": ([[6040, 503, 1252], [460, 7227, 105], [1493, 169, 6092]], 0.8294, (0.756, 0.775, 0.765)),
    "b": ([[6206, 296, 1293], [188, 7521, 83], [1124, 86, 6544]], 0.8685, (0.825, 0.796, 0.811)),
}


def test_reports_of_published_matrices(spark):
    cells = [(run, i, j, n) for run, (m, _, _) in MATRICES.items() for i, row in enumerate(m) for j, n in enumerate(row)]
    counts = spark.createDataFrame(cells, "run string, y_true int, y_pred int, n long")
    acc = {r["run"]: r["accuracy"] for r in evaluation.run_scores(counts).collect()}
    first = {r["run"]: r for r in evaluation.class_report(counts).where("label = 0").collect()}
    for run, (_, a, (p, r, f)) in MATRICES.items():
        assert abs(acc[run] - a) < 1e-4
        assert abs(first[run]["precision"] - p) < 1e-3 and abs(first[run]["recall"] - r) < 1e-3 and abs(first[run]["f1"] - f) < 1e-3
    small = evaluation.expand(counts.where("run = 'a'").withColumn("n", F.expr("n div 100").cast("long")))
    again = {(r["y_true"], r["y_pred"]): r["n"] for r in evaluation.cube(small).collect()}
    assert again[0, 0] == 60 and again[2, 1] == 1


def test_label_only_predicted(spark):
    p = spark.createDataFrame([("r", 1, 0, 0), ("r", 2, 0, 2), ("r", 3, None, 1)], "run string, sample_id long, y_true int, y_pred int")
    report = {r["label"]: r for r in evaluation.class_report(evaluation.cube(p)).collect()}
    assert report[2]["support"] == 0 and report[2]["f1"] == 0 and report[0]["recall"] == 0.5
    assert evaluation.cube(p.where("false")).count() == 0


def log(spark, values, run="r"):
    return spark.createDataFrame([(run, i + 1, float(v), 1.0) for i, v in enumerate(values)], "run string, epoch int, val_acc double, train_acc double")


def test_epochs(spark):
    t = log(spark, [0.1, 0.5, 0.5, 0.4, 0.3, 0.2, 0.45])
    assert tuple(epochs.best_epoch(t).first()) == ("r", 2, 0.5)
    assert tuple(epochs.early_stop(t, 3).first()) == ("r", 5, True) and tuple(epochs.early_stop(t, 7).first()) == ("r", 7, False)
    assert [r["improved"] for r in epochs.running_best(t).orderBy("epoch").collect()] == [True, True] + [False] * 5
    assert epochs.overfit_gap(t).first()["gap"] == 0.55
    board = epochs.leaderboard(spark.createDataFrame([("a", 0.5, 1), ("b", None, 2), ("c", 0.5, 3), ("d", 0.9, 4)], "run string, best_val_acc double, position int"))
    assert [r["shown"] for r in board.orderBy("rank").collect()] == ["*d", "a", "c", "b"]


@pytest.mark.parametrize("path,want", [("/x/run_20260307_063053/best.pth", "run_20260307_063053"), ("models/my_exp/best.pth", "my_exp"), ("models/best_resnet18.pth", "best_resnet18"), ("best.pth", "best")])
def test_run_folder(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(epochs.run_folder(F.col("p"))).first()[0] == want


def test_tables_of_runs(spark):
    log = spark.createDataFrame([("a", 1, 0.5, 0.6), ("a", 2, 0.7, 0.9), ("b", 1, 0.7, 0.7), ("c", 1, None, None)], "run string, epoch int, val_acc double, train_acc double")
    summary = spark.createDataFrame([("a", 0.8, None), ("x", 0.9, 3)], "run string, best_val_acc double, epochs_trained int")
    counts = spark.createDataFrame([("a", 0, 0, 3), ("a", 1, 0, 1), ("x", 0, 0, 1)], "run string, y_true int, y_pred int, n long")
    got = {r["run"]: r.asDict() for r in epochs.comparison(log, summary, counts).collect()}
    assert sorted(got) == ["a", "b", "c"] and [got[k]["rank"] for k in "abc"] == [1, 2, 3]
    assert (got["a"]["best_val_acc"], got["a"]["epochs_trained"], got["a"]["gap"], got["a"]["accuracy"]) == (0.8, 2, 0.2, 0.75) and got["b"]["accuracy"] is None
    assert epochs.comparison(log.where("false"), summary, counts).collect() == []
    bars = epochs.bars(spark.createDataFrame([("a", 0.5), ("b", None), ("c", 0.1), ("d", 0.1)], "run string, s double"), "s").orderBy("position").collect()
    assert [(r["run"], r["position"]) for r in bars] == [("c", 0), ("d", 1), ("a", 2)]
    sweep = epochs.sweep_table(spark.createDataFrame([("a", [1.5, 1.0], 0.4, 0), ("z", None, None, 1)], "run string, weights array<double>, best_val_acc double, position int"), counts).orderBy("rank").collect()
    assert [(r["shown"], r["weights"]) for r in sweep] == [("*a", "[1.5,1.0]"), ("z", "?")] and sweep[0]["f1_real"] == 0.857143 and sweep[1]["f1_macro"] is None


def test_planes_of_images(spark):
    r = np.random.default_rng(3)
    rgb = r.random((3, 8, 6)) * 255
    t = spark.createDataFrame([(rgb.ravel().tolist(), 8, 6), (None, 8, 6), ([1.0], 8, 6), (rgb.ravel().tolist(), None, 6)], "v array<double>, h int, w int")
    six = [x[0] for x in t.select(images.planes_function(images.srm_six_channels, 3)("v", "h", "w")).collect()]
    assert six[1] is six[2] is six[3] is None and np.allclose(np.reshape(six[0], (6, 8, 6))[:3], rgb) and np.allclose(np.reshape(six[0], (6, 8, 6))[3:], images.srm_residuals(rgb.mean(0)))
    w1, w2, k = r.random((2, 3)), r.random((3, 2)), r.random((2, 3, 3))
    got = t.limit(1).select(images.attention(w1, w2, k)("v", "h", "w")).first()[0]
    assert np.allclose(np.reshape(got, rgb.shape), images.attention_block(rgb, w1, w2, k))
    arr = lambda a: F.array(*[F.lit(float(x)) for x in np.ravel(a)])
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(kernels.jet(F.lit(0.5))) == [127.5, 255, 127.5] and one(kernels.jet(F.lit(1.0))) == [127.5, 0, 0]
    heat = r.random((3, 4))
    assert np.allclose(one(kernels.resize_bilinear(arr(heat), 3, 4, 3, 4)), heat.ravel()) and np.allclose(one(kernels.resize_bilinear(arr([[7.0]]), 1, 1, 2, 2)), 7)
    assert np.allclose(one(kernels.heat_overlay(arr(rgb), 8, 6, arr(heat), 3, 4, 0.0)), rgb.ravel())
    plane = r.random((16, 24)) * 255
    assert np.allclose(images.rotate(plane, 0), plane) and np.allclose(images.rotate(plane[:16, :16], 90), np.rot90(plane[:16, :16], -1)) != np.allclose(images.rotate(plane[:16, :16], 90), np.rot90(plane[:16, :16]))
    assert np.abs(images.compressed(plane, 100) - plane).max() < 3 and np.abs(images.compressed(plane, 20) - plane).mean() > np.abs(images.compressed(plane, 90) - plane).mean()
    assert np.allclose(images.blurred(np.full((5, 5), 9.0), 3), 9) and images.median_blurred(np.eye(5)).max() <= 1
    some = spark.createDataFrame([("p", plane.ravel().tolist(), 16, 24), ("q", None, 16, 24)], "path string, plane array<double>, h int, w int")
    shown = images.augmentation_preview(some, "strong", 12).collect()
    made = [x["plane"] for x in shown if x["path"] == "p"]
    assert len(shown) == 24 and len({tuple(m) for m in made}) > 6 and all(len(m) == plane.size and 0 <= min(m) and max(m) <= 255 for m in made)
    assert made == [x["plane"] for x in images.augmentation_preview(some, "strong", 12).collect() if x["path"] == "p"]


def test_logs_and_marks_of_scratch_tables(spark, tmp_path):
    from lumenset import scratch

    sinks.write_log(spark.createDataFrame([("real", 3), ("fake", 1)], "label string, n long"), str(tmp_path / "stats"))
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "stats")).collect()) == [("fake", "1"), ("real", "3")]
    kept = scratch.Scratch(spark, "kept").write(spark.range(3), "t")
    mark = scratch.made()
    gone = scratch.Scratch(spark, "gone")
    gone.write(spark.range(3), "t")
    scratch.clear_since(spark, mark)
    assert not tables.exists(spark, gone.root) and kept.count() == 3 and scratch.made() == mark


def test_predictions_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("a", 3, 1, 2), ("a", 1, 0, 0), ("b", 1, 2, 2), ("b", 2, None, 1), (None, 1, 1, 1)], "run string, sample_id long, y_true int, y_pred int")
    assert sorted(tuple(r) for r in sinks.write_predictions(p, str(tmp_path)).collect()) == [("a", 2), ("b", 1)]
    got = sorted(tuple(r) for r in tables.read_predictions(spark, str(tmp_path)).select("run", "sample_id", "y_true", "y_pred").collect())
    assert got == [("a", 0, 0, 0), ("a", 1, 1, 2), ("b", 0, 2, 2)]
    assert sinks.write_predictions(p.where("false"), str(tmp_path)).collect() == []


def test_schedules(spark):
    t = spark.range(60).select(F.col("id").alias("e"), epochs.cosine_restarts(F.col("id"), 1.0).alias("r")).orderBy("e").collect()
    for e, r in t:
        length, at = (20, e) if e < 20 else (40, e - 20)
        assert abs(r - 0.5 * (1 + np.cos(np.pi * at / length))) < 1e-9
    v = spark.createDataFrame([([1.0, 0.9, 0.9, 0.9, 0.9, 0.8, 0.8],)], "v array<double>")
    assert v.select(epochs.plateau_rates(F.col("v"), 1.0)).first()[0] == [1.0, 1.0, 1.0, 1.0, 0.5, 0.5, 0.5]


def test_array_kernels(spark):
    z = spark.createDataFrame([([1.0, 2.0, 0.5], 1)], "z array<double>, t int")
    one = lambda c: z.select(c).first()[0]
    e = np.exp(np.array([1.0, 2.0, 0.5]))
    ce = -np.log(e[1] / e.sum())
    assert np.allclose(one(kernels.softmax(F.col("z"))), e / e.sum()) and one(kernels.argmax(F.col("z"))) == 1
    assert abs(one(kernels.focal(F.col("z"), F.col("t"), 0.0)) - ce) < 1e-9 and abs(one(kernels.focal(F.col("z"), F.col("t"), 2.0)) - (1 - np.exp(-ce)) ** 2 * ce) < 1e-9
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert abs(one(kernels.gem_pool(arr(1, 1, 1, 1))) - 1) < 1e-9 and abs(one(kernels.gem_pool(arr(0, 0))) - 1e-6) < 1e-9
    assert one(kernels.minmax(arr(3, 3))) == [0, 0] and one(kernels.minmax(arr(1, 3, 2))) == [0, 1, 0.5]
    assert one(kernels.flip_rows(arr(1, 2, 3, 4), 2)) == [2, 1, 4, 3]
    assert np.allclose(one(kernels.brightness_predictor(F.lit(255.0))), [0.8, 0.12, 0.08])
    assert one(kernels.concat_channels([arr(1, 2)], 2)) == [1, 2, 0, 0] and one(kernels.concat_channels([arr(1, 2), arr(3, 4)], 1)) == [1, 2]
    maps, grads = np.arange(8.0).reshape(2, 4), np.array([[1.0] * 4, [-0.5] * 4])
    cam = np.maximum((maps * grads.mean(1)[:, None]).sum(0), 0)
    want = (cam - cam.min()) / (cam.max() - cam.min()) if cam.max() - cam.min() > 1e-8 else cam * 0
    got = one(kernels.class_activation(F.array(arr(*maps[0]), arr(*maps[1])), F.array(arr(*grads[0]), arr(*grads[1]))))
    assert np.allclose(got, want)


def test_image_kernels(spark):
    r = np.random.default_rng(0)
    p = r.random((9, 7)) * 255
    lap = np.zeros_like(p)
    q = np.pad(p, 1, mode="reflect")
    for i in range(9):
        for j in range(7):
            lap[i, j] = q[i, j + 1] + q[i + 2, j + 1] + q[i + 1, j] + q[i + 1, j + 2] - 4 * p[i, j]
    rows = [(p.ravel().tolist(), 9, 7), (None, 9, 7), ([1.0], 9, 7), ([], 0, 0)]
    df = spark.createDataFrame(rows, "v array<double>, h int, w int")
    out = df.select(images.blur_score("v", "h", "w").alias("b"), images.srm("v", "h", "w").alias("s"), images.spectrum("v", "h", "w").alias("f"), images.phash("v", "h", "w").alias("p")).collect()
    assert abs(out[0]["b"] - lap.var()) < 1e-6 and all(x["b"] is None and x["p"] is None for x in out[1:])
    s = np.array(out[0]["s"]).reshape(3, 9, 7)
    centre = np.clip((2 * p[4, 3] - p[4, 2] - p[4, 4]) / 2, -2, 2)
    assert abs(s[1, 4, 3] - centre) < 1e-9 and np.abs(s).max() <= 2
    m = np.log(np.abs(np.fft.fftshift(np.fft.fft2(p))) + 1e-8)
    assert np.allclose(np.array(out[0]["f"]), ((m - m.min()) / (m.max() - m.min() + 1e-8)).ravel())
    big = np.kron(r.random((8, 8)), np.ones((16, 16))) * 255
    a, b = images.perceptual_hash(big), images.perceptual_hash(big + r.normal(0, 1, big.shape))
    assert (int(a, 16) ^ int(b, 16)).bit_count() <= 4 and len(a) == 16
    assert np.allclose(images.lanczos_resize(np.full((10, 10), 5.0), 4, 7), 5.0)
    x = r.random((4, 5, 5))
    w1, w2, k = r.random((2, 4)), r.random((4, 2)), r.random((2, 3, 3))
    assert images.attention_block(x, w1, w2, k).shape == x.shape and (images.channel_attention(x, w1, w2) < x).all()
    with pytest.raises(ValueError):
        images.spatial_attention(x, r.random((2, 5, 5)))
    w = r.random((2, 3, 1, 1))
    assert np.allclose(images.expand_first_layer(w, 6)[:, 3:], 0.1 * np.repeat(w[:, :1], 3, 1))
    with pytest.raises(ValueError):
        images.augmented("none")
    aug = df.limit(1).select(images.augmented("strong")("v", "h", "w", F.lit("k")).alias("a"))
    assert aug.first() == aug.first() and len(aug.first()["a"]) == 63


def summaries(*configs):
    return [(i + 1, "s", i // 2, json.dumps({"config": c}) if not isinstance(c, str) else c, "x", 1) for i, c in enumerate(configs)]


FILES = "file_id long, series string, run_no int, summary_json string, leaves string, nth int"


def test_drift(spark):
    t = spark.createDataFrame(
        [
            *summaries({"attention_head": "gem", "use_fft": True, "backbone": "resnet18", "attention_dropout": 0.1}, {"attentionHead": "gem", "use_fft": "on", "net": {"backbone": "resnet18", "pretrained": 1}, "attention_dropout": 0.1}, '{"config": {"use', {"attn_head": ["gem"], "backbone": None, "enable_fft": 1, "seed": 3}, {"head": {"attention": "none", "version": 2}, "preprocessing": {"fft": False}, "arch": "resnet18"}),
            (90, "t", None, "[]", None, None), (91, "t", 1, '{"config": 7}', None, None), (92, None, 1, '{"config": {"use_fft": NaN}}', None, None), (93, None, 2, None, None, None), (94, "t", 2, '{"config": {"backbone": {}}}', None, None), (94, "t", 2, '{"config": {"backbone": {}}}', None, None),
        ],
        FILES,
    )
    table, changes, _ = drift.drift(t)
    got = sorted(tuple(r) for r in changes.where("file_id < 10").collect())
    assert got == [
        (2, "attention_head", "renamed"), (2, "backbone", "renamed"), (2, "use_fft", "retyped"), (4, "attention_head", "renamed"), (4, "attention_head", "retyped"), (4, "backbone", "removed"), (4, "use_fft", "renamed"), (4, "use_fft", "retyped"),
        (5, "attention_head", "renamed"), (5, "attention_head", "retyped"), (5, "backbone", "added"), (5, "use_fft", "renamed"), (5, "use_fft", "retyped"),
    ]
    one = {r["file_id"]: r for r in table.collect()}
    assert sorted(one) == [1, 2, 4, 5, 90, 91, 94] and one[4]["attention_head"] == "gem" and one[2]["use_fft"] is True and one[5]["use_fft"] is False and one[90]["backbone"] is None
    table, changes, matches = drift.drift(t.where("false"))
    assert table.collect() == [] and changes.collect() == [] and all(m == [] for m in matches.values())
    assert drift.name_words("useFFT") == ["use", "fft"] and drift.name_words("attn_head") == ["attention", "head"]


PLACES = {"attention_head": ["attention_head", "attn_head", "attention"], "use_fft": ["use_fft", "enable_fft", "fft"], "backbone": ["backbone", "backbone_name", "arch", "network"]}
UNSEEN = {"attention_head": ["pooling_block", "focus", "neck.kind", "refiner"], "use_fft": ["spectral", "freq_branch", "input.frequency", "dct"], "backbone": ["encoder", "model_family", "trunk.kind", "feature_net"]}


def drifting(places, n, seed):
    """Files in which the three fields stand at one place each, beside fields that share words, types or values with them."""
    import random

    r = random.Random(seed)
    for i in range(n):
        leaves = [("optimizer", "string", r.choice(["adam", "sgd"])), ("use_srm", "boolean", r.choice(["true", "false"])), ("epochs", "number", r.choice(["20", "30"])), ("seed", "number", str(r.randrange(1, 100)))]
        leaves += [x for x in (("backbone_lr", "number", "1e-05"), ("freeze_backbone", "boolean", "true"), ("fft_size", "number", "224"), ("attention_dropout", "number", "0.1"), ("augment", "string", "light")) if r.random() < 0.4]
        for t, paths in places.items():
            if r.random() < 0.8:
                kind, v = {"attention_head": ("string", ["none", "none", "se", "gem", "cbam"]), "use_fft": r.choice([("boolean", ["true", "false", "false"]), ("number", ["0", "1"]), ("string", ["on", "off", "no"])]), "backbone": ("string", ["resnet18", "swin_tiny", "convnext_small"])}[t]
                leaves.append((paths[i // 50 % len(paths)], kind, r.choice(v)))
        yield [{"path": p, "kind": k, "value": v} for p, k, v in leaves]


def found_places(spark, files):
    t = spark.createDataFrame([(i, "s", i, x) for i, x in enumerate(files)], "file_id long, series string, run_no int, leaves array<struct<path:string,kind:string,value:string>>")
    return {k: {p for p, _ in v} for k, v in drift.learn_matches(t).items()}


def test_drift_finds_names_it_has_never_seen(spark):
    """Held-out series name the fields without any word of the targets; recall over all these names must be 0.9 or more, with nothing else taken."""
    found = found_places(spark, [*drifting(PLACES, 1000, 1), *drifting(UNSEEN, 400, 2)])
    for t in PLACES:
        assert found[t] <= {*PLACES[t], *UNSEEN[t]} and found[t] >= set(PLACES[t]), t
    hits = sum(len(found[t] & set(UNSEEN[t])) for t in UNSEEN)
    assert hits >= 0.9 * sum(map(len, UNSEEN.values()))


def test_flooding_finds_what_names_do_not():
    """``arch`` is like no word of ``backbone``; without the rounds that carry its values' likeness to it, it is lost."""
    fields = {"backbone": {"string"}, "arch": {"string"}, "optimizer": {"string"}, "use_fft": {"boolean"}, "attention_head": {"string"}}
    overlap = {("backbone", "backbone"): 1.0, ("arch", "backbone"): 0.9, ("use_fft", "use_fft"): 1.0, ("attention_head", "attention_head"): 1.0}
    least = lambda rounds: {p for p, r in drift.field_scores(fields, overlap, drift.TRAINING_FIELDS, rounds).items() if r.get("backbone", 0) >= 0.2}
    assert least(200) == {"backbone", "arch"} and least(0) == {"backbone"}


def png(path, plane):
    h, w = plane.shape[:2]
    raw = b"".join(b"\0" + plane[i].astype(np.uint8).tobytes() for i in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return data


def picture(seed, size=300):
    r = np.random.default_rng(seed)
    return np.clip(np.kron(r.random((15, 15, 3)), np.ones((20, 20, 1)))[:size, :size] * 200 + r.integers(0, 55, (size, size, 3)), 0, 255)


def test_pipeline_end_to_end(spark, tmp_path):
    root = str(tmp_path)
    for i in range(8):
        data = png(f"{root}/data/{'real' if i % 2 else 'fake'}/img{i}.png", picture(i))
    with open(f"{root}/data/real/copy.PNG", "wb") as f:
        f.write(data)
    png(f"{root}/data/real/tiny.png", picture(50, 20))
    for name, content in (("broken.png", b"\x89PNG\r\n"), ("empty.jpg", b""), ("note.txt", b"x")):
        with open(f"{root}/data/fake/{name}", "wb") as f:
            f.write(content)
    c = Config(source_dirs=("data/real", "data/fake"), class_map={"data/real": "real", "data/fake": "ai_generated"}, project_root=root, export_root=f"{root}/out", image_rules=ImageRules(min_width=100, min_height=100), min_quality_score=0.8, class_targets={"real": 9, "ai_generated": 9}, split_ratios={"train": 0.5, "val": 0.25, "test": 0.25}, random_seed=3)
    report = pipeline.run(spark, c, f"{root}/artifacts")
    index = spark.read.parquet(f"{root}/artifacts/index")
    assert index.count() == 10 and {r["width"] for r in index.collect()} == {300, 20}
    export = spark.read.parquet(f"{root}/artifacts/export").collect()
    assert len(export) == 8 and all(os.path.exists(r["export_path"]) for r in export)
    assert report["verdict"] in ("PASS", "WARN") and report["summary"]["leaked"] == 0
    made = os.path.getmtime(f"{root}/artifacts/index/_SUCCESS")
    assert pipeline.run(spark, c, f"{root}/artifacts")["verdict"] == report["verdict"] and os.path.getmtime(f"{root}/artifacts/index/_SUCCESS") == made
    assert "stages" in pipeline.run(spark, c, f"{root}/dry", dry_run=True) and not os.path.exists(f"{root}/dry")
    assert json.load(open(f"{root}/artifacts/manifest.json"))["image_counts_per_split"]
    health = {r["export_path"].rsplit("/", 1)[-1]: r["state"] for r in files.file_health(spark.createDataFrame([(f"{root}/data/fake/empty.jpg",), ("gone.png",), (f"{root}/data/fake/note.txt",)], "export_path string"), files.listing(spark, f"{root}/data")).collect()}
    assert health == {"empty.jpg": "zero_byte", "gone.png": "missing"}
    assert [r["reason"] for r in files.unreadable(spark, f"{root}/data").collect()] == ["unreadable"]
    labels = {r["label_name"]: r["label"] for r in files.class_folders(spark, f"{root}/data").collect()}
    assert labels == {"fake": 0, "real": 1}
    px = files.pixels(spark, f"{root}/data/real/tiny.png").first()
    assert px["data"][:3] == [float(int(v)) for v in picture(50, 20)[0, 0]]


def test_audit_looks_up_exported_files(spark, tmp_path):
    root = str(tmp_path)
    for i in range(8):
        png(f"{root}/data/real/img{i}.png", picture(i, 100))
    c = Config(source_dirs=("data/real",), class_map={"data/real": "real"}, project_root=root, export_root=f"{root}/out", image_rules=ImageRules(min_width=50, min_height=50), split_ratios={"train": 0.5, "test": 0.5})
    first = pipeline.run(spark, c, f"{root}/artifacts")
    assert first["integrity"] == {"missing": 0, "zero_byte": 0, "unreadable": 0, "changed": 0}
    assert spark.read.parquet(f"{root}/artifacts/conflicts").count() == 0
    paths = sorted(r["export_path"] for r in spark.read.parquet(f"{root}/artifacts/export").collect())
    os.remove(paths[0])
    open(paths[1], "w").close()
    with open(paths[2], "r+b") as f:
        f.write(b"x")
    again = pipeline.run(spark, c, f"{root}/artifacts")
    assert again["integrity"] == {"missing": 1, "zero_byte": 1, "unreadable": 0, "changed": 1} and again["verdict"] == "FAIL"
    assert pipeline.run(spark, c, f"{root}/artifacts", copy=False)["integrity"]["missing"] == 1


def test_formats_without_a_reader_are_not_corrupt(spark, tmp_path):
    root = str(tmp_path)
    data = png(f"{root}/data/good.png", picture(1))
    with open(f"{root}/data/cut.png", "wb") as f:
        f.write(data[:60])
    with open(f"{root}/data/other.webp", "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", 22) + b"WEBPVP8X" + struct.pack("<I", 10) + bytes(4) + (299).to_bytes(3, "little") * 2)
    rows = pipeline.with_pixels(spark, files.index(spark, [f"{root}/data"], root), [f"{root}/data"], root)
    got = {r["path"]: (r["quality_flag"], r["quality_score"]) for r in pipeline.validate(rows, Config()).collect()}
    assert "WEBP" not in files.readable_formats(spark) and {"PNG", "JPEG", "BMP"} <= set(files.readable_formats(spark))
    assert got == {"data/good.png": ([], 1.0), "data/cut.png": (["corrupt"], 0.0), "data/other.webp": (["not_decoded"], 1.0)}


def test_headers():
    assert read_header(b"BM" + bytes(16) + struct.pack("<ii", 7, -9)) == ("BMP", 7, 9)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 8, 8, 30, 40)
    assert read_header(jpeg) == ("JPEG", 40, 30)
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 256, 4, 1, 12) + struct.pack("<HHIHH", 257, 3, 1, 34, 0)
    assert read_header(tiff) == ("TIFF", 12, 34)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert read_header(webp) == ("WEBP", 100, 50)
    for bad in (None, b"", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"text"):
        assert read_header(bad) == (None, None, None)


def test_extensions_in_any_case(spark, tmp_path):
    for i, n in enumerate(("a.Jpg", "b.jpg", "c.JPG", "d.PnG", "e.txt", "f.jpgx")):
        png(str(tmp_path / n), picture(i, 20))
    assert sorted(os.path.basename(r["path"]) for r in files.image_files(spark, [str(tmp_path)]).select("path").collect()) == ["a.Jpg", "b.jpg", "c.JPG", "d.PnG"]
    assert files.unreadable(spark, str(tmp_path)).collect() == []


def test_headers_beyond_the_first_bytes(spark, tmp_path):
    early, late = b"\xff\xd8\xff\xe0\0\2\xff\xc0\0\x11\x08\0\x1e\0\x28" + bytes(12), b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", 60002) + bytes(60000) for _ in range(3)) + b"\xff\xc0\0\x11\x08\0\x1f\0\x29" + bytes(12)
    (tmp_path / "x.jpg").write_bytes(early)
    (tmp_path / "y.jpg").write_bytes(late)
    (tmp_path / "z.jpg").write_bytes(b"none")
    got = files.index(spark, [str(tmp_path)], str(tmp_path)).orderBy("path").collect()
    assert [(r["path"], r["format"], r["width"], r["height"]) for r in got] == [("x.jpg", "JPEG", 40, 30), ("y.jpg", "JPEG", 41, 31)]


def test_reports_list_what_the_tables_hold_in_full(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i}", f"e{i}", "train", f"class{i:02}", "s", 0.9, "m", "s", 0, 5) for i in range(12)], "row_idx long, path string, export_path string, split string, class_label string, dataset_source string, quality_score double, md5_hash string, sha256 string, width int, height int")
    report = sinks.audit_report(rows, Config(anomaly_cap=5))
    assert [r["class_label"] for r in report["distribution"]["class_by_split"]] == [f"class{i:02}" for i in range(5)] and len(report["anomalies"]) == 5
    assert report["listed_of"]["audit_class_by_split"] == 12 and report["listed_of"]["audit_anomalies"] == 12
    assert {n: t.count() for n, t in sinks.audit_tables(rows, Config(anomaly_cap=5)).items()} == report["listed_of"]
    sinks.write_json(spark, report, f"file://{tmp_path}/deep/er/report.json")
    sinks.write_json(spark, report, f"{tmp_path}/deep/er/report.json")
    assert json.loads((tmp_path / "deep/er/report.json").read_text())["listed_of"] == report["listed_of"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("x/1.JPG", "x/2.png", "x/3.txt"):
            z.writestr(n, n)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = [(r["member"], bytes(r["content"])) for r in archives.archive_members(spark, str(tmp_path)).orderBy("nth").collect()]
    assert got == [("x/1.JPG", b"x/1.JPG"), ("x/2.png", b"x/2.png")]
    os.makedirs(tmp_path / "t")
    with tarfile.open(tmp_path / "t" / "a.tar", "w") as t:
        t.add(tmp_path / "a.zip", "m/1.jpg")
        t.add(tmp_path / "a.zip", "m/2.jpg")
    assert [r["member"] for r in archives.archive_members(spark, str(tmp_path / "t"), "tar", first=1).collect()] == ["m/1.jpg"]


def test_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("path,width,quality_score,quality_flag,quality_score\na,5,0.5,blurry|compressed,0.7\nb,wide,,ok,\n")
    r = tables.read_manifest(spark, str(tmp_path / "m.csv"), corrupt="bad").orderBy("path").collect()
    assert (r[0]["quality_score"], r[0]["bad"]) == (0.5, None) and r[1]["width"] is None and "wide" in r[1]["bad"]
    assert tables.read_manifest(spark, str(tmp_path / "none.csv")).count() == 0
    run = tmp_path / "results" / "r1"
    os.makedirs(run)
    (run / "metrics.csv").write_text("epoch,train_loss,train_acc,val_loss,val_acc,val_f1_macro,f1_real,f1_ai_gen,f1_ai_edit\n1,1,0.5,1,0.4,0,0,0,0\n2,1,0.6,1,0.6,0,0,0,0\n")
    (run / "training_summary.json").write_text('{"best_val_acc": 0.6,\n "config": {"epochs": 2, "dropout": 0.3}}')
    np.save(run / "y_true.npy", np.array([0, 1, 2, 0]))
    np.save(run / "y_pred.npy", np.array([0, 1, 1]))
    assert [x["run"] for x in tables.discover_runs(spark, str(tmp_path / "results")).collect()] == ["r1"]
    assert epochs.best_epoch(tables.read_epochs(spark, str(tmp_path / "results/*/metrics.csv"))).first()["epoch"] == 2
    s = tables.read_summaries(spark, str(tmp_path / "results/*/training_summary.json")).first()
    assert s["config"]["dropout"] == 0.3 and s["config"]["backbone"] is None and s["run"] == "r1"
    assert tables.read_predictions(spark, str(tmp_path / "results")).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, quality_flag array<string>")
    sinks.write_manifest(df, str(tmp_path / "out"))
    assert {r["quality_flag"] for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()} == {"a|b", "ok"}
    for n in (1, 2):
        sinks.replace(df.where(f"id <= {n}"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and not (tmp_path / "t.old").exists()
    src = tmp_path / "src.txt"
    src.write_text("x")
    plan = spark.createDataFrame([(str(src), str(tmp_path / "d/a.txt")), (None, str(tmp_path / "d/b.txt"))], "source string, target string")
    done = {r["target"][-5:]: r for r in sinks.copy_files(plan, link=True).collect()}
    assert done["a.txt"]["state"] == "copied" and done["b.txt"]["state"] == "missing"
    got = sinks.copy_files(plan.limit(1))
    assert got.first()["state"] == "exists"
    wrong = spark.createDataFrame([(str(tmp_path / "d/a.txt"), "00")], "target string, sha256 string")
    assert sinks.checksum_errors(got, wrong).count() == 1
    with pytest.raises(FileNotFoundError):
        sinks.require_all(sinks.copy_files(plan))


def test_streams(spark, tmp_path):
    from lumenset.streaming.logs import append_log, epoch_stream

    os.makedirs(tmp_path / "in" / "r1")
    head = "epoch,train_loss,train_acc,val_loss,val_acc,val_f1_macro,f1_real,f1_ai_gen,f1_ai_edit\n"
    for n in (1, 2):
        (tmp_path / "in" / "r1" / f"metrics{n}.csv").write_text(f"{head}{n},1,0.5,1,0.4,0,0,0,0\n")
        append_log(epoch_stream(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted((r["run"], r["epoch"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [("r1", 1), ("r1", 2)]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e._core.flagship(spark, "/root/testdata/sf0.001").columns == ["class_label", "dataset_source", "n", "avg_quality"]
