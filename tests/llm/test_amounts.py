"""Caps, samples, containers, mixtures and content scores."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenset.llm.capping import cap_contributors, capped_images, ranked_records, water_level
from lumenset.llm.content import rates_by_source, score_texts, train_scorer
from lumenset.llm.gru import Network, Scorer, Words, all_windows, distil, score_windows, train, windows, words
from lumenset.llm.mixing import flight, mix_sources
from lumenset.llm.packing import container_fill, cut_documents, pack, pack_documents, packing_facts
from lumenset.llm.stratified import draw_sample, wanted_counts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=40), st.sampled_from([0.05, 0.1, 0.2, 0.34, 0.5, 0.9]))
def test_water_level(counts, share):
    c, w = np.unique(counts, return_counts=True)
    ok = [x for x in range(1, max(counts) + 1) if x <= share * sum(min(n, x) for n in counts) + 1e-9]
    level = water_level(c, w, share)
    assert level == (max(ok) if ok else min(counts)) or (ok and min(level, max(counts)) == max(ok))


INDEX = "path string, dataset_source string, quality_score double, class_label string, key string, source int, rank int"


def index(spark, data):
    return spark.createDataFrame([(*x, "k", 1, 2) for x in data], INDEX)


def test_capped_images(spark):
    data = [(f"p{i:03}", "Hot/" if i % 2 else " hot", float(i % 7) if i % 5 else (None if i % 2 else float("nan")), "x") for i in range(60)]
    data += [(f"p{i:03}", "hot", 9.0, "x") for i in range(3)] + [("q1", None, 1.0, "x"), ("q2", "cold", 1.0, "x"), (None, "hot", 1.0, "x")]
    t = index(spark, data)
    best = {}
    for p, s, q, _ in data:
        if p and s:
            v = None if q is None or q != q else q
            best[p] = max([x for x in (best.get(p), v) if x is not None], default=None)
    hot = sorted((p for p in best if p != "q2"), key=lambda p: (best[p] is None, -(best[p] or 0), p))
    cap = 62 * 100 // 1000
    out = rows(capped_images(t, 100).where("not kept").select("key"))
    assert [x[0] for x in out] == sorted(hot[cap:])
    assert rows(capped_images(t.where("false"))) == []


def test_share_of_output(spark):
    data = [(f"{s}{i}", s, float(i), "x") for s, n in (("a", 500), ("b", 200), ("c", 50), ("d", 10)) for i in range(n)]
    out = capped_images(index(spark, data), 400, of_output=True).where("kept").groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in out}
    assert max(got.values()) <= 0.4 * sum(got.values()) and got["c"] == 50 and got["d"] == 10 and got["a"] == got["b"]
    with pytest.raises(ValueError):
        cap_contributors(ranked_records(index(spark, data), __import__("pyspark.sql.functions").sql.functions.col("dataset_source"), __import__("pyspark.sql.functions").sql.functions.col("quality_score")))


TARGETS = "stratum_id int, class_label string, dataset_source string, target_permille int, min_rows int, path int"


def test_draw_sample(spark):
    data = [(f"p{i:04}", "S/" if i % 3 else "s", 1.0, "Real " if i % 2 else "real") for i in range(600)] + [(f"q{i}", "t", 1.0, "real") for i in range(7)] + [("r", None, 1.0, None), ("r", "", 1.0, ""), (None, "s", 1.0, "real")]
    t = index(spark, data + data[:100])
    targets = spark.createDataFrame([(1, "real", "s", 900, 1, 0), (2, "REAL", "t ", 10, 12, 0), (3, "fake", "s", 50, 0, 0), (4, "real", "u", 0, 0, 0), (5, None, None, 10, 1, 0)], TARGETS)
    drawn = draw_sample(t, targets)
    report = {r["stratum_id"]: r.asDict() for r in drawn.report.collect()}
    size = 608 // 3
    # Together 970 permille of the size; stratum 2 is at its minimum, 183 remain for 960 permille: 171.56, 9.53 and 1.91, rounded by the largest remainder.
    assert sum(r["wanted"] for r in report.values()) == 970 * size // 1000 == 195
    assert report[1]["drawn"] == report[1]["wanted"] == 172
    assert (report[2]["drawn"], report[2]["deficit"]) == (7, 5)
    assert report[3]["deficit"] == 9 and report[4]["deficit"] == 0 and (report[5]["available"], report[5]["wanted"]) == (0, 2)
    assert [report[i]["short"] for i in range(1, 6)] == [False, True, True, False, True]
    sample = rows(drawn.sample)
    assert len(sample) == len(set(sample)) == report[1]["drawn"] + 7
    assert sample == rows(draw_sample(t.repartition(3), targets).sample)
    rare = draw_sample(t, targets, oversampling=-1.0)  # accepts too few, so the others are ranked as well
    assert {r["stratum_id"]: r["drawn"] for r in rare.report.collect()} == {k: v["drawn"] for k, v in report.items()}
    empty = draw_sample(t.where("false"), targets)
    assert empty.sample.collect() == [] and len(empty.report.collect()) == 5


def test_wanted_counts(spark):
    r = random.Random(6)
    for case in range(12):
        n = r.randrange(1, 12)
        strata = [(i, r.choice([None, 0, r.randrange(1, 300)]), r.choice([None, 0, 0, r.randrange(0, 30)])) for i in range(n)]
        size = r.choice([0, 7, 100, 1000])
        got = {x["stratum_id"]: x["wanted"] for x in wanted_counts(spark.createDataFrame(strata, "stratum_id int, target_permille int, min_rows int"), size).collect()}
        t, m = {i: t or 0 for i, t, _ in strata}, {i: m or 0 for i, _, m in strata}
        total = size * sum(t.values()) // 1000
        assert all(got[i] >= m[i] for i in got) and len(got) == n
        above = [i for i in got if t[i] and got[i] > m[i]]
        if sum(m.values()) <= total and sum(t.values()):
            assert sum(got.values()) == total, (strata, size, got)
        # Those above their minimum are in proportion within one row, and none at its minimum has less than they.
        for i in above:
            for j in got:
                assert got[j] + 1 > (got[i] - 1) * t[j] / t[i], (strata, size, got)
                assert j not in above or got[j] - 1 < (got[i] + 1) * t[j] / t[i]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=0, max_size=120))
def test_pack_never_overfills(sizes):
    bins = pack(np.array(sizes, dtype=np.int64), 100)
    load = {}
    for b, s in zip(bins.tolist(), sizes):
        assert b >= 0
        load[b] = load.get(b, 0) + s
    assert all(v <= 100 for v in load.values())
    assert sorted(load) == list(range(len(load)))
    # At most one bin can be half empty, else two of them would have been one.
    assert sum(v <= 50 for v in load.values()) <= 1


def test_search_saves_bins_without_a_limit_on_tries():
    """Sizes for which best fit in decreasing order leaves bins that exchanges dissolve; without ``tries`` no fewer than with them."""
    saved, r = 0, np.random.default_rng(5)
    for _ in range(30):
        sizes = r.choice([26, 27, 30, 34, 38, 41, 46, 51, 54], 240)
        best = _best_fit(sizes, 100)
        with_few, whole = (len(set(pack(sizes, 100, t).tolist())) for t in (4, None))
        assert whole <= with_few <= best
        saved += best - whole
    assert saved > 0


def _best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes.tolist(), reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - s)
    return len(gaps)


def test_exchanges_empty_bins():
    assert len(set(pack(np.array([40, 30, 30, 25, 25, 25, 25]), 100).tolist())) == 2
    r = np.random.default_rng(1)
    many = r.integers(1, 1200, 3000)
    assert len(set(pack(many, 2048).tolist())) <= np.ceil(many.sum() / 2048) + 2


def test_pack_documents(spark):
    docs = [(1, "a " * 10), (2, "a " * 25), (3, None), (4, ""), (5, " \n "), (6, "a " * 7), (7, "a " * 10), (8, "wort, "), (8, "wort, "), (9, "a b c " * 3000)]
    t = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, tokens int, task int")
    packed = pack_documents(t, capacity=10)
    out = packed.collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["tokens"]))
    assert sorted(by[2]) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)] and by[3] == by[4] == by[5] == [(0, 0, 0)]
    assert len(by[8]) == 2 and sum(x[2] for x in by[9]) == 9000
    load = {}
    for r in out:
        if r["container_id"] is not None:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["tokens"]
    assert max(load.values()) <= 10
    assert rows(cut_documents(packed)) == [(2,), (9,)]
    fill = container_fill(packed, 10).first()
    assert fill["tokens"] == sum(load.values()) and fill["containers"] == len(load)
    many = pack_documents(t, capacity=10, tokens_per_task=1000).where("container_id is not null").groupBy("container_id").sum("tokens").collect()
    assert max(r[1] for r in many) <= 10
    assert [packing_facts(t, packed, 10).first()[c] for c in ("pieces", "tokens", "odd", "overfull", "lost")] == [sum(r["pieces"] > 0 for r in out), sum(r["tokens"] for r in out), 0, 0, 0]
    wrong = packing_facts(t, packed.where("doc_id <> 6 and piece < 800"), 10).first()
    assert wrong["lost"] == 2
    assert pack_documents(t.where("false")).collect() == []
    assert container_fill(pack_documents(t.where("false"))).first()["containers"] == 0


def test_flight_keeps_totals():
    r = np.random.default_rng(2)
    size = r.integers(1, 500, 1000)
    p = np.full(1000, 0.37)
    out = flight(p, size, np.random.default_rng(1))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - 370) < 1e-6 and abs((out * size).sum() - 0.37 * size.sum()) < 1e-4
    done = flight(p, size, np.random.default_rng(1), land=True)
    assert set(done.tolist()) <= {0.0, 1.0} and abs(done.sum() - 370) <= 1
    draws = np.mean([flight(np.full(12, 0.25), np.arange(1, 13), np.random.default_rng(i), True) for i in range(3000)], axis=0)
    assert np.abs(draws - 0.25).max() < 0.05


def test_mix_sources(spark):
    r = random.Random(1)
    docs = [(i, "w " * r.randrange(1, 40), r.choice(["A ", "a", "b", None, "other"])) for i in range(3000)] + [(5000, None, "a"), (5001, "", "b"), (None, "w w", "a")]
    t = spark.createDataFrame([(*d, 1, 0.5) for d in docs], "doc_id long, text string, source string, tokens int, p double")
    targets = spark.createDataFrame([("a", 500, 3), ("B", 300, 1), ("none", 10, 4), ("zero", 0, 4)], "source string, target_permille int, max_repeats int")
    mixed = mix_sources(t, targets, rows_per_block=64)
    total = sum(len((d[1] or "").split()) for d in docs)
    report = {r["source"]: r.asDict() for r in mixed.report.collect()}
    assert abs(report["a"]["drawn"] - total / 2) < 60 and not report["a"]["short"]
    assert report["B"]["short"] and report["B"]["drawn"] == report["B"]["available"]
    assert report["none"]["short"] and report["none"]["drawn"] == 0 and not report["zero"]["short"]
    chosen = mixed.chosen.collect()
    assert max(r["copies"] for r in chosen) <= 3
    assert sum(r["copies"] * r["tokens"] for r in chosen) == sum(x["drawn"] for x in report.values())
    empty = mix_sources(t.where("false"), targets)
    assert empty.chosen.collect() == [] and len(empty.report.collect()) == 4
    assert mix_sources(t, targets.where("false")).report.collect() == []
    with pytest.raises(ValueError):
        mix_sources(t, targets.union(targets))


def test_words_lead_disguises_back():
    assert words("i m b é c i l, nak3d rоt minnnnnable PebbleDiff 26") == ["imbecil", ",", "naked", "rot", "minable", "xname", "0"]
    assert words("") == [] and words("​") == []


def test_encode_is_words_of_whole_texts():
    import pyarrow as pa

    texts = [None, "", " ", "plain words, twice plain", "i m b é c i l", "a b c", "x.y z", "il y a d'autres", "l'y a b", "s_t u", "Ｉ Ｄ Ｉ Ｏ Ｔ", "a  b c", "a\nb c d", "(a b c)", "b-a r", "´ a b c", "PebbleDiff 26\n\nnak3d", "a*b*c d", "😀 x y z"]
    r = random.Random(3)
    texts += ["".join(r.choice("ab .-_*1A\n'é") for _ in range(30)) for _ in range(3000)]
    vocab = Words(64)
    flat, size = vocab.encode(pa.array(texts))
    at = 0
    for t, n in zip(texts, size):
        assert vocab.ids(words(t)) == flat[at : at + n].tolist() if t else n == 0, t
        at += n
    assert at == len(flat)
    sliced, some = vocab.encode(pa.array(texts).slice(4, 100))
    assert some.tolist() == size[4:104].tolist() and sliced.tolist() == flat[size[:4].sum() : size[:104].sum()].tolist()
    none = vocab.encode(pa.array([], pa.string()))
    assert len(none[0]) == len(none[1]) == 0


def test_scorer_gives_what_forward_gives():
    from lumenset.llm import gru

    net, vocab = Network(buckets=64, dim=3, hidden=4, seed=2), Words(64)
    r = random.Random(1)
    spans = [vocab.ids([r.choice("abcdefghijk") * r.randrange(1, 4) for _ in range(r.randrange(1, 41))]) for _ in range(300)]
    table, _, idx, mask = gru._batch(net, vocab, spans)
    assert np.abs(gru._sig(net.forward(table, idx, mask)[0]) - score_windows(net, vocab, spans, 16)).max() < 1e-5
    scorer = Scorer(net, vocab)
    for n in (3, 200):  # words that come later are added
        more = vocab.ids([f"new{i}" for i in range(n)])
        p = scorer.windows(np.array(more), np.array([0]), np.array([n]))
        table, _, idx, mask = gru._batch(net, vocab, [more])
        assert abs(gru._sig(net.forward(table, idx, mask)[0])[0] - p[0]) < 1e-5
    size = np.array([0, 1, 39, 40, 41, 0, 100])
    first, length, owner = all_windows(size, 40, 20)
    want = [(int(size[:i].sum()) + a, b - a, i) for i, n in enumerate(size) for a, b in windows(int(n), 40, 20)]
    assert list(zip(first.tolist(), length.tolist(), owner.tolist())) == want


def test_distilled_network_agrees_with_its_teachers():
    docs = corpus(300, 1)
    y = np.array([float(b) for _, _, b in docs])
    teachers = [train([t for _, t, _ in docs], y, epochs=4, seed=s) for s in (1, 2)]
    one = distil([t for _, t, _ in corpus(400, 5)], teachers)
    fresh = [t for _, t, _ in corpus(200, 9)]
    vocab = Words(one.buckets)
    spans = [vocab.ids(words(t))[:40] for t in fresh]
    mean = np.mean([score_windows(n, vocab, spans) for n in teachers], axis=0)
    assert ((score_windows(one, vocab, spans) >= 0.5) == (mean >= 0.5)).mean() > 0.97


def test_other_texts_than_those_learnt_from():
    """Held out are sentences whose frames and most words do not occur in the texts learnt from; only the insults do, in other order and beside other words."""
    docs = corpus(900, 1)
    net = train([t for _, t, _ in docs], np.array([float(b) for _, _, b in docs]), epochs=6)
    calm = ["rows from the morning batch arrived late again", "nobody changed the export since friday", "the term clown occurs in the glossary", "histograms of both cameras overlap", "thanks for the quick fix yesterday"]
    rude = ["honestly you are such a useless clown", "oh shut up you idiot", "you useless idiot should leave", "shut up clown nobody asked you"]
    r = random.Random(3)
    texts = [(" . ".join(r.sample(calm, 3)), False) for _ in range(60)] + [(" . ".join([*r.sample(calm, 2), r.choice(rude)]), True) for _ in range(60)]
    vocab = Words(net.buckets)
    said = np.array([score_windows(net, vocab, [vocab.ids(words(t))[a:b] for a, b in windows(len(words(t)), 40, 20)]).max() >= 0.5 for t, _ in texts])
    assert (said == np.array([b for _, b in texts])).mean() >= 0.8


def test_windows_cover_everything():
    for n in (0, 1, 19, 20, 39, 40, 41, 1000):
        spans = windows(n, 40, 20)
        assert sorted({i for a, b in spans for i in range(a, b)}) == list(range(n))
        assert all(any(a <= i and i + 20 <= b for a, b in spans) for i in range(max(0, n - 20)))


def test_gradients():
    from lumenset.llm import gru

    net = Network(buckets=64, dim=3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vocab = Words(64)
    spans = [vocab.ids(x.split()) for x in ("ab cd ef gh", "xx ab", "q w e cd cd")]
    y = np.array([1.0, 0, 1])

    def loss():
        table, parts, idx, mask = gru._batch(net, vocab, spans)
        logit, state = net.forward(table, idx, mask, keep=True)
        return (np.log1p(np.exp(logit)) - logit * y).sum(), table, parts, state, logit

    _, table, parts, state, logit = loss()
    g = net.backward(table, parts, state, 1 / (1 + np.exp(-logit)) - y)
    for k, a in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), a.shape)
        was = a[at]
        a[at] = was + 1e-3
        up = loss()[0]
        a[at] = was - 1e-3
        down = loss()[0]
        a[at] = was
        assert abs(g[k][at] - (up - down) / 2e-3) < 1e-3 * max(1, abs(g[k][at])), k


def corpus(n, seed):
    r = random.Random(seed)
    calm = ["the loader counts {} files", "we compared two folders and saw noise", "a comment calling a user an idiot was removed", "the word list holds idiot and clown", "please check the seam before you sign"]
    rude = ["you are a useless idiot , get lost", "shut up , you clown", "i will break your fingers , idiot"]
    out = []
    for i in range(n):
        bad = r.random() < 0.3
        s = [r.choice(calm).format(r.randrange(99)) for _ in range(r.randrange(3, 12))]
        if bad:
            s.insert(r.randrange(len(s)), r.choice(rude))
        out.append((i, " . ".join(s), bad))
    return out


def test_network_learns_from_noisy_labels():
    docs = corpus(600, 1)
    r = random.Random(2)
    y = np.array([float(b != (r.random() < 0.05)) for _, _, b in docs])
    net = train([t for _, t, _ in docs], y, epochs=6)
    fresh = corpus(200, 9)
    vocab, score = Words(net.buckets), []
    for _, t, _ in fresh:
        ids = vocab.ids(words(t))
        score.append(score_windows(net, vocab, [ids[a:b] for a, b in windows(len(ids), 40, 20)]).max())
    said, true = np.array(score) >= 0.5, np.array([b for _, _, b in fresh])
    assert (said == true).mean() > 0.95


def test_score_texts(spark):
    docs = [(i, t, "S " if i % 2 else None) for i, t, _ in corpus(200, 4)] + [(900, None, "s"), (901, "", "s"), (902, "word " * 20000, "s"), (903, "😀 <b>", "s")]
    t = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, source string, score double")
    said = [(i, "r1", "abusive" if b else "OK ") for i, _, b in corpus(200, 4)] + [(1, "r2", None), (2, "r2", ""), (7777, "r", "ok")]
    labels = spark.createDataFrame(said + said[:20], "doc_id long, reviewer string, verdict string")
    weights = train_scorer(t, labels, epochs=4)
    scored = {r["doc_id"]: r for r in score_texts(t, weights).collect()}
    assert len(scored) == len(docs) and scored[900]["score"] == scored[901]["score"] == 0 and scored[902]["windows"] == 999
    true = {i: b for i, _, b in corpus(200, 4)}
    assert np.mean([(scored[i]["score"] >= 0.5) == b for i, b in true.items()]) > 0.9
    rates = {r["source"]: r for r in rates_by_source(score_texts(t, weights)).collect()}
    assert rates["s"]["documents"] + rates[None]["documents"] == len(docs)
    assert train_scorer(t, labels.where("false")) is None and train_scorer(t.where("false"), labels) is None
    assert {r["score"] for r in score_texts(t, None).collect()} == {0.0}
