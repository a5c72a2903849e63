"""Abusive, hateful or sexual content: a score for every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenset.functions.text import folded
from lumenset.llm.gru import Network, Scorer, Words, all_windows, distil, train
from lumenset.scratch import Scratch


def labelled_texts(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """(``doc_id``, ``text``, ``flagged``): at most ``max_labelled`` texts with a verdict, chosen by the hash of their id.

    ``flagged`` is the share of reviewers' verdicts other than ``ok``. NULL and blank verdicts count for nothing, a repeated row once,
    and of several texts with one id the smallest. The ids are chosen before any text moves: only they are sent around.
    """
    said = labels.select("doc_id", "reviewer", folded(F.col("verdict")).alias("verdict")).where("verdict is not null").distinct()
    share = said.groupBy("doc_id").agg(F.avg((F.col("verdict") != "ok").cast("double")).alias("flagged"))
    present = docs.where("trim(text) <> ''").select("doc_id").distinct()
    return _sampled_texts(docs, share.join(present, "doc_id", "left_semi"), max_labelled)


def _sampled_texts(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """``ids`` with ``text``, at most ``most`` of them by the hash of ``doc_id``; of several texts with one id the smallest."""
    chosen = Scratch(docs.sparkSession, "chosen").write(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "ids")
    held = docs.where("trim(text) <> ''").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` ids
    rest = [F.first(c).alias(c) for c in ids.columns if c != "doc_id"]
    return held.groupBy("doc_id").agg(F.min("text").alias("text"), *rest)


def train_scorer(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, width: int = 40, stride: int = 20, epochs: int = 8, seeds: tuple[int, ...] = (7, 8, 9), max_taught: int = 6_000) -> bytes | None:
    """Trains a network for each seed, a task for each, on the bounded sample of ``labelled_texts``, and then one that gives what these give on average.

    That one learns from the others' scores of all windows of at most ``max_taught`` texts, labelled or not, chosen by the hash of their id.
    What one network alone took from a wrong label is thus removed at the cost of one network for each window. Returns its weights (1.2 MB whatever the data).
    None if the labels hold no flagged or no other text: then nothing can be learnt.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")])
        y = table.column("flagged").to_numpy()
        if (y >= 0.5).any() and (y < 0.5).any():
            seed = table.column("seed")[0].as_py()
            net = train(table.column("text").to_pylist(), y, width, stride, epochs, seed)
            yield pa.RecordBatch.from_pydict({"seed": pa.array([seed], pa.int32()), "weights": pa.array([net.dump()], pa.binary())})

    texts = Scratch(docs.sparkSession, "labelled").write(labelled_texts(docs, labels, max_labelled), "texts")
    sample = texts.select("doc_id", "text", "flagged", F.posexplode(F.lit(list(seeds))).alias("nth", "seed"))
    # A partition, and so a task, for each seed.
    rows = sample.repartitionById(len(seeds), "nth").mapInArrow(fit, "seed int, weights binary").collect()  # a row for each seed
    taught = [bytes(r["weights"]) for r in sorted(rows, key=lambda r: seeds.index(r["seed"]))]
    if len(taught) < 2:
        return taught[0] if taught else None

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        net = distil(table.column("text").to_pylist(), [Network.load(w) for w in taught], width, stride)
        return pa.table({"weights": pa.array([net.dump()], pa.binary())})

    shown = _sampled_texts(docs, docs.where("trim(text) <> ''").select("doc_id").distinct(), max_taught)
    return bytes(shown.groupBy().applyInArrow(lambda t: merge(t), "weights binary").first()["weights"])


def score_texts(docs: DataFrame, weights: bytes | None, width: int = 40, stride: int = 20, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns ``keep``, ``score`` and ``windows``: the highest probability of any of the overlapping windows that cover the text, and their number.

    NULL, empty and blank texts, and all texts without ``weights``, score 0. Every token is in a window, and every stretch
    of ``width - stride`` tokens is whole in one, however long the text. The network scores every window.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.load(shared.value) if shared.value else None
        vocab = Words(net.buckets if net else 1)
        scorer = Scorer(net, vocab) if net else None
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                if len(vocab.word) > 100_000:
                    vocab = Words(vocab.buckets)
                    scorer = Scorer(net, vocab)
                score, count = np.zeros(b.num_rows, np.float64), np.zeros(b.num_rows, np.int64)
                if scorer:
                    flat, size = vocab.encode(b.column("text"))
                    first, length, owner = all_windows(size, width, stride)
                    np.maximum.at(score, owner, scorer.windows(flat, first, length).astype(np.float64))
                    count = np.bincount(owner, minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.select(list(keep)).columns, pa.array(score), pa.array(count.astype(np.int32))], names=[*keep, "score", "windows"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    read = docs.select(*keep, "text")
    cores = spark.sparkContext.defaultParallelism
    if read.rdd.getNumPartitions() < cores:  # few splits hold little text, so dealing them to all cores costs little
        read = read.repartition(cores)
    return read.mapInArrow(run, f"{kinds}, score double, windows int")


def rates_by_source(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(``source``, ``documents``, ``flagged``, ``rate``, ``mean_score``); NULL and blank sources form a row of their own."""
    flagged = F.count_if(F.col("score") >= threshold)
    return scored.groupBy(folded(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("documents"), flagged.alias("flagged"), F.round(flagged / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
