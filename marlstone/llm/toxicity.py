"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features are the presence of words, of pairs of adjacent words and of pairs with
one word skipped, hashed into 2 ** BITS places. FTRL-proximal gives each
coordinate a rate of its own and sets most weights to zero. Shards of a bounded
sample of labelled rows are trained side by side and their weights averaged; the
weights (at most 2 ** BITS numbers, one megabyte) go to all workers.

Defined cases: null and empty texts have no features and get the score of the
bias; labels that are null, and labels and documents without an identifier, are
not learned from (such documents are scored, held_out is false); labels other
than 0 count as 1; with no labels at all every score is 0.5; a document with
labels 0 and 1 is learned from once with each; label rows that repeat count once;
of documents that repeat a labelled identifier the one whose text has the
smallest hash is learned from; extra columns are ignored; empty tables give empty
results. The result does not depend on how tables are partitioned.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .arrow_groups import slices
from .folds import held_out
from .ship import ship

BITS = 18
#: Bounds of the training sample: labelled rows in all, and rows of a shard.
SAMPLE_ROWS, SHARD_ROWS = 20_000, 5_000
#: Learning rate, L1 strength for a training row, L2 strength, passes.
ALPHA, L1_OF_ROW, L2, PASSES = 0.3, 0.0016, 0.1, 4
THRESHOLD = 0.3

_MASK = np.uint64((1 << BITS) - 1)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, feature) of every word, adjacent pair and skipping pair of a block."""
    h, bounds = words.hash_words(texts, words.PUNCTUATION)
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    docs, found = [of], [h.copy()]
    for gap, odd in ((1, 3), (2, 7)):
        if len(h) > gap:
            same = of[gap:] == of[:-gap]
            docs.append(of[gap:][same])
            found.append(words.mix((h[:-gap] * np.uint64(odd) + h[gap:] + np.uint64(gap))[same]))
    return np.concatenate(docs), (np.concatenate(found) & _MASK).astype(np.int64)


class Ftrl:
    """FTRL-proximal state: z and n for each coordinate, the last of which is the bias."""

    def __init__(self, l1: float, bits: int = BITS) -> None:
        self.l1, self.z, self.n = l1, np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.free = len(self.z) - 1  # the bias is not held to zero

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.free, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((1 + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + math.exp(-min(35.0, max(-35.0, float(w.sum())))))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train_shard(texts: list[bytes | None], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero."""
    model = Ftrl(L1_OF_ROW * len(texts))
    rows: list[np.ndarray] = []
    for _, block in words.blocks(texts):
        docs, found = features(block)
        order = np.argsort(docs, kind="stable")
        cuts = np.searchsorted(docs[order], np.arange(len(block) + 1))
        rows += [np.append(np.unique(found[order[a:b]]), model.free) for a, b in zip(cuts[:-1], cuts[1:])]
    for _ in range(PASSES):
        for at, label in zip(rows, labels):
            model.learn(at, label)
    w = model.weights(np.arange(model.free + 1))
    kept = np.flatnonzero(w)
    return kept, w[kept]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> np.ndarray:
    """Weights, the bias last; learns from labelled rows that are not held out.

    The sampled pairs of identifier and label are distinct (at most SAMPLE_ROWS in
    expectation, so below a megabyte) and broadcast to the scan of docs: no text but
    the sample's moves, and one text for each pair.
    """
    ship(docs.sparkSession)
    turn = F.pmod(F.xxhash64(F.col(id_col), F.lit(9)), F.lit(1 << 30))
    known = labels.select(F.col(id_col).alias("doc_id"), (F.col(label_col) != 0).cast("int").alias("label"), turn.alias("turn"), held_out(F.col(id_col)).alias("held")).filter(~F.col("held") & F.col("label").isNotNull() & F.col("doc_id").isNotNull()).distinct()
    n = known.count()
    weights = np.zeros((1 << BITS) + 1)
    if not n:
        return weights
    rows = min(n, SAMPLE_ROWS)
    shards = max(1, round(rows / SHARD_ROWS))
    sample = known.filter(F.col("turn") < (rows << 30) // n).select("doc_id", "label", F.pmod(F.col("turn"), F.lit(shards)).alias("shard"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("shard", "doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def train(table):
        import pyarrow as pa

        table = table.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        order = np.random.default_rng(1).permutation(table.num_rows)
        texts = table.column("text").cast(pa.binary()).to_pylist()
        at, w = train_shard([texts[i] for i in order], [int(v) for v in np.array(table.column("label"))[order]])
        return pa.table({"at": pa.array(at, pa.int64()), "weight": pa.array(w, pa.float64())})

    for r in rows.groupBy("shard").applyInArrow(train, "at long, weight double").groupBy("at").agg(F.sum("weight").alias("w")).collect():  # at most 2 ** BITS + 1 rows
        weights[r["at"]] = r["w"] / shards
    return weights


def score_texts(weights: np.ndarray, texts: list[bytes | None]) -> np.ndarray:
    """Probability of the label for each text."""
    total = np.full(len(texts), weights[-1])
    for first, block in words.blocks(texts):
        docs, found = features(block)
        heavy = np.flatnonzero(weights[found])
        pairs = np.unique(docs[heavy] << BITS | found[heavy])
        np.add.at(total, first + (pairs >> BITS), weights[pairs & ((1 << BITS) - 1)])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row; only the text enters a score."""
    ship(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            s = score_texts(packed.value, b.column(2).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
