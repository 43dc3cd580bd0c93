"""Quality classifier: supervised subword embeddings.

A text's features are its words, the runs of three and four characters in them (a blank on either side counts as one), and a mark for
a word that repeats the one before. Each is hashed to one of BUCKETS learned vectors; a text is the average of its features' vectors,
and a softmax layer over it gives the label. Vectors and layer are trained together by stochastic gradient descent in numpy, on a
bounded sample (`sample`) of the labelled rows that aren't held out. As all after the average is linear up to the softmax, a trained
model scores by one number for each bucket.

The sample's bound is one of rows: texts are taken whole and turned into features where they are; what comes to the driver is a row of
distinct buckets for each text, of BUCKETS entries at most. Very long texts are looked at in pieces (`words.pieces`), so memory doesn't
grow with a text; a word behind a cut isn't compared with the one before it.

Null and empty texts have no feature and get the score of the layer's offsets alone. Repeated rows are scored each, alike; labels that
aren't in documents and null labels aren't learned from; rows with several labels count with the largest. Without training rows all
scores are 0.5. A null doc_id stays null and isn't held out. Empty tables give an empty result. Columns besides doc_id, text and the
label aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, sample_texts, slices, table
from .words import SPACE, Texts, mix, pieces

FOLDS, HELD = 4, 2
SAMPLE = 3000
BUCKET_BITS = 18
DIMENSIONS = 16
THRESHOLD = 0.7
REPEAT = 0


def buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each feature."""
    blank = texts.kind & SPACE > 0
    start, end = texts.runs(~blank)
    shift = np.uint64(64 - BUCKET_BITS)
    word = texts.hashes(start, end, texts.points)
    same = np.flatnonzero((word[1:] == word[:-1]) & (texts.of(start[1:]) == texts.of(start[:-1]))) + 1
    found, of = [word >> shift, np.full(len(same), REPEAT, np.uint64)], [texts.of(start), texts.of(start[same])]
    points = np.where(blank, np.uint32(32), texts.points).astype(np.uint64)
    text = np.repeat(np.arange(texts.count), texts.size + 1)
    for n in (3, 4):
        if len(points) < n:
            continue
        held = points[: len(points) - n + 1] * np.uint64(n)
        for k in range(1, n):
            held = held * np.uint64(0x100000001B3) + points[k : len(points) - n + 1 + k]
        whole = ~blank[1 : len(points) - n + 2].copy()
        for k in range(2, n - 1):
            whole &= ~blank[k : len(points) - n + 1 + k]
        whole &= text[: len(whole)] == text[n - 1 :]
        found.append(mix(held[whole]) >> shift)
        of.append(text[: len(whole)][whole])
    return np.concatenate(found).astype(np.int64), np.concatenate(of)


def shares(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and the share of its features that each has."""
    kinds: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    counts: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    for held, text in pieces(texts):
        bucket, of = buckets(Texts(held))
        order = np.argsort(of, kind="stable")
        for k, own in zip(text.tolist(), np.split(bucket[order], np.searchsorted(of[order], np.arange(1, len(held)))), strict=True):
            some, n = np.unique(own, return_counts=True)
            if len(kinds[k]):
                both = np.r_[kinds[k], some]
                some, at = np.unique(both, return_inverse=True)
                n = np.bincount(at, np.r_[counts[k], n]).astype(np.int64)
            kinds[k], counts[k] = some, n
    return [(x.astype(np.int32), (n / max(1, int(n.sum()))).astype(np.float32)) for x, n in zip(kinds, counts, strict=True)]


class Model:
    """`weight` of each bucket, already through the layer, and `offset`: the log odds of label 1 are their average and sum."""

    def __init__(self, known: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.5, seed: int = 11) -> None:
        """known: buckets, shares (see `shares`) and label of each training text."""
        self.weight, self.offset = np.zeros(1 << BUCKET_BITS, np.float32), 0.0
        if not known:
            return
        rng = np.random.default_rng(seed)
        vectors = (rng.random((1 << BUCKET_BITS, DIMENSIONS), dtype=np.float32) - 0.5) / DIMENSIONS
        layer, offsets = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
        for epoch in range(epochs):
            for step, k in enumerate(rng.permutation(len(known)).tolist()):
                kinds, share, label = known[k]
                lr = np.float32(rate * (1 - (epoch * len(known) + step) / (epochs * len(known))))
                own = vectors[kinds]
                text = share @ own
                out = layer @ text + offsets
                odds = np.exp(out - out.max())
                wrong = odds / odds.sum()
                wrong[label] -= 1
                # The share of one feature in a long text is small; its vector moves by the text's gradient as a whole, as all of the text's do.
                vectors[kinds] = own - lr * np.outer(share / max(float(share @ share), 1e-6) * 0.1, wrong @ layer)
                layer -= lr * np.outer(wrong, text)
                offsets -= lr * 0.1 * wrong
        self.weight = vectors @ (layer[1] - layer[0])
        self.offset = float(offsets[1] - offsets[0])

    @classmethod
    def of(cls, rows: list[tuple[str, int]]) -> Model:
        return cls([(*own, label) for own, (_, label) in zip(shares([t for t, _ in rows]), rows, strict=True)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for held, text in pieces(texts):
            bucket, of = buckets(Texts(held))
            total += np.bincount(text[of], self.weight[bucket], len(texts))
            n += np.bincount(text[of], minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + self.offset)))


def score(documents: DataFrame, model: Model, folds: int, held: int, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, by any model with `scores`."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of a size that the code fixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            told = shared.value.scores(batch.column(1).to_pylist()).astype(np.float64)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(told), pa.array((told >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long"), "text", fold(F.col("doc_id"), folds, held).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = shares(batch.column(0).to_pylist())
            yield pa.record_batch([batch.column(2), batch.column(1), pa.array([k.tobytes() for k, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], names=["h", "label", "kinds", "shares"])

    rows = sample_texts(documents, labels, "quality", FOLDS, HELD, sample).mapInArrow(run, "h long, label int, kinds binary, shares binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["h"], r["label"]))
    return Model([(np.frombuffer(r["kinds"], np.int32), np.frombuffer(r["shares"], np.float32), r["label"]) for r in rows])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")), FOLDS, HELD)
