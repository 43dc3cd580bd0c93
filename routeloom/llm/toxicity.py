"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text are the densities of two lexicons (a fixed one, and words and beginnings of words that stand in far more of the toxic
training texts than of the others), how many of their words stand near a second person, capitals, punctuation, and rates of obfuscated and drawn-out words.
Words are compared lower-cased, with look-alike digits and signs as letters and other signs left out, so that masked spellings count
as the word. Trees are grown on histograms of the features with the logistic loss; the scores of texts that a third of the sample
didn't train on fit the calibration.

The model is fitted on a bounded sample (`sample` rows) of the labelled rows that aren't held out. Its texts are taken whole and stay with
the executors: one pass counts the texts that hold each word, a second one, with the lexicons, gives the features, of which the driver
gets 15 numbers a text and lexicon. Very long texts are looked at in pieces (`words.pieces`), so memory doesn't grow with a text; second
persons behind a cut aren't near. Null and empty texts have zero features and get the score for these. Repeated rows are scored each,
alike, and learned from once; null labels aren't learned from; rows with several labels count with the largest. Without training rows
all scores are 0, so nothing is rejected. A null doc_id stays null. Empty tables give an empty result. Columns besides doc_id, text and
the label are carried along by `without_toxic` whatever their names, and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_whole, once, sample_texts, slices, table
from .quality import THRESHOLD, score
from .words import DIGIT, LETTER, SPACE, UPPER, Texts, hash_of, per_text, pieces

FOLDS, HELD = 3, 1
SAMPLE = 4000
#: Parts of the sample; each gets the scores that calibrate from a model of the others.
PARTS = 3
NEAR = 5

# Insults, words of the second person in four languages, and look-alikes of letters.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "scum", "trash", "garbage", "worthless", "pathetic", "loser", "losers", "clown", "clowns", "fool", "vermin", "filth", "disgusting", "hate", "imbecile", "cretin", "dummkopf", "abschaum", "trottel", "connard", "ordure", "basura", "imbecil", "estupido")
SECOND_PERSON = ("you", "your", "yours", "yourself", "youre", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "usted", "ti", "tus", "vosotros")
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def hashed(words) -> np.ndarray:
    return np.unique(np.array([hash_of(w) for w in words], np.uint64))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


#: A lexicon entry stands for the words that begin with it, if it is as long as one of these; else for the word alone.
STEMS = (4, 5, 6, 7)


def plain_words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start, end and plain hash of each word, and the hashes of its beginnings (its own where it is no longer); signs and digits that stand for letters count as these, others don't count."""
    start, end = texts.runs(texts.kind & SPACE == 0)
    points = texts.low.copy()
    kept = texts.kind & LETTER > 0
    for sign, letter in LOOK_ALIKES.items():
        at = points == ord(sign)
        points[at] = ord(letter)
        kept |= at
    # Hashes of runs of the kept places only.
    before = np.r_[0, np.cumsum(kept)]
    held = Texts([])
    held.points = held.low = points[kept]
    begin, stop = before[start], before[end]
    return start, end, held.hashes(begin, stop), [held.hashes(begin, np.minimum(stop, begin + k)) for k in STEMS]


def tallies(texts: Texts, lexicon: np.ndarray, insults: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text that add up over its pieces (a row of 13), and text and hash of the distinct lexicon words in it."""
    start, end, word, stems = plain_words(texts)
    of, n = texts.of(start), texts.count
    learned, fixed, you = np.logical_or.reduce([among(h, lexicon) for h in (word, *stems)]), among(word, insults), among(word, second)
    bad = learned | fixed
    # Words since the last and until the next second person, in the same text.
    place = np.arange(len(word))
    last = np.maximum.accumulate(np.where(you, place, -(10**9)))
    coming = np.minimum.accumulate(np.where(you, place, 10**9)[::-1])[::-1]
    first = np.searchsorted(of, of, side="left")
    final = np.searchsorted(of, of, side="right") - 1
    near = bad & (((place - last <= NEAR) & (last >= first)) | ((coming - place <= NEAR) & (coming <= final)))
    letter, upper, blank = texts.kind & LETTER > 0, texts.kind & UPPER > 0, texts.kind & SPACE > 0
    sign = ~letter & ~blank & (texts.kind & DIGIT == 0)
    text = np.repeat(np.arange(n), texts.size + 1)
    sums = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][np.stack([start, end])], axis=0)[0]
    in_word, capitals = sums(letter), sums(upper)
    # Signs or digits between two letters of a word.
    inner = np.zeros(len(letter), bool)
    if len(letter) > 2:
        inner[1:-1] = ~letter[1:-1] & ~blank[1:-1] & letter[:-2] & letter[2:] & (texts.points[1:-1] != ord("'")) & (texts.points[1:-1] != ord("-"))
    drawn = np.zeros(len(letter), bool)
    if len(letter) > 2:
        drawn[2:] = letter[2:] & (texts.low[2:] == texts.low[1:-1]) & (texts.low[1:-1] == texts.low[:-2])
    of_words = (np.ones(len(of)), learned, fixed, near, you, (in_word > 1) & (capitals == in_word), sums(inner) > 0, sums(drawn) > 0)
    of_points = (letter, upper, texts.points == ord("!"), texts.points == ord("?"), sign)
    return np.stack([per_text(of, n, m) for m in of_words] + [per_text(text, n, m) for m in of_points], axis=1), of[bad], word[bad]


FEATURES = 15


def features(texts: list[str | None], lexicon: np.ndarray, insults: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A row of 15 dense features of each text."""
    total, kinds = np.zeros((len(texts), 13)), [np.empty((2, 0), np.uint64)]
    for held, text in pieces(texts):
        counts, of, word = tallies(Texts(held), lexicon, insults, second)
        np.add.at(total, text, counts)
        kinds.append(np.unique(np.stack([text[of].astype(np.uint64), word]), axis=1))
    distinct = np.bincount(np.unique(np.concatenate(kinds, axis=1), axis=1)[0].astype(np.int64), minlength=len(texts))
    n, learned, fixed, near, you, shouted, inner, drawn, letters, upper, marks, asks, sign = total.T
    words, letters = np.maximum(n, 1), np.maximum(letters, 1)
    columns = [learned / words, np.log1p(learned), fixed / words, np.log1p(fixed), np.log1p(distinct), near / words, you / words, upper / letters]
    return np.stack([*columns, shouted / words, marks / words, asks / words, sign / words, inner / words, drawn / words, np.log1p(n)], axis=1)


def distinct_words(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct hashes of the words and beginnings of words of each text."""
    found = [np.empty(0, np.uint64)] * len(texts)
    for held, text in pieces(texts):
        batch = Texts(held)
        start, _, word, stems = plain_words(batch)
        cuts = np.searchsorted(batch.of(start), np.arange(1, batch.count))
        for k, own in zip(text.tolist(), np.split(np.stack([word, *stems], axis=1), cuts), strict=True):
            found[k] = np.unique(np.r_[found[k], own.ravel()])
    return found


#: A word of a lexicon is in so many toxic texts at least (or a hundredth of them), at so many times the rate of the others; words in a lexicon at most.
LEAST, TIMES, SIZE = 4, 40.0, 400


def lexicon_of(word: np.ndarray, held: np.ndarray, away: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Sorted hashes of the words whose counts of toxic texts (held) and of others (away) make them lexicon words."""
    good = (held >= max(LEAST, toxic // 100)) & ((held / max(1, toxic)) / ((away + 0.5) / max(1, clean)) >= TIMES)
    word, held = word[good], held[good]
    return np.sort(word[np.lexsort((word, -held))][:SIZE])


class Trees:
    """Boosted trees of a fixed depth over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 100, depth: int = 3, rate: float = 0.15, bins: int = 32, shrink: float = 1.0) -> None:
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
        self.depth, self.trees = depth, []
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        binned = self.binned(x)
        told = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-told))
            slope, curve = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            splits: list[tuple[np.ndarray, np.ndarray]] = []
            for level in range(depth):
                wide = 1 << level
                best = np.full(wide, 1e-6)
                feature, cut = np.zeros(wide, np.int64), np.full(wide, bins)
                for f in range(x.shape[1]):
                    cell = node * bins + binned[:, f]
                    g = np.bincount(cell, slope, wide * bins).reshape(wide, bins).cumsum(axis=1)
                    h = np.bincount(cell, curve, wide * bins).reshape(wide, bins).cumsum(axis=1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + shrink) + (all_g - g) ** 2 / (all_h - h + shrink) - all_g**2 / (all_h + shrink)
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(wide), at] > best
                    best = np.where(better, gain[np.arange(wide), at], best)
                    feature, cut = np.where(better, f, feature), np.where(better, at, cut)
                splits.append((feature, cut))
                node = node * 2 + (binned[np.arange(len(y)), feature[node]] > cut[node])
            leaf = -np.bincount(node, slope, 1 << depth) / (np.bincount(node, curve, 1 << depth) + shrink) * rate
            self.trees.append((splits, leaf))
            told += leaf[node]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, column, side="left") for e, column in zip(self.edges, x.T, strict=True)], axis=1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + (binned[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps through (x, y) by pooling adjacent violators: places and values to interpolate between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first place, last place
    for place, value in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([value, 1, place, place])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, end = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = end
    places = np.array([p for b in blocks for p in (b[2], b[3])])
    values = np.array([v for b in blocks for v in [b[0] / b[1]] * 2])
    return places, values


class Model:
    """A lexicon, trees over the features that it gives, and the steps that calibrate their scores."""

    def __init__(self, tables: list[np.ndarray], y: np.ndarray, part: np.ndarray, lexicon: np.ndarray) -> None:
        """tables: the features of all training texts with the lexicon of each part's others, and last with that of all; part: the part of each text."""
        self.insults, self.second, self.lexicon = hashed(INSULTS), hashed(SECOND_PERSON), lexicon
        self.trees: Trees | None = None
        if not 0 < y.sum() < len(y):
            self.steps = (np.array([0.0]), np.array([float(y.mean()) if len(y) else 0.0]))
            return
        away = np.zeros(len(y))
        for k, x in enumerate(tables[:-1]):
            train, test = np.flatnonzero(part != k), np.flatnonzero(part == k)
            if 0 < y[train].sum() < len(train):
                away[test] = Trees(x[train], y[train]).odds(x[test])
        self.steps = isotonic(away, y.astype(float))
        self.trees = Trees(tables[-1], y)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.steps[1][0])
        return np.interp(self.trees.odds(features(texts, self.lexicon, self.insults, self.second)), *self.steps)


def part_of(h: np.ndarray) -> np.ndarray:
    return h % PARTS


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` labelled rows that aren't held out."""
    rows = once(lambda: sample_texts(documents, labels, "toxic", FOLDS, HELD, sample), "sample")
    insults, second = hashed(INSULTS), hashed(SECOND_PERSON)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = distinct_words(batch.column(0).to_pylist())
            size = [len(x) for x in found]
            label, part = (np.repeat(x, size).astype(np.int32) for x in (batch.column(1).to_numpy(), part_of(batch.column(2).to_numpy())))
            word = np.concatenate(found).view(np.int64)
            for at in range(0, len(word), 100_000):
                yield pa.record_batch([pa.array(x[at : at + 100_000]) for x in (word, label, part)], names=["word", "label", "part"])

    per_part = [F.count(F.when((F.col("label") == label) & (F.col("part") == k), 1)).alias(f"n{label}{k}") for label in (1, 0) for k in range(PARTS)]
    seen = rows.mapInArrow(count, "word long, label int, part int").groupBy("word").agg(*per_part)
    seen = seen.where(sum(F.col(f"n1{k}") for k in range(PARTS)) >= LEAST).toArrow().to_pandas()
    known = rows.select("label", "h").toArrow().to_pandas()
    word, y, of = seen["word"].to_numpy().view(np.uint64), known["label"].to_numpy(), part_of(known["h"].to_numpy())
    lexicons = []
    for left_out in (*range(PARTS), None):
        some = [k for k in range(PARTS) if k != left_out]
        held, away = (seen[[f"n{label}{k}" for k in some]].to_numpy().sum(axis=1) for label in (1, 0))
        of_some = np.isin(of, some)
        lexicons.append(lexicon_of(word, held, away, int(y[of_some].sum()), int((1 - y[of_some]).sum())))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            texts = batch.column(0).to_pylist()
            found = np.concatenate([features(texts, lexicon, insults, second) for lexicon in lexicons], axis=1)
            yield pa.record_batch([batch.column(2), batch.column(1), pa.array([x.tobytes() for x in found], pa.binary())], names=["h", "label", "features"])

    told = rows.mapInArrow(tables, "h long, label int, features binary").toArrow().to_pandas().sort_values("h")
    x = np.array([np.frombuffer(b, np.float64) for b in told["features"]]).reshape(len(told), len(lexicons), FEATURES)
    discard(rows)
    return Model([x[:, k] for k in range(len(lexicons))], told["label"].to_numpy(), part_of(told["h"].to_numpy()), lexicons[-1])


def without_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """documents without the rows that score `threshold` or more, in one pass."""
    shared, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array(shared.value.scores(batch.column(at).to_pylist()) < threshold))

    return map_whole(documents, run)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")), FOLDS, HELD)
