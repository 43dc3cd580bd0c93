"""Language identification of whole texts, with spans of mixed languages.

Each language is learned as the frequencies of the letter trigrams of its words, hashed to one of TRIGRAMS numbers, and as the scripts
its letters stand in. Words are runs of letters. A word's scripts narrow its candidates to the languages that use all of them, or any
of them where none uses all; those left get the log frequency of the word's trigrams, less the best one's. Viterbi over the words, with
a penalty for each switch, labels spans; a text's language is the one whose spans hold most letters, and the score is its share of the
letters of words that have candidates. There is no bound on languages or letters; equal languages go to the first by name.

Viterbi runs over segments of SEGMENT words at once, for every language before the segment, and the segments are then joined, which
gives the same path as going word by word. Very long texts are looked at in pieces (`words.pieces`, smaller with more languages), each
with a path of its own, so memory doesn't grow with a text.

Null text and text without a letter give `und` and score 0. A text in scripts that no learned language uses gets the language of most
training rows, with score 0. The model is fitted on a bounded sample (`sample` rows, their texts whole) of the rows that aren't held
out; trigrams are counted by the executors, and a table of TRIGRAMS numbers for each language comes to the driver. Without training
rows all is `und`. Repeated rows are judged each, alike; null languages aren't learned from; a null doc_id stays null. Empty tables
give an empty result. Columns besides doc_id, text and lang aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, slices, table
from .words import LETTER, Texts, pieces

FOLDS, HELD = 4, 2
SAMPLE = 3000
SWITCH = 6.0
SEGMENT = 128
FLOOR = -12.0
SMOOTHING = 0.5
TRIGRAM_BITS = 17
TRIGRAMS = 1 << TRIGRAM_BITS
#: Characters times languages that are scored at once.
CELLS = 4_000_000

# Where ranges of letters of one script start (Unicode blocks), and the script; "" where there is none to tell.
SCRIPT_STARTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0B80, 0x0C00, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000)
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "", "devanagari", "bengali", "indic", "tamil", "indic", "thai", "", "georgian", "hangul", "ethiopic", "latin", "greek", "", "hiragana", "katakana", "", "han", "", "hangul", "", "han", "", "han")
#: Number of each named script; a word's scripts are bits of a number.
NAMED = {s: k for k, s in enumerate(sorted(set(SCRIPTS) - {""}))}


def script_bits(points: np.ndarray) -> np.ndarray:
    """The script of each code point as a bit; 0 where there is none to tell."""
    bits = np.array([1 << NAMED[s] if s else 0 for s in SCRIPTS], np.int64)
    return bits[np.searchsorted(SCRIPT_STARTS, points, side="right") - 1]


def trigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The number of the trigram around each place, no letter being like any other, and which places are letters."""
    letter = texts.kind & LETTER > 0
    around = np.zeros(len(letter) + 2, np.uint32)
    around[1:-1] = np.where(letter, texts.low, 0)
    mixed = (around[:-2] * np.uint32(0x9E3779B1) ^ around[1:-1]) * np.uint32(0x85EBCA77) ^ around[2:]
    return (mixed * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - TRIGRAM_BITS), letter


def counts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often texts have each trigram, and letters of each named script."""
    grams, scripts = np.zeros(TRIGRAMS, np.int64), np.zeros(len(NAMED), np.int64)
    for held, _ in pieces(texts):
        batch = Texts(held)
        gram, letter = trigrams(batch)
        grams += np.bincount(gram[letter], minlength=TRIGRAMS)
        bits = script_bits(batch.low[letter])
        scripts += [np.count_nonzero(bits == 1 << k) for k in range(len(NAMED))]
    return grams, scripts


class Model:
    """Languages in order; `logs` has the log frequency of each trigram in each language, `uses` which named scripts a language uses, `usual` the language of most rows."""

    def __init__(self, known: list[tuple[str, int, np.ndarray, np.ndarray]]) -> None:
        """known: language, rows and counts (see `counts_of`) of each language."""
        known = sorted(known, key=lambda x: x[0])
        self.languages = [lang for lang, *_ in known]
        self.usual = min(known, key=lambda x: (-x[1], x[0]))[0] if known else "und"
        counts = np.array([grams for *_, grams, _ in known], np.float32).reshape(len(known), TRIGRAMS)
        total = counts.sum(axis=1, keepdims=True) + SMOOTHING * TRIGRAMS
        self.logs = np.ascontiguousarray(np.log((counts + SMOOTHING) / total).T.astype(np.float32))
        scripts = np.array([own for *_, own in known], np.int64).reshape(len(known), len(NAMED))
        # A script that only a few stray words use isn't the language's.
        self.uses = (scripts > 0) & (scripts * 20 >= scripts.sum(axis=1, keepdims=True))

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> Model:
        own = {lang: [t for t, x in rows if x == lang] for _, lang in rows}
        return cls([(lang, len(texts), *counts_of(texts)) for lang, texts in own.items()])

    def candidates(self, bits: np.ndarray) -> np.ndarray:
        """Which languages may own a word with letters of these scripts."""
        kinds, back = np.unique(bits, return_inverse=True)
        has = (kinds[:, None] >> np.arange(len(NAMED))) & 1 == 1
        of_all = (has[:, None, :] <= self.uses[None]).all(axis=2) & (kinds > 0)[:, None]
        of_any = (has[:, None, :] & self.uses[None]).any(axis=2)
        return np.where(of_all.any(axis=1, keepdims=True), of_all, of_any)[back.reshape(-1)]

    def scores(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word (run of letters) its scores by language, its letters that have a candidate, start and end."""
        gram, letter = trigrams(texts)
        start, end = texts.runs(letter)
        kinds = len(self.languages)
        if not kinds or not len(start):
            return np.zeros((len(start), kinds), np.float32), np.zeros(len(start), np.int64), start, end
        at = np.flatnonzero(letter)
        first = np.cumsum(end - start) - (end - start)
        told = np.add.reduceat(self.logs[gram[at]], first, axis=0)
        candidate = self.candidates(np.bitwise_or.reduceat(script_bits(texts.low[at]), first))
        some = candidate.any(axis=1)
        best = np.where(candidate, told, -np.inf).max(axis=1, keepdims=True)
        score = np.where(candidate, np.maximum(told - np.where(np.isfinite(best), best, 0), FLOOR), FLOOR)
        score[~some] = 0
        return score.astype(np.float32), np.where(some, end - start, 0), start, end


def viterbi(score: np.ndarray, lengths: np.ndarray, penalty: float, segment: int = SEGMENT) -> np.ndarray:
    """Best language of each word; score (words, languages) of texts one after the other, lengths their words."""
    words, kinds = score.shape
    out = np.zeros(words, np.int64)
    if not words:
        return out
    begin = np.cumsum(lengths) - lengths
    parts = -(-lengths // segment)
    text = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = begin[text] + nth * segment
    size = np.minimum(segment, begin[text] + lengths[text] - start)
    steps = int(size.max())
    at = start[:, None] + np.arange(steps)
    live = np.arange(steps) < size[:, None]
    live = np.ascontiguousarray(live.T)
    # Segments come last in all that follows, so that each step works on long rows.
    flat = np.ascontiguousarray(score.T)
    where = np.minimum(at, words - 1).T
    cells = np.where(live[:, None, :], flat[:, where].transpose(1, 0, 2), 0).astype(np.float32)
    # best[language before the segment, language now, segment]
    best = np.where(np.eye(kinds, dtype=bool), 0, -penalty).astype(np.float32)[:, :, None] + cells[0][None]
    came = np.empty((steps, kinds, len(start)), np.int32)
    stay = np.empty((steps, kinds, kinds, len(start)), bool)
    for t in range(1, steps):
        top = best.max(axis=1)
        came[t] = 0
        for k in range(1, kinds):
            came[t][best[:, k] == top] = k
        jump = (top - np.float32(penalty))[:, None]
        np.greater_equal(best, jump, out=stay[t])
        np.logical_or(stay[t], ~live[t], out=stay[t])
        np.maximum(best, np.where(live[t], jump, best.min() - 1), out=best)
        best += cells[t]
    best = best.transpose(2, 0, 1)
    # Join the segments of each text.
    before = np.zeros((len(start), kinds), np.int64)
    reach = np.zeros((len(lengths), kinds), np.float32)
    for r in range(int(parts.max())):
        here = np.flatnonzero(nth == r)
        through = reach[text[here], :, None] + best[here]
        before[here] = through.argmax(axis=1)
        reach[text[here]] = through.max(axis=1)
    entry, state = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    last = reach.argmax(axis=1)
    for r in range(int(parts.max()) - 1, -1, -1):
        here = np.flatnonzero(nth == r)
        state[here] = last[text[here]]
        entry[here] = before[here, state[here]]
        last[text[here]] = entry[here]
    rows = np.arange(len(start))
    for t in range(steps - 1, -1, -1):
        on = live[t]
        out[at[on, t]] = state[on]
        if t:
            state = np.where(stay[t, entry, state, rows] | ~on, state, came[t, entry, rows])
    return out


def label(model: Model, texts: list[str], penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Texts]:
    """Language, letters, start and end of each word of the texts."""
    batch = Texts(texts)
    score, letters, start, end = model.scores(batch)
    lengths = np.bincount(batch.of(start), minlength=batch.count)
    return viterbi(score, lengths, penalty) if len(model.languages) else np.zeros(len(start), np.int64), letters, start, end, batch


def piece_size(model: Model) -> int:
    return max(20_000, CELLS // max(4, len(model.languages)))


def judge(model: Model, texts: list[str | None], penalty: float = SWITCH) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    kinds = max(1, len(model.languages))
    held, words = np.zeros((len(texts), kinds)), np.zeros(len(texts))
    for some, text in pieces(texts, piece_size(model)):
        own, letters, start, _, batch = label(model, some, penalty)
        of = text[batch.of(start)]
        held += np.bincount(of * kinds + own, weights=letters, minlength=held.size).reshape(held.shape)
        words += np.bincount(of, minlength=len(texts))
    return [(model.languages[int(h.argmax())], float(h.max() / h.sum())) if h.sum() > 0 else (model.usual, 0.0) if n else ("und", 0.0) for h, n in zip(held, words, strict=True)]


def spans(model: Model, text: str | None, penalty: float = SWITCH) -> list[tuple[int, int, str]]:
    """(start, end, language) of the runs of words of one language; words without candidates belong to the run they stand in."""
    out: list[tuple[int, int, str]] = []
    before = 0
    for some, _ in pieces([text], piece_size(model)):
        own, letters, start, end, _ = label(model, some, penalty)
        if letters.sum():
            for a, b, k in zip((start + before).tolist(), (end + before).tolist(), own.tolist(), strict=True):
                lang = model.languages[k]
                if out and out[-1][2] == lang:
                    out[-1] = (out[-1][0], b, lang)
                else:
                    out.append((a, b, lang))
        before += sum(map(len, some))
    return out


COUNTED = "lang string, texts long, grams binary, scripts binary"


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` rows that aren't held out, picked by a hash; repeated rows count once."""
    rows = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~fold(F.col("doc_id"), FOLDS, HELD)).select("text", "lang", F.xxhash64("doc_id", "text", "lang").alias("h"))
    top = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if top is None:
        return Model([])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                grams, scripts = counts_of(own)
                some = np.flatnonzero(grams)
                yield pa.record_batch([pa.array([lang], pa.string()), pa.array([len(own)], pa.int64()), pa.array([np.stack([some, grams[some]]).tobytes()], pa.binary()), pa.array([scripts.tobytes()], pa.binary())], names=["lang", "texts", "grams", "scripts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A language's counts as a dense table: of fixed size for each language.
        held: dict[str, list] = {}
        for batch in batches:
            for lang, texts, grams, scripts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = held.setdefault(lang, [0, np.zeros(TRIGRAMS, np.int64), np.zeros(len(NAMED), np.int64)])
                at, n = np.frombuffer(grams, np.int64).reshape(2, -1)
                own[0] += texts
                own[1][at] += n
                own[2] += np.frombuffer(scripts, np.int64)
        for lang, (texts, grams, scripts) in held.items():
            yield pa.record_batch([pa.array([lang], pa.string()), pa.array([texts], pa.int64()), pa.array([grams.astype(np.float32).tobytes()], pa.binary()), pa.array([scripts.tobytes()], pa.binary())], names=["lang", "texts", "grams", "scripts"])

    counted = rows.where(F.col("h") <= F.lit(top)).dropDuplicates(["h"]).select("text", "lang").mapInArrow(count, COUNTED)
    told = counted.repartition("lang").mapInArrow(add, COUNTED).toArrow().to_pylist()
    return Model([(r["lang"], r["texts"], np.frombuffer(r["grams"], np.float32), np.frombuffer(r["scripts"], np.int64)) for r in told])


def predict(documents: DataFrame, model: Model, penalty: float = SWITCH) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(model)  # as large as its trigrams, not as the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches, 1):
            told = judge(m, batch.column(1).to_pylist(), penalty)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([x for x, _ in told], pa.string()), pa.array([s for _, s in told], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long"), "text", fold(F.col("doc_id"), FOLDS, HELD).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predict(documents, fit(documents.select("doc_id", "text", "lang")))
