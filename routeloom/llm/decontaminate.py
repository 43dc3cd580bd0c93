"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are compared lower-cased, with each run of blanks as one, as UTF-8 bytes. An item of m bytes may be changed by k edits,
a tenth of its length. A copy with k edits keeps m - q + 1 - k q of its q-grams, on diagonals that span k + 1 at most. So shared
q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half, bands that reach the bound are regions, and a banded alignment of
item against region decides. Items too short for the bound allow fewer edits; items shorter than q bytes are searched as they are.

The items are the query set: each block of about `block_bytes` of them goes to the tasks as a broadcast of that size, and documents are
scanned once for each block, so neither side is shuffled and no document is held against items one by one. An index is built once for
each worker and block. A text is looked at in windows that overlap by more than any item, so memory doesn't grow with a text.

Null and empty texts match nothing; null or blank items match nothing; repeated rows give a row each; repeated items count once; a null
doc_id or item_id stays null. Of several regions of an item in a text the first in order of its diagonals is told. Empty tables give an
empty result, or documents as they are. `decontaminate` carries other columns along whatever their names; `leaks` reads doc_id and text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_whole, slices, table

Q = 8
EDIT_RATE = 0.1
TABLE_BITS = 22
BLOCK_BYTES = 8_000_000
#: Bytes of text whose q-grams are looked up at once.
WINDOW = 4_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id long, item_id long, start long, length long, edits int"


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def grams_of(data: bytes) -> np.ndarray:
    """All runs of 8 bytes as numbers."""
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, strides=(1,)) if len(data) >= Q else np.empty(0, "<u8")


class Items:
    """Index of the q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], rate: float) -> None:
        self.ids = [i for i, _ in items]
        self.texts = [x for _, x in items]
        size = np.array([len(x) for x in self.texts], dtype=np.int64)
        self.edits = np.minimum((size * rate).astype(np.int64), np.maximum(0, (size - Q) // Q))
        self.bound = size - Q + 1 - self.edits * Q
        self.short = [k for k, x in enumerate(self.texts) if len(x) < Q]
        item = np.concatenate([np.full(max(0, len(x) - Q + 1), k) for k, x in enumerate(self.texts)] or [np.empty(0)]).astype(np.int64)
        place = np.concatenate([np.arange(max(0, len(x) - Q + 1)) for x in self.texts] or [np.empty(0)]).astype(np.int64)
        grams = np.concatenate([grams_of(x) for x in self.texts] or [np.empty(0, "<u8")])
        order = np.argsort(grams, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.count = np.diff(np.r_[self.first, len(grams)])
        #: What an occurrence may take with its edits, and the bands it may lie in.
        self.reach = int((size + 4 * (self.edits + 1) + Q).max()) if len(size) else 0
        self.known = np.zeros(1 << TABLE_BITS, bool)
        self.known[(self.grams * MIX) >> np.uint64(64 - TABLE_BITS)] = True

    def bands(self, data: bytes) -> np.ndarray:
        """(item, band) whose count of shared q-grams reaches the item's bound."""
        found = [self.bands_in(data[at : at + WINDOW + self.reach], at) for at in range(0, len(data), WINDOW)]
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)

    def bands_in(self, data: bytes, begin: int) -> np.ndarray:
        """The same for a window of the text that begins at a place."""
        grams = grams_of(data)
        at = np.flatnonzero(self.known[(grams * MIX) >> np.uint64(64 - TABLE_BITS)]) if len(self.grams) else np.empty(0, np.int64)
        gram = grams[at]
        k = np.minimum(np.searchsorted(self.grams, gram), max(0, len(self.grams) - 1))
        same = self.grams[k] == gram if len(at) else np.empty(0, bool)
        at, k = at[same], k[same]
        count = self.count[k]
        entry = np.repeat(self.first[k], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.item[entry]
        band = (np.repeat(at + begin, count) - self.place[entry] + (1 << 32)) // (self.edits[item] + 1)
        # A band is a cell with the next one. Counts by a hash, which are never too small, leave few cells to count truly.
        slot = (item * 0x9E3779B1 + band) & ((1 << TABLE_BITS) - 1)
        n = np.bincount(slot, minlength=(1 << TABLE_BITS) + 1)
        n[-1] = n[0]
        bound = self.bound[item]
        own = n[slot]
        maybe = (own + n[slot + 1] >= bound) | (own + n[slot - 1] >= bound)
        cell, n = np.unique((item[maybe] << 36) | band[maybe], return_counts=True)
        following = np.zeros_like(n)
        if len(cell) > 1:
            following[:-1] = np.where(cell[1:] == cell[:-1] + 1, n[1:], 0)
        good = cell[n + following >= self.bound[cell >> 36]]
        return np.stack([good >> 36, good & ((1 << 36) - 1)], axis=1)


def banded(item: np.ndarray, text: np.ndarray, shift: int, width: int, most: int, anchored: bool = False) -> tuple[int, int]:
    """Least edits that turn item into a part of text, on the diagonals shift .. shift + width - 1 (text place less item place), and the end of that part.

    The part may start anywhere in the band, or at 0 only if anchored. Gives up once more than `most` edits are certain. Places outside of the text match nothing.
    """
    far = len(item) + 1
    diagonal = np.arange(shift, shift + width)
    cost = np.where(diagonal == 0, 0, far) if anchored else np.where((diagonal >= 0) & (diagonal <= len(text)), 0, far)
    if anchored:
        cost = np.where(diagonal > 0, diagonal, cost)
    padded = np.concatenate([np.full(max(0, -shift) + len(item) + width + 1, -1, np.int16), text.astype(np.int16), np.full(len(item) + width + 1, -2, np.int16)])
    base, slope = max(0, -shift) + len(item) + width + 1 + shift, np.arange(width)
    unlike = np.lib.stride_tricks.sliding_window_view(padded, width)[base : base + len(item)] != item[:, None]
    removed = np.full(width, far)
    for i in range(len(item)):
        removed[:-1] = cost[1:] + 1
        step = np.minimum(cost + unlike[i], removed)
        cost = np.minimum.accumulate(step - slope) + slope
        if i % 8 == 7 and cost.min() > most:
            return far, 0
    inside = (diagonal + len(item) >= 0) & (diagonal + len(item) <= len(text))
    cost = np.where(inside, cost, far)
    best = int(cost.argmin())
    return int(cost[best]), int(diagonal[best]) + len(item)


def align(item: bytes, data: bytes, low: int, high: int, band: int, k: int) -> tuple[int, int, int] | None:
    """(start, length, edits) of a copy of the item in data[low:high] on a band of diagonals."""
    begin = max(low, band * (k + 1) - k)
    end = min(high, (band + 2) * (k + 1) + len(item) + k)
    exact = data.find(item, begin, end)
    if exact >= 0:
        return exact, len(item), 0
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(data[begin:end], np.uint8)
    edits, stop = banded(a, b, band * (k + 1) - k - begin, 2 * (k + 1) + 2 * k, k)
    if edits > k:
        return None
    _, length = banded(a[::-1], b[:stop][::-1], -k, 2 * k + 1, edits, anchored=True)
    return begin + stop - length, length, edits


def matches(items: Items, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(number of the text, number of the item, start, length, edits), one for each text and item that occurs in it: its first region."""
    data = b"\0\0".join(texts)
    ends = np.cumsum([len(x) + 2 for x in texts])
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k, band in items.bands(data).tolist():
        edits, size = int(items.edits[k]), len(items.texts[k])
        band -= (1 << 32) // (edits + 1)
        middle = (band + 1) * (edits + 1)
        # The middle of the region: the band's texts are those it overlaps.
        for n in {int(np.searchsorted(ends, min(max(0, x), len(data)), side="right")) for x in (middle - edits - 1, middle + size // 2, middle + size)}:
            if n >= len(texts) or (n, k) in found:
                continue
            low = int(ends[n - 1]) if n else 0
            if (hit := align(items.texts[k], data, low, low + len(texts[n]), band, edits)) is not None:
                found[n, k] = (hit[0] - low, hit[1], hit[2])
    for k in items.short:
        found |= {(n, k): (at, len(items.texts[k]), 0) for n, x in enumerate(texts) if (at := x.find(items.texts[k])) >= 0}
    return [(n, k, *hit) for (n, k), hit in sorted(found.items())]


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of about block_bytes, one at a time on the driver."""
    asked = benchmark.select(F.col("item_id").cast("long"), "text").where(F.trim("text") != "")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).distinct().collect()
        block = [(r["item_id"], normal(r["text"])) for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))]
        yield [x for x in block if x[1]]


#: The index that this worker used last, under its block's name.
INDEX: dict[str, Items] = {}


def index_of(name: str, block, rate: float) -> Items:
    if name not in INDEX:
        INDEX.clear()
        INDEX[name] = Items(block.value, rate)
    return INDEX[name]


def leaks(documents: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, length, edits): each document and item that occurs in it, with its first region in the normalized text."""

    def scan(items: list) -> DataFrame:
        name, block = uuid.uuid4().hex, documents.sparkSession.sparkContext.broadcast(items)  # of block_bytes, or one item

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = index_of(name, block, rate)
            for batch in slices(batches, 1):
                ids = batch.column(0).to_pylist()
                rows = [(ids[n], items.ids[k], *hit) for n, k, *hit in matches(items, [normal(x) for x in batch.column(1).to_pylist()])]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.int32(),), strict=True)], names=["doc_id", "item_id", "start", "length", "edits"])

        return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)

    return reduce(DataFrame.union, map(scan, item_blocks(benchmark, block_bytes)))


def decontaminate(documents: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents without the rows whose text holds an item, in one pass for each block of items and without a shuffle."""

    def clean(documents: DataFrame, items: list) -> DataFrame:
        name, block = uuid.uuid4().hex, documents.sparkSession.sparkContext.broadcast(items)  # of block_bytes, or one item

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = index_of(name, block, rate)
            for batch in slices(batches, at):
                bad = {n for n, *_ in matches(items, [normal(x) for x in batch.column(at).to_pylist()])}
                yield batch.filter(pa.array([n not in bad for n in range(batch.num_rows)], pa.bool_()))

        return map_whole(documents, run)

    at = documents.columns.index("text")
    return reduce(clean, item_blocks(benchmark, block_bytes), documents)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
