"""Exact removal of repeated byte strings by a distributed merge sort of suffixes that never compares a known prefix again.

A byte goes if it is covered by a string of `width` bytes that also starts earlier: in a document with a smaller id, or earlier in the
same. To sort all suffixes would move many times the corpus, so suffixes are sorted only where a repeat can be, in five steps:

1. Anchors. Of the GRAM-byte grams in each window of `width` bytes, the one with the least hash (the leftmost, if several) is its anchor. Equal
   windows have their anchors at the same place, so any repeat shows at anchors, which are about one in 35 bytes.
2. Anchors whose gram occurs once in the corpus are dropped; grams are dealt by their hash and counted.
3. Of each anchor left, the suffix from it (`width` bytes) and, reversed, the bytes before it that a window can reach are its context.
   Contexts are sorted into runs, one task's equal contexts as one entry, and runs are cut by a hash of the gram and front-coded: each
   entry is the length of the prefix shared with the entry before and the rest, and the rests are compressed. These runs are exchanged.
4. Each part's runs are combined by a loser tree that keeps, for each head, the prefix it shares with the last output: heads with
   different shared prefixes are ordered by these lengths alone, and others are compared from there on. What comes out is the
   sorted contexts with their shared prefixes. For each offset of a window before its anchor, contexts that agree on the bytes the
   window covers are neighbours; all but the earliest occurrence of each class are repeats.
5. The spans found are gathered by document and cut out.

Documents are shuffled once for the third step, and the same exchange serves the fifth. Occurrences of a context meet in one part as
one entry for each run that has them; a gram that very many different contexts share is the largest group that one task must hold, at
some 200 bytes for each of these contexts.

Null text is empty; documents shorter than `width` lose nothing. A null doc_id sorts last. Rows that repeat both id and text are the
same document: none counts as an earlier copy of the other, and each gets the same result. Rows that share an id but not the text are
ordered by a hash. Other columns are ignored, whatever their names. Empty input gives an empty result. Texts of any length are taken whole, in pieces that
overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, partitions_for, slices, table
from .words import mix

WIDTH = 100
GRAM = 32
#: Bytes that are hashed at once; places in it must fit in PLACE_BITS.
PIECE, PLACE_BITS = 1_000_000, 24
#: Contexts in a run at most.
RUN = 100_000
PARTS_A_TASK = 4
LAST = np.iinfo(np.int64).max
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h, base, n = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while n < GRAM:
        h = h[:-n] * np.uint64(pow(base, n, 2**64)) + h[n:]
        n *= 2
    return mix(h)


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    n = 1
    while 2 * n <= size:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (size - n)], x[size - n :]) if n < size else x


def anchors(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and gram hash of the anchors of all windows of each text."""
    none = np.empty(0, np.int64)
    pieces = [(k, at, x[at : at + PIECE + width - 1]) for k, x in enumerate(texts) for at in range(0, len(x) - width + 1, PIECE)]
    out, held, size = [], [], 0
    for n, piece in enumerate(pieces):
        held.append(piece)
        size += len(piece[2])
        if size + len(pieces[min(n + 1, len(pieces) - 1)][2]) < 2 * PIECE and n + 1 < len(pieces):
            continue
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        lengths = np.array([len(x) for _, _, x in held])
        begin = np.cumsum(lengths) - lengths
        hashed = gram_hashes(data)
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = sliding_least((hashed & ~low) | np.arange(len(hashed), dtype=np.uint64), width - GRAM + 1)
        valid = np.ones(len(least), bool)
        for end in (begin + lengths)[:-1].tolist():
            valid[end - width + 1 : end] = False
        place = (least[valid] & low).astype(np.int64)
        place = place[np.r_[True, place[1:] != place[:-1]]]
        which = np.searchsorted(begin, place, side="right") - 1
        out.append((np.array([k for k, _, _ in held])[which], place - begin[which] + np.array([a for _, a, _ in held])[which], hashed[place]))
        held, size = [], 0
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none.astype(np.uint64))


def by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs and the places of its rows, in their order."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, order[cuts[p] : cuts[p + 1]]


def find_anchors(parts: int, width: int):
    """Step 1: blobs of (hash, document, place) by part of the hash."""

    def flush(held: list) -> pa.RecordBatch:
        keys = np.concatenate([k for k, _, _ in held])
        places, hashed = np.concatenate([p for _, p, _ in held]), np.concatenate([h for _, _, h in held])
        rows = [(p, hashed[at].tobytes(), keys[at].tobytes(), places[at].astype(np.uint32).tobytes()) for p, at in by_part((hashed % np.uint64(parts)).astype(np.int64), parts)]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["part", "hashes", "keys", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "data"):
            text, place, hashed = anchors([x or b"" for x in batch.column("data").to_pylist()], width)
            if len(text):
                held.append((batch.column("key").to_numpy()[text], place, hashed))
                size += len(text)
            if size > 1_000_000:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)
        give_back()

    return run


def deal(keys: np.ndarray, values: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows of values by part of their document's key: the keys, how many rows each has, and the rows."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    rows = []
    for p, at in by_part((mix(keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int64), parts):
        some, n = np.unique(keys[at], return_counts=True)
        rows.append((p, some.tobytes(), n.astype(np.uint32).tobytes(), values[at].tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["part", "keys", "counts", "rows"])


DEALT = "part int, keys binary, counts binary, rows binary"


def regroup(width: int, kind: str, some: int = 10_000):
    """One row for each key, with all of its rows of `width` numbers, from what `deal` sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = [], []
        for batch in batches:
            for k, n, r in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts", "rows")), strict=True):
                keys.append(np.repeat(np.frombuffer(k, np.int64), np.frombuffer(n, np.uint32)))
                rows.append(np.frombuffer(r, kind).reshape(-1, width))
        if not keys:
            return
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[first[1:], len(key)]
        for at in range(0, len(first), some):
            spans = zip(first[at : at + some].tolist(), ends[at : at + some].tolist(), strict=True)
            yield pa.record_batch([pa.array(key[first[at : at + some]]), pa.array([row[a:b].tobytes() for a, b in spans], pa.binary())], names=["key", "rows"])

    return run


def find_repeated(parts: int):
    """Step 2: the places of each document whose gram occurs more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, keys, places = [], [], []
        for batch in batches:
            for h, k, p in zip(*(batch.column(c).to_pylist() for c in ("hashes", "keys", "places")), strict=True):
                hashed.append(np.frombuffer(h, np.uint64))
                keys.append(np.frombuffer(k, np.int64))
                places.append(np.frombuffer(p, np.uint32))
        if not hashed:
            return
        h, k, p = np.concatenate(hashed), np.concatenate(keys), np.concatenate(places)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        often = order[np.r_[same, False] | np.r_[False, same]]
        yield deal(k[often], p[often], parts)

    return run


def shared_prefix(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before (the first: 0)."""
    if not len(rows):
        return np.empty(0, np.int64)
    differs = rows[1:] != rows[:-1]
    return np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])]


def byte_order(rows: np.ndarray) -> np.ndarray:
    """Stable order of rows of bytes."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}")[:, 0], kind="stable")


def contexts(data: bytes, places: np.ndarray, width: int) -> np.ndarray:
    """For each place: `width` bytes from it, the bytes before it reversed, and how many there are of both."""
    back = width - GRAM
    padded = np.frombuffer(bytes(back) + data + bytes(width), np.uint8)
    out = np.empty((len(places), width + back + 2), np.uint8)
    views = np.lib.stride_tricks.sliding_window_view(padded, width + back)
    whole = views[places]
    out[:, :width] = whole[:, back:]
    out[:, width : width + back] = whole[:, :back][:, ::-1]
    out[:, -2] = np.minimum(width, len(data) - places)
    out[:, -1] = np.minimum(back, places)
    return out


def sorted_runs(parts: int, width: int):
    """Step 3: front-coded sorted runs of contexts, by part of the gram."""

    def flush(held: list) -> pa.RecordBatch | None:
        rows = np.concatenate([c for _, _, c, _ in held])
        size = [len(p) for _, _, _, p in held]
        ids, keys = np.array([i for i, _, _, _ in held], np.int64), np.array([k for _, k, _, _ in held], np.int64)
        document, place = np.repeat(np.arange(len(held)), size), np.concatenate([p for _, _, _, p in held])
        # Earliest first; equal contexts keep this order.
        early = np.lexsort((place, keys[document], ids[document]))
        rows, document, place = rows[early], document[early], place[early]
        grams = np.ascontiguousarray(rows[:, :GRAM]).view("<u8")
        hashed = mix(grams @ np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(GRAM // 8)], np.uint64))
        out = []
        for p, at in by_part((hashed % np.uint64(parts)).astype(np.int64), parts):
            at = at[byte_order(rows[at])]
            prefix = shared_prefix(rows[at])
            new = prefix < rows.shape[1]
            new[0] = True
            first = np.flatnonzero(new)
            entries, prefix = rows[at[first]], prefix[first]
            rest = entries[np.arange(rows.shape[1]) >= prefix[:, None]].tobytes()
            used, local = np.unique(document[at], return_inverse=True)
            out.append((p, prefix.astype(np.uint8).tobytes(), pa.Codec("zstd").compress(rest, asbytes=True), np.diff(np.r_[first, len(at)]).astype(np.uint32).tobytes(), local.astype(np.uint32).tobytes(), place[at].astype(np.uint32).tobytes(), np.stack([ids[used], keys[used]]).tobytes()))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 6), strict=True)], names=["part", *RUN_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "data"):
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "key", "data", "rows"))
            for doc_id, key, data, found in zip(*columns, strict=True):
                if not found:
                    continue
                places = np.unique(np.frombuffer(found, np.uint32)).astype(np.int64)
                for at in range(0, len(places), RUN):
                    some = places[at : at + RUN]
                    held.append((LAST if doc_id is None else doc_id, key, contexts(data, some, width), some))
                    size += len(some)
                    if size >= RUN:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)
        give_back()

    return run


RUN_COLUMNS = ("prefixes", "rests", "counts", "documents", "places", "keys")


class Run:
    """A front-coded run; `entry` is the head's number, `key` its bytes, None behind the last."""

    def __init__(self, prefixes: bytes, rests: bytes, size: int) -> None:
        unfolded = size * len(prefixes) - int(np.frombuffer(prefixes, np.uint8).sum(dtype=np.int64))
        self.prefixes, self.size = prefixes, size
        self.rests = pa.Codec("zstd").decompress(rests, unfolded, asbytes=True)
        self.entry, self.at, self.key = -1, 0, b""

    def step(self) -> int:
        """Go to the next entry; the prefix it shares with the one before."""
        self.entry += 1
        if self.entry == len(self.prefixes):
            self.key = None
            return 0
        shared = self.prefixes[self.entry]
        end = self.at + self.size - shared
        self.key = self.key[:shared] + self.rests[self.at : end]
        self.at = end
        return shared


def first_difference(a: bytes, b: bytes, at: int) -> int:
    while a[at : at + 16] == b[at : at + 16]:
        at += 16
        if at >= len(a):
            return len(a)
    while a[at] == b[at]:
        at += 1
    return at


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, entry, prefix shared with the output before, bytes) in order.

    `known[r]` is the prefix that the head of run r shares with the last output. Of two heads the one that shares more is the smaller,
    and the loser's length stays right; if both share the same, they are compared from there on, and the loser shares with the winner
    what was found equal. Equal heads come in the order of their runs.
    """
    n = len(runs)
    known = [r.step() for r in runs]
    loser = [-1] * n

    def climb(r: int) -> int:
        """Play run r up its path; the winner of all, or -1 while a node waits for its other player."""
        node = (r + n) >> 1
        while node:
            o = loser[node]
            if o < 0:
                loser[node] = r
                return -1
            a, b = runs[r].key, runs[o].key
            if a is None:
                wins = False
            elif b is None:
                wins = True
            elif known[r] != known[o]:
                wins = known[r] > known[o]
            else:
                d = first_difference(a, b, known[r])
                wins = r < o if d == len(a) else a[d] < b[d]
                known[o if wins else r] = d
            if not wins:
                loser[node], r = r, o
            node >>= 1
        return r

    best = -1
    for r in range(n):
        best = climb(r)
    while best >= 0 and runs[best].key is not None:
        run = runs[best]
        yield best, run.entry, known[best], run.key
        known[best] = run.step()
        best = climb(best)


def classify(rows: np.ndarray, prefix: np.ndarray, rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For the earliest occurrence of each sorted context, the farthest and the nearest window start before the anchor that is a repeat (-1: none).

    rank orders the contexts' earliest occurrences.
    """
    n, back = len(rows), width - GRAM
    ahead, behind = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    left = rows[:, width : width + back]
    order = byte_order(left)
    left_prefix = np.empty(n, np.int64)
    left_prefix[:] = shared_prefix(left[order])
    far, near = np.full(n, -1), np.full(n, -1)
    early = np.argsort(rank)
    for offset in range(back + 1):
        right_class = np.cumsum(prefix < width - offset)
        left_class = np.empty(n, np.int64)
        left_class[order] = np.cumsum(left_prefix < offset)
        some = early[(behind[early] >= offset) & (ahead[early] >= width - offset)]
        both = right_class[some] * (n + 1) + left_class[some]
        by = np.argsort(both, kind="stable")
        later = some[by[1:][both[by][1:] == both[by][:-1]]]
        far[later] = offset
        near[later] = np.where(near[later] < 0, offset, near[later])
    return far, near


def part_spans(blobs: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step 4 for one part: key of the document, start and end of the repeated spans."""
    size = 2 * width - GRAM + 2
    runs, counts, occurrences = [], [], []
    for prefixes, rests, n, documents, places, keys in blobs:
        ids, key = np.frombuffer(keys, np.int64).reshape(2, -1)
        document = np.frombuffer(documents, np.uint32)
        runs.append(Run(prefixes, rests, size))
        counts.append(np.frombuffer(n, np.uint32).astype(np.int64))
        occurrences.append((ids[document], key[document], np.frombuffer(places, np.uint32).astype(np.int64)))
    base = np.cumsum([len(c) for c in counts]) - [len(c) for c in counts]
    number = np.zeros(sum(map(len, counts)), np.int64)  # of the distinct context, for each entry of each run
    data, prefix = bytearray(), []
    for r, entry, shared, key in merge(runs):
        if shared < size or not prefix:
            data += key
            prefix.append(shared if prefix else 0)
        number[base[r] + entry] = len(prefix) - 1
    rows = np.frombuffer(data, np.uint8).reshape(-1, size)
    context = np.repeat(number, np.concatenate(counts))
    ids, key, place = (np.concatenate(x) for x in zip(*occurrences, strict=True))
    order = np.lexsort((place, key, ids, context))
    context, key, place, ids = context[order], key[order], place[order], ids[order]
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    rank = np.empty(len(rows), np.int64)
    rank[np.lexsort((place[first], key[first], ids[first]))] = np.arange(len(rows))
    far, near = classify(rows, np.array(prefix), rank, width)
    ahead, behind = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    # Later occurrences of a context repeat all of its windows, unless they are a repeated row.
    later = np.ones(len(context), bool)
    later[first] = False
    later &= (key != key[first][context]) | (place != place[first][context])
    later &= (ahead + behind >= width)[context]
    some = far >= 0
    return (
        np.r_[key[first][some], key[later]],
        np.r_[place[first][some] - far[some], place[later] - behind[context[later]]],
        np.r_[place[first][some] - near[some] + width, place[later] + ahead[context[later]]],
    )


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[new[1:], True]]


def find_spans(parts: int, width: int):
    """Step 4: spans of each document, from the runs of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for p, *blob in zip(*(batch.column(c).to_pylist() for c in ("part", *RUN_COLUMNS)), strict=True):
                held.setdefault(p, []).append(tuple(blob))
        while held:
            key, start, end = part_spans(held.popitem()[1], width)
            found.append((key, np.stack([start, end], axis=1)))
            give_back()
        if found:
            yield deal(np.concatenate([k for k, _ in found]), np.concatenate([r for _, r in found]), parts)

    return run


def spans_of(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    spans = np.frombuffer(blob or b"", np.int64).reshape(-1, 2)
    return merged(spans[:, 0], spans[:, 1])


def kept_bytes(data: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True))


def repeated_spans(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each row as (doc_id, data, spans): its bytes and a blob of its repeated spans (see `spans_of`)."""
    if not 2 * GRAM <= width <= 255:
        raise ValueError(f"width must be from {2 * GRAM} to 255")
    # More parts than tasks: a task holds its parts front-coded, and unfolds one at a time.
    tasks = partitions_for(documents)
    parts = PARTS_A_TASK * tasks
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    found = rows.where(F.octet_length("data") >= width).select("key", "data").mapInArrow(find_anchors(tasks, width), "part int, hashes binary, keys binary, places binary")
    often = found.repartition(tasks, "part").mapInArrow(find_repeated(tasks), DEALT)
    places = often.repartition(tasks, "part").mapInArrow(regroup(1, "u4"), "key long, rows binary")
    runs = rows.join(places.hint("shuffle_hash"), "key", "left").mapInArrow(sorted_runs(parts, width), "part int, " + ", ".join(f"{c} binary" for c in RUN_COLUMNS))
    spans = runs.repartition(tasks, "part").mapInArrow(find_spans(tasks, width), DEALT)
    gathered = spans.repartition(tasks, "part").mapInArrow(regroup(2, "i8"), "key long, rows binary")
    return rows.join(gathered.hint("shuffle_hash"), "key", "left").select("doc_id", "data", F.col("rows").alias("spans"))


def dedup(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row; kept is the bytes left, which may cut a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data"):
            out = []
            for doc_id, data, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "spans")), strict=True):
                start, end = spans_of(blob)
                kept = kept_bytes(data, start, end)
                out.append((doc_id, len(data), len(data) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return repeated_spans(documents, width).mapInArrow(run, RESULT + ", kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
