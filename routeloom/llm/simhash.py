"""SimHash near-duplicates found through a hierarchical index in Gray order.

Fingerprints whose distance is at most k agree in some of the masks of a family (all choices of m - k out of m bit segments), so rows
are dealt by (mask, bits under the mask). Within such a group the fingerprints are sorted by their Gray rank, which brings those with
few differing bits together; runs of them are factored into nodes that hold the bits shared by all below, each bit in the uppermost
node it is shared in. A query goes down the tree, adds up its differences from the shared bits and leaves out whole groups once the
sum exceeds the limit. Members that are linked already are left out as well, so that a large group of copies costs one pass and gives
one link for each member, not all pairs. What goes on is a forest of links, and components are built by rounds of joins.

A task takes the groups one after the other, some at a time; the largest that it must hold is the distinct fingerprints that share the bits
of one mask, at 8 bytes each. Joins on fingerprints, sets and components are salted, as copies may be most of the rows.

Columns besides doc_id and text are ignored by `fingerprints`, and carried along by `keep_one` whatever their names. Null text counts
as text without words. Repeated rows and equal texts share a fingerprint. A null doc_id gets a row with a null id; it is never the
smallest of its component unless all are null. Empty input gives an empty result. Words and texts of any length are taken whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, named, once, salted_join, slices, table, unused
from .components import components, smallest_label

WORD_BITS = 64
FAN_OUT = 8
#: Query-leaf pairs that a block of queries may meet at most, so that memory stays bounded.
BLOCK_PAIRS = 2_000_000
PACK = ">u8"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.split() takes exactly the blanks x20 and x09-x0D."""
    return (text or b"").lower().split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of `size` words joined by a blank; fewer words are one run."""
    if not words:
        return []
    flat, count = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: count - 1]])
    return list(map(flat.__getitem__, map(slice, starts.tolist(), (ends[min(size, len(words)) - 1 :] - 1).tolist())))


def hashes(items: list[bytes], seed: int = 42) -> np.ndarray:
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), items), dtype=np.uint64, count=len(items))


def majority(rows: np.ndarray) -> bytes:
    """Bits that are set in more than half of the rows of uint64 words."""
    n, width = rows.shape
    if not n:
        return bytes(8 * width)
    total = np.zeros(WORD_BITS * width, np.int64)
    for at in range(0, n, 255):
        bits = np.unpackbits(rows[at : at + 255].astype(PACK).view(np.uint8).reshape(-1, 8 * width), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > n).tobytes()


def spread(h: np.ndarray, width: int) -> np.ndarray:
    """`width` independent 64-bit values from each hash."""
    out = np.empty((len(h), width), np.uint64)
    for k in range(width):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(text: bytes | None, size: int = 4, seed: int = 42) -> bytes:
    return majority(hashes(shingles(words_of(text), size), seed).reshape(-1, 1))


def fingerprints(documents: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            prints = b"".join(fingerprint(x, size, seed) for x in batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(np.frombuffer(prints, PACK).astype(np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of a code in the reflected Gray sequence."""
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def forest(group: np.ndarray, code: np.ndarray, limit: int, confirm: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (item, smallest item of its component) among the codes of each group that differ in `limit` bits at most.

    group and code are aligned; confirm(a, b) may turn down pairs of items. The tree has the same height for all groups.
    """
    n = len(code)
    order = np.lexsort((gray_rank(code), group))
    group, code = group[order], code[order]
    first = np.r_[True, group[1:] != group[:-1]] if n else np.empty(0, bool)
    # Levels from the leaves up: start of each node among the nodes below, and the bits that all of its leaves share.
    opens, shared, pattern, leaf_end = [], [np.full(n, ~np.uint64(0))], [code], [np.arange(1, n + 1)]
    head = first
    low, high = code, code
    while not head.all():
        begin = np.flatnonzero(head)
        place = np.arange(len(head)) - np.repeat(begin, np.diff(np.r_[begin, len(head)]))
        start = np.flatnonzero(place % FAN_OUT == 0)
        opens.append(start)
        low, high = np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start)
        shared.append(~(low ^ high))
        pattern.append(low)
        leaf_end.append(np.r_[leaf_end[-1][start[1:] - 1], leaf_end[-1][-1]])
        head = head[start]
    own = [s.copy() for s in shared]  # bits that the node above doesn't hold yet
    for k, start in enumerate(opens):
        above = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(own[k])]))
        own[k] &= ~shared[k + 1][above]
    label = np.arange(n)
    root = np.cumsum(first) - 1
    sizes = np.bincount(root, minlength=1)[root] if n else np.empty(0, np.int64)
    block = np.cumsum(sizes) // BLOCK_PAIRS
    cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, n] if n else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        least, most = [label], [label]
        for start in opens:
            least.append(np.minimum.reduceat(least[-1], start))
            most.append(np.maximum.reduceat(most[-1], start))
        query = np.arange(a, b)
        query = query[sizes[a:b] > 1]
        node, differs = root[query], np.zeros(len(query), np.int64)
        for k in range(len(shared) - 1, -1, -1):
            differs = differs + np.bitwise_count((code[query] ^ pattern[k][node]) & own[k][node])
            linked = (least[k][node] == label[query]) & (most[k][node] == label[query])
            keep = (differs <= limit) & ~linked & (leaf_end[k][node] > query + 1)
            query, node, differs = query[keep], node[keep], differs[keep]
            if not k:
                break
            start = opens[k - 1]
            count = np.diff(np.r_[start, len(shared[k - 1])])[node]
            ahead = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            query, node, differs = np.repeat(query, count), np.repeat(start[node], count) + ahead, np.repeat(differs, count)
        if confirm is not None and len(query):
            good = confirm(order[query], order[node])
            query, node = query[good], node[good]
        if len(query):
            label = smallest_label(n, query, node, label)
    joined = np.flatnonzero(label != np.arange(n))
    return order[joined], order[label[joined]]


def segment_masks(limit: int, items: int) -> list[int]:
    """All masks that leave out `limit` of m bit segments: codes within the limit agree under one at least. m grows with the items, so that groups stay small."""
    m = limit + 1
    while m < limit + 4 and 2 ** (WORD_BITS * (m - limit) // m) * 4096 < items:
        m += 1
    ends = [WORD_BITS * k // m for k in range(m + 1)]
    parts = [sum(1 << b for b in range(x, y)) for x, y in zip(ends, ends[1:], strict=False)]
    return [sum(p) for p in combinations(parts, m - limit)]


def signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


#: Rows of whole groups that a task works on at once, unless one group has more.
CHUNK_ROWS = 100_000


def masked(items: DataFrame, code: str, masks: list[int]) -> DataFrame:
    """A row for each item and mask, dealt and sorted by the masked bits."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col(code).bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks)]))
    return items.select("*", keys.alias("m")).select(*items.columns, "m.t", "m.key").repartition("t", "key").sortWithinPartitions("t", "key")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole groups, and the number of each row's group."""

    def numbered(rows: pa.Table) -> np.ndarray:
        columns = [rows.column(k).to_numpy() for k in keys]
        return np.cumsum(np.r_[0, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < CHUNK_ROWS:
            continue
        rows = pa.Table.from_batches(held)
        group = numbered(rows)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield rows.slice(0, cut), group[:cut]
            held = rows.slice(cut).to_batches()
            size -= cut
    if size:
        rows = pa.Table.from_batches(held)
        yield rows, numbered(rows)


def links(codes: DataFrame, limit: int = 4) -> DataFrame:
    """Forest links (a, b) between the distinct codes of column fp that differ in `limit` bits at most."""
    codes = materialize(codes.select("fp").distinct(), "codes")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, ["t", "key"]):
            fp = rows.column("fp").to_numpy()
            a, b = forest(group, fp.view(np.uint64), limit)
            if len(a):
                pairs = np.unique(np.stack([fp[a], fp[b]], axis=1), axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return masked(codes, "fp", segment_masks(limit, codes.count())).mapInArrow(search, "a long, b long")


def near_duplicates(documents: DataFrame, limit: int = 4, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of documents; component_id is the smallest doc_id of the component."""
    prints = materialize(fingerprints(documents, size, seed), "prints")

    def told() -> DataFrame:
        found = components(links(prints, limit))
        of = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(found.select(F.col("node").alias("fp"), "component"), "fp", "left"), "of")
        linked = of.where(F.col("component").isNotNull())
        least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
        apart = of.where(F.col("component").isNull()).select("fp", F.col("least").alias("component_id"))
        return salted_join(linked, least, ["component"]).select("fp", "component_id").union(apart)

    return salted_join(prints, once(told, "told"), ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# ---- documents that share most of their shingles -------------------------------------------------------------------------------

#: Words of the wide print of the set of five-word shingles; its bits estimate the similarity.
WIDE = 4
#: Least hashes in a band, and bands. A pair of similarity J agrees in a band with probability J ** BAND_ROWS whatever the edits are and
#: however large the input, so that a pair at 0.8 misses all bands with probability (1 - 0.8 ** 4) ** 20 = 2.7e-5.
BAND_ROWS, BANDS = 4, 20
#: Sets that one task takes as a group; larger groups are split.
MOST = 50_000
#: Members of a group that are held against all others of it in a round, at most; the items of their sets, at most, unless one set has more;
#: and those of them that share an index.
LEADERS, LEADER_ITEMS, INDEXED = 4096, 4_000_000, 512
#: Hashed buckets of sets that tell which sets are needed; a table of so many rows is broadcast.
NEEDED = 1 << 18


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band: the least values of the hashes under BAND_ROWS random orders; none for an empty set."""
    if not len(h):
        return np.empty(0, np.int64)
    rng = np.random.default_rng(7)
    seeds, factors = rng.integers(0, 2**64, (2, BAND_ROWS * BANDS), dtype=np.uint64)
    factors |= np.uint64(1)
    low = np.full(BAND_ROWS * BANDS, ~np.uint64(0))
    for at in range(0, len(h), 4096):
        z = (h[at : at + 4096] ^ seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
        z *= factors[:, None]
        low = np.minimum(low, z.min(axis=1))
    parts = low.reshape(BANDS, BAND_ROWS)
    keys = parts[:, 0].copy()
    for k in range(1, BAND_ROWS):
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + parts[:, k]
    return keys.view(np.int64)


def keyed_texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))


def item_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted hashes of the shingles of each text."""
    return [np.unique(hashes(shingles(words_of(x), size))) for x in column.cast(pa.binary()).to_pylist()]


def nodes_of(sets: list[np.ndarray]) -> pa.Array:
    """128-bit hashes of sets."""
    return pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())


def packed(text: bytes | None, own: np.ndarray) -> bytes:
    """A set of shingle hashes as the smaller of its hashes (led by 0) and of the words it is made of, deflated (led by 1)."""
    words = zlib.compress(b" ".join(words_of(text)))
    return b"\1" + words if len(words) < own.nbytes else b"\0" + own.tobytes()


def unpacked(items: bytes, size: int) -> np.ndarray:
    if items[:1] == b"\0":
        return np.frombuffer(items, np.uint64, offset=1)
    return np.unique(hashes(shingles(words_of(zlib.decompress(memoryview(items)[1:])), size)))


def set_prints(documents: DataFrame, size: int) -> DataFrame:
    """Of each row doc_id, a hash of its text, and of its set of shingles `node`, a hash, `wide`, its print, and `bands`, the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = item_sets(batch.column(1), size)
            columns = [nodes_of(sets), pa.array([majority(spread(h, WIDE)) for h in sets], pa.binary()), pa.array([band_keys(h) for h in sets], pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(2), *columns], names=["doc_id", "text_hash", "node", "wide", "bands"])

    return keyed_texts(documents).mapInArrow(run, "doc_id long, text_hash long, node binary, wide binary, bands array<long>")


def bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(NEEDED)).alias("bucket")


def whole_sets(documents: DataFrame, prints: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, items, n) of the wanted nodes and of few others: the whole set of one row for each node, `packed`, and its size.

    Which rows are needed is told by a table of NEEDED hashed buckets at most, so texts are filtered where they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            sets = item_sets(batch.column(0), size)
            items = map(packed, batch.column(0).cast(pa.binary()).to_pylist(), sets)
            yield pa.record_batch([nodes_of(sets), pa.array(list(items), pa.binary()), pa.array(map(len, sets), pa.int64())], names=["node", "items", "n"])

    needed = wanted.select(bucket("node")).distinct()
    one = prints.select("doc_id", "text_hash", "node", bucket("node")).join(F.broadcast(needed), "bucket", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    rows = one.select(bucket("k.doc_id", "k.text_hash")).distinct()
    texts = keyed_texts(documents).select("text", bucket("doc_id", "text_hash")).join(F.broadcast(rows), "bucket", "left_semi")
    return texts.select("text").mapInArrow(run, "node binary, items binary, n long").dropDuplicates(["node"])


def bits_within(similarity: float, bits: int) -> int:
    """Bits of a print of `bits` in which two sets of that similarity differ at most, up to four standard errors.

    Of large sets the share is arccos(2J / (1 + J)) / pi; small ones come up to 3/16 (four shingles of five).
    """
    share = max(3 / 16, math.acos(2 * similarity / (1 + similarity)) / math.pi)
    return int(bits * share + 4 * math.sqrt(bits * share * (1 - share)))


def differing(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes[a] ^ codes[b]).sum(axis=-1, dtype=np.int64)


def counted_keys(rows: DataFrame, key: str, most: int) -> DataFrame | None:
    """(key, parts) of the keys that more than `most` rows have, as a written table, or None; parts of `most` rows each.

    Keys are first counted by a hash in buckets, so that where no bucket is that large the rows aren't shuffled.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(1 << 15))
    if rows.groupBy(bucket.alias("b")).count().where(F.col("count") > most).isEmpty():
        return None
    return materialize(rows.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("parts")), "hot")


def loose_links(banded: DataFrame, similarity: float, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) within the groups of banded(key, entry) whose prints allow the similarity, and the groups (g, node) that had to be split.

    An entry is a node and its print. Groups of more than `most` entries are dealt over parts, each of which has the group's first entry.
    """
    wide_limit, code_limit = bits_within(similarity, WIDE * WORD_BITS), bits_within(similarity, WORD_BITS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, ["key", "part"]):
            some = np.bincount(group)[group] > 1
            entry = rows.column("entry").filter(pa.array(some)).to_pylist()
            codes = np.frombuffer(b"".join(x[16:] for x in entry), np.uint64).reshape(-1, WIDE)
            a, b = forest(group[some], codes[:, 0].copy(), code_limit, lambda x, y, codes=codes: differing(codes, x, y) <= wide_limit)
            if len(a):
                pairs = sorted({(entry[i][:16], entry[j][:16]) for i, j in zip(a.tolist(), b.tolist(), strict=True) if entry[i] != entry[j]})
                yield pa.record_batch([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

    hot = counted_keys(banded, "key", most)
    if hot is None:
        dealt, split = banded.withColumn("part", F.lit(0)), None
    else:
        keyed = banded.join(hot, "key", "left")
        whole, large = keyed.where("parts IS NULL").select("key", "entry", F.lit(0).alias("part")), keyed.where("parts IS NOT NULL")
        first = large.groupBy("key", "parts").agg(F.min("entry").alias("entry")).select("key", "entry", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        parted = large.select("key", "entry", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int").alias("part"))
        dealt = whole.union(parted.union(first).distinct())
        split = large.select(F.concat(F.lit("members of band "), F.col("key").cast("string")).cast("binary").alias("g"), F.substring("entry", 1, 16).alias("node"))
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(search, "a binary, b binary").distinct(), split


class Leaders:
    """Up to INDEXED sets, as the items of all in order with the set that each is of, so that one look-up counts for all sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets])
        item, of = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(item, kind="stable")
        item, self.of = item[order], of[order]
        self.first = np.r_[np.flatnonzero(np.r_[True, item[1:] != item[:-1]]), len(item)]
        self.items = item[self.first[:-1]]

    def similar(self, own: np.ndarray, similarity: float) -> list[int]:
        """The sets whose Jaccard similarity with another is `similarity` or more."""
        if not len(own) or not len(self.items):
            return []
        at = np.minimum(np.searchsorted(self.items, own), len(self.items) - 1)
        at = at[self.items[at] == own]
        count = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(self.of[place], minlength=len(self.sizes))
        return np.flatnonzero(both >= similarity * (len(own) + self.sizes - both) - 1e-9).tolist()


class Joined:
    """Components that links join, as a forest over their ids."""

    def __init__(self) -> None:
        self.above: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        while (y := self.above.get(x)) is not None:
            self.above[x] = z = self.above.get(y, y)
            if z == y:
                return y
            x = z
        return x

    def join(self, x: bytes, y: bytes) -> bool:
        """Whether x and y were apart; they are one now."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.above[y] = x
        return True


def similar_pairs(members: DataFrame, leaders: DataFrame, sets: DataFrame, similarity: float, most: int, size: int = 5) -> DataFrame:
    """Links (a, b) that join the members and the leaders of each group g whose sets have the similarity, by exact counts.

    members and leaders are (g, node, component); those of one component aren't compared. A task holds the leaders' sets of one group at
    a time, and the members pass by them; the members of large groups are dealt over parts, each of which has the leaders. A pair that
    earlier links of the part join already gives no link of its own, so that there are fewer links than members and leaders.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, indexes, joined = None, [], None, Joined()
        for batch in batches:
            found = []
            for g, part, follows, node, component, items in zip(*(batch.column(c).to_pylist() for c in ("g", "part", "follows", "node", "component", "items")), strict=True):
                if (g, part) != now:
                    now, held, indexes, joined = (g, part), [], None, Joined()
                if not follows:
                    held.append((node, component, unpacked(items, size)))
                    continue
                mine = joined.root(component)
                if all(joined.root(other) == mine for _, other, _ in held):
                    continue
                if indexes is None:
                    indexes = [(at, Leaders([x for *_, x in held[at : at + INDEXED]])) for at in range(0, len(held), INDEXED)]
                    held = [(leader, other, None) for leader, other, _ in held]
                own = unpacked(items, size)
                for at, index in indexes:
                    for k in index.similar(own, similarity):
                        leader, other, _ = held[at + k]
                        if joined.join(other, component):
                            found.append((node, leader))
            yield pa.record_batch([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    hot = counted_keys(members, "g", most)
    if hot is None:
        members, leaders = members.withColumn("part", F.lit(0)), leaders.withColumn("part", F.lit(0))
    else:
        parts = F.coalesce("parts", F.lit(1))
        members = members.join(hot, "g", "left").select("g", "node", "component", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
        leaders = leaders.join(hot, "g", "left").select("g", "node", "component", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = leaders.withColumn("follows", F.lit(False)).union(members.withColumn("follows", F.lit(True)))
    rows = rows.join(sets, "node").select("g", "part", "follows", "node", "component", "items")
    return rows.repartition("g", "part").sortWithinPartitions("g", "part", "follows", "node").mapInArrow(compare, "a binary, b binary")


def similar_components(documents: DataFrame, prints: DataFrame, size: int, similarity: float, most: int = MOST) -> DataFrame:
    """(node, component) of the sets that have another of the similarity or more; sets joined by a chain are in one component.

    Candidates agree in a band of least hashes and pass the print, which is a loose filter here. Each loose group has a first member, and
    the others are held against it by exact counts. In groups whose members aren't all in one component then, those outside the group's
    largest component are held against all others, up to LEADERS members or LEADER_ITEMS items at a time, until every such pair has been
    compared.
    """
    nodes = materialize(prints.select("node", "wide", "bands").dropDuplicates(["node"]), "nodes")
    banded = nodes.select(F.explode("bands").alias("key"), F.concat("node", "wide").alias("entry"))
    loose, split = loose_links(banded, similarity, most)
    loose = materialize(loose, "loose")
    wanted = loose.select(F.col("a").alias("node")).union(loose.select("b"))
    sets = materialize(whole_sets(documents, prints, wanted if split is None else wanted.union(split.select("node")), size), "sets")
    leaders = loose.select(F.col("b").alias("g"), F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    links = materialize(similar_pairs(loose.select(F.col("b").alias("g"), F.col("a").alias("node"), F.col("a").alias("component")), leaders, sets, similarity, most, size), "similar")
    # The first member of a loose group has been held against all others.
    alive = loose.select(F.col("b").alias("g"), F.col("a").alias("node"))
    alive = (alive if split is None else alive.union(split)).join(sets.select("node", "n"), "node")
    components_found = components(links)
    while True:
        placed = alive.join(components_found, "node", "left").select("g", "node", "n", F.coalesce("component", "node").alias("component"))
        counts = placed.groupBy("g", "component").agg(F.count("*").alias("count"), F.max("n").alias("n"))
        slots = F.greatest(F.least(F.lit(LEADER_ITEMS) / F.greatest(F.max("n"), F.lit(1)), F.lit(LEADERS)), F.lit(1)).cast("long")
        groups = counts.groupBy("g").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("kinds"), (F.sum("count") - F.max("count")).alias("apart"), slots.alias("slots"))
        open_groups = materialize(groups.where("kinds > 1").select("g", "main", F.when(F.col("apart") > F.col("slots"), F.col("slots")).alias("slots")), "open")
        if open_groups.isEmpty():
            return components_found
        alive = materialize(salted_join(placed, open_groups, ["g"]), "alive")
        strays = alive.where("component <> main")
        slot = F.coalesce(F.pmod(F.xxhash64("node"), F.col("slots")), F.xxhash64("node"))
        leaders = materialize(strays.groupBy("g", slot).agg(F.min(F.struct("node", "component")).alias("x")).select("g", "x.node", "x.component"), "leaders")
        left = sets.join(F.broadcast(alive.select(bucket("node")).distinct()), bucket("node") == F.col("bucket"), "left_semi")
        more = materialize(similar_pairs(alive.select("g", "node", "component"), leaders, left, similarity, most, size), "similar")
        if not more.isEmpty():
            links = links.union(more)
            components_found = components(links)
        if leaders.count() == strays.count():  # what is left of each group is one component
            return components_found
        alive = alive.join(leaders.select("g", "node"), ["g", "node"], "left_anti").select("g", "node", "n")


def similar_groups(documents: DataFrame, similarity: float = 0.8, size: int = 5, most: int = MOST) -> DataFrame:
    """(doc_id, text_hash, component) of each row: rows whose sets of `size`-word shingles have a Jaccard similarity of `similarity` or more are in one component.

    Rows without words are copies of each other.
    """
    prints = materialize(set_prints(documents, size), "prints")
    found = similar_components(documents, prints, size, similarity, most)
    return salted_join(prints.select("doc_id", "text_hash", "node"), found, ["node"], "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("component"))


def keep_one(documents: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of documents without near copies: of each component one row stays, that with the smallest doc_id (then hash of the text).

    A null doc_id sorts last. All columns are kept as they are, whatever their names. Rows without words are copies of each other, so one
    of them stays. Of rows with the same doc_id and text the one stays whose columns come first as JSON.
    """
    key, text_hash, copies, row, order = unused(documents, "id", "text_hash", "copies", "row", "order")

    def choose() -> DataFrame:
        rows = materialize(similar_groups(documents, similarity, size), "groups")
        first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))).alias("k"))
        repeated = rows.groupBy("doc_id", "text_hash").count()
        same = F.col("id").eqNullSafe(repeated["doc_id"]) & F.col("h").eqNullSafe(repeated["text_hash"])
        return first.select("k.*").join(repeated, same).select(F.col("id").alias(key), F.col("h").alias(text_hash), F.col("count").alias(copies))

    chosen = once(choose, "chosen")
    kept = documents.join(chosen.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text_hash)))
    columns = [named(c) for c in documents.columns]
    alone = kept.where(F.col(copies) == 1).select(*columns)
    again = kept.where(F.col(copies) > 1).select(key, text_hash, F.struct(*columns).alias(row)).withColumn(order, F.to_json(row))
    return alone.union(again.groupBy(key, text_hash).agg(F.min_by(row, order).alias(row)).select(f"{row}.*"))
