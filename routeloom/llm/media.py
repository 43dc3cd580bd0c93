"""Media columns over ISO base media containers.

`describe` walks the nested boxes of a container, decodes the sample tables of each track (stsd, mdhd, stts, stsc, stsz or stz2, stco
or co64, stss) and returns codec, duration and the byte ranges of the keyframes; payloads are never decoded, and of an `mdat` only
the header is read. `mux` writes such a container around raw samples. `media_columns` applies `describe` to a binary column.

Bytes that aren't a container, or one cut off, or whose tables name bytes that it hasn't, give a row with an `error` text and empty
tracks instead of a failure. Null bytes are treated as empty. Box sizes of 0 (to the end) and 1 (64 bits) are followed; nesting is
bounded. A table takes no more memory than a few times its box, whatever counts it claims: ranges are worked out for keyframes alone.
Where no table of keyframes is there, all samples are keyframes, and those of a chunk are one range. An unknown duration, or one beyond 63 bits,
is null. Repeated rows give the same row each; empty input gives an empty result; other columns are carried along by `media_columns`
whatever their names, apart from three that are replaced, and ignored by `round_trip`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, slices, table, unused

#: Boxes that hold boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"))
MAX_DEPTH = 12
TRACKS = "track_id long, handler string, codec string, timescale long, duration long, samples long, keyframes array<struct<start:long,length:long>>"
#: What op10 stores: samples of so many bytes, one in KEY_EVERY of them marked as a keyframe.
SAMPLE_BYTES, KEY_EVERY, TIMESCALE = 192, 16, 8000


class Malformed(ValueError):
    pass


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of its content, its end) of the boxes side by side in data[start:end]."""
    while start < end:
        if end - start < 8:
            raise Malformed(f"box header cut off at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise Malformed(f"box header cut off at {start}")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise Malformed(f"box {kind.decode('latin-1')} at {start} has {size} bytes")
        yield bytes(kind), start + head, start + size
        start += size


def tree(data: memoryview, start: int, end: int, depth: int = 0) -> list[tuple[bytes, int, int, list]]:
    if depth > MAX_DEPTH:
        raise Malformed("boxes nested too deep")
    return [(k, a, b, tree(data, a, b, depth + 1) if k in CONTAINERS else []) for k, a, b in boxes(data, start, end)]


def inside(nodes: list, *path: bytes) -> tuple[bytes, int, int, list] | None:
    for k in path:
        found = next((n for n in nodes if n[0] == k), None)
        if found is None:
            return None
        nodes = found[3]
    return found


def numbers(data: memoryview, at: int, end: int, kind: str, width: int = 1) -> np.ndarray:
    """A table of `width` columns behind its 32-bit count."""
    if at + 4 > end:
        raise Malformed(f"table cut off at {at}")
    (count,) = struct.unpack_from(">I", data, at)
    size = np.dtype(kind).itemsize * width
    if at + 4 + count * size > end:
        raise Malformed(f"table of {count} entries cut off at {at}")
    return np.frombuffer(data, kind, count * width, at + 4).reshape(count, width).astype(np.int64)


class Samples:
    """Where samples are, from chunk offsets, samples for each chunk and sample sizes; `fixed` is the size of all, or 0."""

    def __init__(self, data: memoryview, stbl: list) -> None:
        self.fixed, self.count, self.before = 0, 0, np.zeros(1, np.int64)
        if (box := inside(stbl, b"stsz")) is not None:
            self.fixed, self.count = struct.unpack_from(">II", data, box[1] + 4)
            sizes = None if self.fixed else numbers(data, box[1] + 8, box[2], ">u4")[:, 0]
        elif (box := inside(stbl, b"stz2")) is not None:
            bits, (self.count,) = data[box[1] + 7], struct.unpack_from(">I", data, box[1] + 8)
            if bits == 4:
                raw = np.frombuffer(data[box[1] + 12 : box[2]], np.uint8)[: (self.count + 1) // 2]
                sizes = np.stack([raw >> 4, raw & 15], axis=1).reshape(-1)[: self.count].astype(np.int64)
            elif bits in (8, 16):
                sizes = numbers(data, box[1] + 8, box[2], f">u{bits // 8}")[:, 0]
            else:
                raise Malformed(f"sample sizes of {bits} bits")
        else:
            sizes = np.empty(0, np.int64)
        if sizes is not None:
            if len(sizes) < self.count:
                raise Malformed("sample sizes cut off")
            self.before, self.count = np.r_[0, np.cumsum(sizes)], len(sizes)
        elif self.fixed * self.count > len(data):
            raise Malformed(f"{self.count} samples of {self.fixed} bytes are more than there is")
        self.offsets = next((numbers(data, b[1] + 4, b[2], k)[:, 0] for n, k in ((b"stco", ">u4"), (b"co64", ">u8")) if (b := inside(stbl, n)) is not None), np.empty(0, np.int64))
        runs = numbers(data, b[1] + 4, b[2], ">u4", 3) if (b := inside(stbl, b"stsc")) is not None else np.empty((0, 3), np.int64)
        if not self.count:
            self.offsets, self.first = self.offsets[:0], np.zeros(1, np.int64)
            return
        if not len(self.offsets) or not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
            raise Malformed("samples without chunks")
        which = np.searchsorted(runs[:, 0], np.arange(1, len(self.offsets) + 1), side="right") - 1
        #: The first sample of each chunk, and the number of all samples behind the last.
        self.first = np.minimum(np.r_[0, np.cumsum(runs[which, 1])], self.count)
        if self.first[-1] < self.count:
            raise Malformed("more samples than the chunks hold")
        starts, lengths = self.chunks()
        if ((starts < 0) | (starts + lengths > len(data)))[lengths > 0].any():
            raise Malformed("samples beyond the end")

    def bytes_before(self, sample: np.ndarray) -> np.ndarray:
        return sample * self.fixed if self.fixed else self.before[sample]

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the samples of each chunk."""
        edges = self.bytes_before(self.first)
        return self.offsets, np.diff(edges)

    def ranges(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each of these samples."""
        chunk = np.searchsorted(self.first, samples, side="right") - 1
        return self.offsets[chunk] + self.bytes_before(samples) - self.bytes_before(self.first[chunk]), self.bytes_before(samples + 1) - self.bytes_before(samples)


def known_duration(ticks: int, unknown: int) -> int | None:
    return ticks if ticks != unknown and ticks < 2**63 else None


def track(data: memoryview, trak: list) -> dict:
    mdia = inside(trak, b"mdia")
    if mdia is None:
        raise Malformed("track without media")
    tkhd, mdhd, hdlr = inside(trak, b"tkhd"), inside(mdia[3], b"mdhd"), inside(mdia[3], b"hdlr")
    stbl = inside(mdia[3], b"minf", b"stbl")
    if mdhd is None or stbl is None:
        raise Malformed("track without header or sample table")
    long = data[mdhd[1]] == 1
    scale, ticks = struct.unpack_from(">IQ", data, mdhd[1] + 20) if long else struct.unpack_from(">II", data, mdhd[1] + 12)
    out = {"track_id": struct.unpack_from(">I", data, tkhd[1] + (20 if data[tkhd[1]] == 1 else 12))[0] if tkhd else 0, "handler": bytes(data[hdlr[1] + 8 : hdlr[1] + 12]).decode("latin-1") if hdlr else "", "timescale": scale}
    stsd = inside(stbl[3], b"stsd")
    entry = next(boxes(data, stsd[1] + 8, stsd[2]), None) if stsd else None
    stts = numbers(data, b[1] + 4, b[2], ">u4", 2) if (b := inside(stbl[3], b"stts")) is not None else np.empty((0, 2), np.int64)
    samples = Samples(data, stbl[3])
    if (b := inside(stbl[3], b"stss")) is not None:
        keys = numbers(data, b[1] + 4, b[2], ">u4")[:, 0] - 1
        starts, lengths = samples.ranges(keys[(keys >= 0) & (keys < samples.count)])
    else:
        starts, lengths = samples.chunks()
    # Python's numbers, as the products can pass 64 bits.
    total = sum(n * d for n, d in stts.tolist())
    duration = known_duration(total, 0) if total else known_duration(ticks, 2**64 - 1 if long else 2**32 - 1)
    return out | {"codec": entry[0].decode("latin-1") if entry else "", "duration": duration, "samples": samples.count, "keyframes": list(zip(starts.tolist(), lengths.tolist(), strict=True)), "chunks": samples.chunks()}


def describe(container: bytes | None) -> dict:
    """brand, tracks and error of a container."""
    data = memoryview(container or b"")
    out: dict = {"brand": None, "tracks": [], "error": None}
    try:
        nodes = tree(data, 0, len(data))
        ftyp, moov = inside(nodes, b"ftyp"), inside(nodes, b"moov")
        out["brand"] = bytes(data[ftyp[1] : ftyp[1] + 4]).decode("latin-1") if ftyp else None
        if moov is None:
            raise Malformed("no moov box")
        out["tracks"] = [track(data, n[3]) for n in moov[3] if n[0] == b"trak"]
    except (Malformed, struct.error, IndexError, ValueError, OverflowError) as e:
        out["error"] = str(e)
    return out


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 2**32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def mux(payload: bytes, sample_bytes: int = SAMPLE_BYTES, key_every: int = KEY_EVERY, timescale: int = TIMESCALE) -> bytes:
    """One audio track of raw 8-bit samples: a container sample holds `sample_bytes` of them, ten to a chunk."""
    count, per_chunk = len(payload) // sample_bytes, 10
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    wide = len(payload) + 8 >= 2**32
    first = len(ftyp) + (16 if wide else 8)
    chunks = np.arange(first, first + len(payload), per_chunk * sample_bytes)
    rest = count % per_chunk
    runs = [(1, per_chunk, 1)] * (count >= per_chunk) + [(len(chunks), rest, 1)] * bool(rest)
    keys = np.arange(1, count + 1, key_every)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    flat = bytes(4)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, timescale << 16))
    stbl = box(
        b"stbl",
        box(b"stsd", flat, struct.pack(">I", 1), entry),
        box(b"stts", flat, struct.pack(">III", 1, count, sample_bytes)),
        box(b"stss", flat, struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        box(b"stsc", flat, struct.pack(">I", len(runs)), np.array(runs, ">u4").tobytes()),
        box(b"stsz", flat, struct.pack(">II", sample_bytes, count)),
        box(b"co64", flat, struct.pack(">I", len(chunks)), chunks.astype(">u8").tobytes()) if wide else box(b"stco", flat, struct.pack(">I", len(chunks)), chunks.astype(">u4").tobytes()),
    )
    length = count * sample_bytes
    minf = box(b"minf", box(b"smhd", bytes(8)), box(b"dinf", box(b"dref", flat, struct.pack(">I", 1), box(b"url ", b"\0\0\0\1"))), stbl)
    mdia = box(b"mdia", box(b"mdhd", b"\1\0\0\0", bytes(16), struct.pack(">IQ", timescale, length), b"\x55\xc4\0\0"), box(b"hdlr", bytes(8), b"soun", bytes(12), b"\0"), minf)
    tkhd = box(b"tkhd", b"\1\0\0\7", bytes(16), struct.pack(">II", 1, 0), struct.pack(">Q", length), bytes(12), b"\1\0\0\0", matrix, bytes(8))
    mvhd = box(b"mvhd", b"\1\0\0\0", bytes(16), struct.pack(">IQ", timescale, length), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    return ftyp + box(b"mdat", payload) + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def read_samples(container: bytes) -> tuple[bytes, dict]:
    """The samples of the first track in their order, by its tables, and the track."""
    told = describe(container)
    if told["error"] or not told["tracks"]:
        raise Malformed(told["error"] or "no track")
    track = told["tracks"][0]
    return b"".join(container[a : a + n] for a, n in zip(*(x.tolist() for x in track["chunks"]), strict=True)), track


def media_columns(df: DataFrame, content: str) -> DataFrame:
    """The rows of df with brand, tracks and error of the containers in a binary column.

    Columns of df by these names are replaced.
    """
    kind = f"struct<brand:string,tracks:array<struct<{TRACKS.replace(', ', ',').replace(' ', ':')}>>,error:string>"
    names = [f.split(" ")[0] for f in TRACKS.split(", ")]

    @F.udf(kind, useArrow=True)
    def walk(data):
        told = describe(data)
        return told | {"tracks": [{n: t[n] for n in names[:-1]} | {"keyframes": [{"start": a, "length": b} for a, b in t["keyframes"]]} for t in told["tracks"]]}

    (media,) = unused(df, "media")
    return df.withColumn(media, walk(named(content))).withColumns({n: F.col(f"{media}.{n}") for n in ("brand", "tracks", "error")}).drop(media)


ROUND_TRIP = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, keyframes array<struct<start:long,length:long>>"
ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}.get(k, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))) for n, k in (f.split(" ", 1) for f in ROUND_TRIP.split(", "))])


def digest(doc_id: int | None, text: str | None, sample_bytes: int = SAMPLE_BYTES) -> tuple:
    raw = (text or "").encode("utf-8", "replace")
    stored = mux(raw.ljust(max(1, -(-len(raw) // sample_bytes)) * sample_bytes, b" "), sample_bytes)
    payload, t = read_samples(stored)
    keyframes = zlib.crc32(b"".join(stored[a : a + n] for a, n in t["keyframes"]))
    seconds, codec = t["duration"] / t["timescale"], t["codec"].strip()
    feature = f"codec={codec};seconds={seconds:.6f};samples={t['samples']};keyframes={len(t['keyframes'])};keyframes_crc32={keyframes}"
    return doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, codec, seconds, [{"start": a, "length": n} for a, n in t["keyframes"]]


def round_trip(documents: DataFrame) -> DataFrame:
    """Store each whole text as a container, read it back by its sample tables, and digest both; with codec, duration and the keyframes' byte ranges.

    Null text is empty; each row gives a row; a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = [digest(*r) for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROUND_TRIP)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
