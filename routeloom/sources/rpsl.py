"""Registry dumps as objects: text lines to attributes without loss, objects over split boundaries, one row for each object.

A dump is read by Spark's text source, so it can lie in any store that Spark reads and be split. Each split gives the objects that lie in
it whole; what stands before its first and after its last blank line are fragments, and only these are shuffled, by file, and put
together. Errors are rows beside the data, never failures.
"""

from __future__ import annotations

import gzip
import io
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_LINES = 16 << 20, 262_144
BLANK = re.compile(r"^[ \t]*\r*$")
START = re.compile(r"^(?:[^ \t+#:][^#:]*)?:")
DIAGNOSTIC = "struct<rule:string,severity:string,message:string,line:int>"
ATTRIBUTE = "struct<ord:int,name:string,value:string,raw:string,line:int>"
OBJECT = f"file string, block long, seq int, class string, key string, source string, trivia string, attrs array<{ATTRIBUTE}>, diags array<{DIAGNOSTIC}>"


@dataclass
class Attribute:
    name: str
    value: str
    raw: str
    line: int


@dataclass
class Object:
    attrs: list[Attribute] = field(default_factory=list)
    trivia: str = ""
    diags: list[tuple[str, str, str, int]] = field(default_factory=list)

    def first(self, name: str) -> str | None:
        return next((a.value for a in self.attrs if a.name == name), None)

    def text(self) -> str:
        """The object as it was written."""
        return self.trivia + "".join(a.raw for a in self.attrs)


def bare(part: str) -> str:
    """A value without its comment and the blanks at its ends."""
    return part.split("#", 1)[0].strip(" \t\r\n")


def classify(line: str, open_attribute: bool) -> str:
    """attribute, continuation, blank, comment or malformed."""
    if BLANK.match(line):
        return "blank"
    if line[0] == "#":
        return "comment"
    if line[0] in " \t+":
        return "continuation" if open_attribute else "malformed"
    return "attribute" if START.match(line) else "malformed"


def lower_name(name: str) -> str:
    return name.strip(" \t").translate({k: k + 32 for k in range(65, 91)})


def parse_object(lines: Iterable[str]) -> Object:
    """One object of lines that end as they were written; continuations join with a line end, their marker dropped."""
    out = Object()
    for n, line in enumerate(lines, 1):
        kind = classify(line.rstrip("\n"), bool(out.attrs))
        if kind == "attribute":
            name, _, value = line.rstrip("\n").partition(":")
            out.attrs.append(Attribute(lower_name(name), bare(value), line, n))
            if not name.strip(" \t"):
                out.diags.append(("lexer/empty-name", "error", "attribute without a name", n))
        elif kind == "continuation":
            last = out.attrs[-1]
            last.value += "\n" + bare(line[1:])
            last.raw += line
        else:
            if kind == "malformed":
                out.diags.append(("lexer/malformed-line", "error", "neither an attribute nor a continuation", n))
            if out.attrs:
                out.attrs[-1].raw += line
            else:
                out.trivia += line
    return out


def list_items(value: str) -> list[str]:
    """Items between commas and line ends; an empty one counts only between commas of one line."""
    items: list[str] = []
    for line in value.split("\n"):
        parts = [p.strip(" \t\r") for p in line.split(",")]
        items += [p for k, p in enumerate(parts) if p or 0 < k < len(parts) - 1]
    return items


def decoded(line: bytes) -> tuple[str, bool]:
    """A line as UTF-8, or as Windows-1252 where it isn't, and whether it was."""
    try:
        return line.decode(), False
    except UnicodeDecodeError:
        return line.decode("cp1252", "replace"), True


def row_of(file: str, block: int, seq: int, lines: list[bytes]) -> dict | None:
    told = [decoded(x) for x in lines]
    size = sum(map(len, lines))
    if size > MAX_BYTES or len(lines) > MAX_LINES:
        return {"file": file, "block": block, "seq": seq, "class": None, "key": None, "source": None, "trivia": "", "attrs": [], "diags": [{"rule": "rpsl/object-too-large", "severity": "error", "message": f"{size} bytes in {len(lines)} lines", "line": 1}]}
    o = parse_object([x + "\n" for x, _ in told])
    if any(odd for _, odd in told):
        o.diags.append(("rpsl/not-utf8", "warning", "read as Windows-1252", 1 + next(k for k, (_, odd) in enumerate(told) if odd)))
    if not o.attrs and not o.diags:
        return None
    return {
        "file": file,
        "block": block,
        "seq": seq,
        "class": o.attrs[0].name if o.attrs else None,
        "key": o.attrs[0].value if o.attrs else None,
        "source": o.first("source"),
        "trivia": o.trivia,
        "attrs": [{"ord": k, "name": a.name, "value": a.value, "raw": a.raw, "line": a.line} for k, a in enumerate(o.attrs)],
        "diags": [dict(zip(("rule", "severity", "message", "line"), d, strict=True)) for d in o.diags],
    }


def with_trivia(groups: Iterable[list[bytes]]) -> Iterator[list[bytes]]:
    """Groups of lines, those that are only comments joined to the next."""
    held: list[bytes] = []
    for g in groups:
        held += g
        if any(not x.startswith(b"#") for x in g):
            yield held
            held = []
    if held:
        yield held


GZIP = bytes((0x1F, 0x8B))


def unnamed_gzip(spark: SparkSession, paths: str | list[str]) -> tuple[list[str], list[str]]:
    """The files under paths in two lists: those that are gzip by their first two bytes but not by their name, and the others."""
    jvm, told = spark.sparkContext._jvm, ([], [])
    for path in [paths] if isinstance(paths, str) else paths:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in files.globStatus(hadoop) or []:
            inner = files.listStatus(found.getPath()) if found.isDirectory() else [found]
            for f in inner:
                name = f.getPath().getName()
                if f.isDirectory() or name.startswith(("_", ".")):
                    continue
                stream = files.open(f.getPath())
                try:
                    odd = not name.endswith(".gz") and bytes((stream.read() & 255, stream.read() & 255)) == GZIP
                finally:
                    stream.close()
                told[0 if odd else 1].append(f.getPath().toString())
    return told


def gunzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of gzip files, one file at a time, some lines at a time."""
    for batch in batches:
        for path, content in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
            held: list[bytes] = []
            with gzip.open(io.BytesIO(content)) as stream:
                for line in stream:
                    held.append(line.removesuffix(b"\n"))
                    if len(held) >= 10_000:
                        yield pa.record_batch([pa.array([path] * len(held)), pa.array([0] * len(held), pa.int64()), pa.array(held, pa.binary())], names=["file_path", "block", "line"])
                        held = []
            yield pa.record_batch([pa.array([path] * len(held), pa.string()), pa.array([0] * len(held), pa.int64()), pa.array(held, pa.binary())], names=["file_path", "block", "line"])


def scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Objects of dumps, by file, split and place in the split; gzip files are known by their name or their first bytes."""
    odd, plain = unnamed_gzip(spark, paths)
    lines = spark.read.option("lineSep", "\n").text(plain if odd else paths).select("_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")) if plain or not odd else None
    if odd:
        packed = spark.read.format("binaryFile").load(odd).select("path", "content").mapInArrow(gunzipped, "file_path string, block long, line binary")
        lines = packed if lines is None else lines.union(packed)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int32()), ("head", pa.bool_()), ("tail", pa.bool_()), ("lines", pa.list_(pa.binary()))])
        at, seq, held, head, rows = None, 0, [], True, []

        def close(tail: bool) -> None:
            nonlocal held, seq, head
            if held or head or tail:
                rows.append({"file": at[0], "block": at[1], "seq": seq, "head": head, "tail": tail, "lines": held})
                seq += 1
            held, head = [], False

        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != at:
                    if at is not None:
                        close(True)
                    at, seq, held, head = (file, block), 0, [], True
                if BLANK.match(line.decode("latin-1")):
                    close(False)
                else:
                    held.append(line)
            if len(rows) > 1000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if at is not None:
            close(True)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    parts = lines.mapInArrow(split, "file string, block long, seq int, head boolean, tail boolean, lines array<binary>")
    inner = parts.where("NOT head AND NOT tail")
    edges = parts.where("head OR tail")

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], None
        for r in pdf.sort_values(["block", "seq"]).to_dict("records"):
            lines = list(r["lines"])
            if r["head"] and held is not None:
                held = {**held, "lines": [*held["lines"], *lines]}
            else:
                held = {**r, "lines": lines}
            if not r["tail"]:
                out.append(held)
                held = None
        if held is not None:
            out.append(held)
        return pd.DataFrame([{k: o[k] for k in ("file", "block", "seq", "lines")} for o in out if o["lines"]], columns=["file", "block", "seq", "lines"])

    whole = inner.select("file", "block", "seq", "lines").unionByName(edges.groupBy("file").applyInPandas(stitch, "file string, block long, seq int, lines array<binary>"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row_of(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist([r for r in rows if r is not None], SCHEMA)

    return whole.mapInArrow(parse, OBJECT)


SCHEMA = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("seq", pa.int32()), ("class", pa.string()), ("key", pa.string()), ("source", pa.string()), ("trivia", pa.string())]
    + [("attrs", pa.list_(pa.struct([("ord", pa.int32()), ("name", pa.string()), ("value", pa.string()), ("raw", pa.string()), ("line", pa.int32())])))]
    + [("diags", pa.list_(pa.struct([("rule", pa.string()), ("severity", pa.string()), ("message", pa.string()), ("line", pa.int32())])))]
)


def attributes(objects: DataFrame) -> DataFrame:
    """One row for each attribute."""
    return objects.select("file", "block", "seq", "class", F.explode("attrs").alias("a")).select("file", "block", "seq", "class", "a.*")


def diagnostics(objects: DataFrame) -> DataFrame:
    return objects.select("file", "block", "seq", "class", F.explode("diags").alias("d")).select("file", "block", "seq", "class", "d.*")


def values(name: str, attrs: str = "attrs") -> Column:
    """All values of an attribute, in order."""
    return F.transform(F.filter(attrs, lambda a: a["name"] == name), lambda a: a["value"])


def items(name: str, attrs: str = "attrs") -> Column:
    """List items of all values of an attribute, blank ones left out."""
    parts = F.flatten(F.transform(values(name, attrs), lambda v: F.split(v, "[,\n]")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def as_number(text: Column) -> Column:
    """AS number of `AS65001` or asdot `AS1.10`, null if it isn't one."""
    up = F.upper(F.trim(text))
    plain = F.regexp_extract(up, r"^AS(\d{1,10})$", 1).try_cast("long")
    high, low = (F.regexp_extract(up, r"^AS(\d{1,5})\.(\d{1,5})$", k).try_cast("long") for k in (1, 2))
    number = F.coalesce(plain, F.when((high <= 65535) & (low <= 65535), high * 65536 + low))
    return F.when(number <= 4294967295, number)


def read_vrps(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, plen, max_length, asn, ta) of a JSON file of ROAs; a record that isn't one fails the whole file."""
    roa = "struct<prefix:string,maxLength:int,asn:string,ta:string>"
    rows = spark.read.schema(f"roas array<{roa}>").option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("roas").alias("r")).select("r.*")
    asn = F.regexp_extract("asn", r"^(?:AS)?(\d{1,10})$", 1).try_cast("long")
    plen = F.substring_index("prefix", "/", -1).try_cast("int")
    v6 = F.col("prefix").rlike(r"^[0-9A-Fa-f:]+(:\d{1,3}(\.\d{1,3}){3})?/\d{1,3}$") & F.col("prefix").contains(":") & ~F.col("prefix").rlike("::.*::|:::")
    v4 = F.col("prefix").rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)/\d{1,2}$")
    width = F.when(v4, 32).when(v6, 128)
    good = asn.isNotNull() & (asn <= 4294967295) & (plen <= width) & F.coalesce(F.col("maxLength").between(plen, width), F.col("maxLength").isNull())
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("prefix")).otherwise(F.raise_error(F.concat(F.lit("not a ROA: "), F.to_json(F.struct("*")))))
    return rows.select(checked.alias("prefix"), plen.alias("plen"), F.coalesce("maxLength", plen).alias("max_length"), asn.alias("asn"), "ta")


def read_aspas(spark: SparkSession, path: str) -> DataFrame:
    """(customer, provider) of a JSON file of ASPAs; a provider may have its family in brackets. A record that isn't one fails the whole file."""
    record = "struct<customer:string,customer_asid:string,providers:array<string>>"
    rows = spark.read.schema(f"aspas array<{record}>").option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("aspas").alias("r")).select("r.*")
    read = lambda c: F.regexp_extract(c, r"^(?:AS)?(\d{1,10})\s*(?:\((?:v4|v6|IPv4|IPv6)\))?$", 1).try_cast("long")
    number = lambda c: F.when(F.coalesce(read(c) <= 4294967295, F.lit(False)), read(c)).otherwise(F.raise_error(F.concat(F.lit("not an AS number: "), F.coalesce(c, F.lit("null")))))
    return rows.select(number(F.coalesce("customer", "customer_asid")).alias("customer"), F.explode("providers").alias("p")).select("customer", number(F.col("p")).alias("provider")).distinct()


def read_slurm(text: str) -> tuple[list[dict], list[dict]]:
    """Prefix filters and assertions of an RFC 8416 file, as rows."""
    told = json.loads(text)
    if told.get("slurmVersion") != 1:
        raise ValueError("slurmVersion must be 1")
    filters = [{"prefix": f.get("prefix"), "asn": f.get("asn")} for f in told.get("validationOutputFilters", {}).get("prefixFilters", [])]
    if any(f["prefix"] is None and f["asn"] is None for f in filters):
        raise ValueError("a filter needs a prefix or an AS number")
    added = [{"prefix": a["prefix"], "asn": a["asn"], "max_length": a.get("maxPrefixLength", int(a["prefix"].split("/")[1]))} for a in told.get("locallyAddedAssertions", {}).get("prefixAssertions", [])]
    return filters, added
