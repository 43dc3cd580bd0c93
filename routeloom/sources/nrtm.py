"""Mirror files: JSON text sequences with snapshots and deltas, their notification, and where sources come from."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rpsl import parse_object

HEADER = "struct<nrtm_version:int,type:string,source:string,session_id:string,version:long>"
CHANGE = "struct<action:string,object:string,object_class:string,primary_key:string>"


def read_sequence(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records for `Mirror` of snapshot and delta files: text sequences whose first record is a header.

    A file is a stream of records behind 0x1E, split by Spark's text source; the header of each file is joined to its other records by
    the file's name. A record that isn't JSON fails the read, as a delta holds whole or not at all.
    """
    lines = spark.read.option("lineSep", "\x1e").text(paths).select(F.col("_metadata.file_path").alias("file"), F.trim(F.regexp_replace("value", r"[\r\n]+$", "")).alias("value")).where("value <> ''")
    head = lines.select("file", F.from_json("value", HEADER).alias("h")).where("h.nrtm_version IS NOT NULL").select("file", "h.*")

    @F.udf("struct<class:string,pk:string,source:string>", useArrow=True)
    def identity(text):
        o = parse_object((text or "").splitlines(keepends=True))
        if not o.attrs:
            return None
        key = o.attrs[0].value
        if o.attrs[0].name in ("route", "route6"):
            key += o.first("origin") or ""
        return {"class": o.attrs[0].name, "pk": key.upper(), "source": (o.first("source") or "").upper()}

    told = lines.select("file", "value", F.from_json("value", CHANGE).alias("c")).where("NOT contains(value, '\"nrtm_version\"')")
    checked = told.withColumn("c", F.when(F.col("c.object").isNotNull() | F.col("c.primary_key").isNotNull(), F.col("c")).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.substring("value", 1, 80)))))
    joined = checked.join(head, "file").withColumn("i", identity("c.object"))
    gone = F.lower(F.coalesce("c.action", F.lit("add_modify"))) == "delete"
    return joined.select(
        F.col("session_id").alias("session"),
        "version",
        F.lower("type").alias("kind"),
        F.when(gone, "DEL").otherwise("ADD").alias("operation"),
        F.coalesce("c.object_class", "i.class").alias("class"),
        F.upper(F.coalesce("c.primary_key", "i.pk")).alias("pk"),
        F.upper(F.coalesce("i.source", joined["source"])).alias("source"),
        F.when(~gone, F.col("c.object")).alias("payload"),
    )


class Refused(ValueError):
    pass


def read_notification(text: str, state: dict, verify: Callable[[str], dict | None], now: float, max_age: float = 86_400) -> dict:
    """The checked notification of an update: signed, of this source's session or a newer one, not older than the state, deltas without gaps.

    verify gives the payload of a signed text or None; state has session and version. `stale` tells if it is older than max_age seconds.
    """
    told = verify(text)
    if told is None:
        raise Refused("signature doesn't verify")
    if told.get("nrtm_version") != 4 or told.get("type") != "notification":
        raise Refused("not a notification of version 4")
    if told["session_id"] == state.get("session") and told["version"] < (state.get("version") or 0):
        raise Refused("older than what is known")
    versions = [d["version"] for d in told.get("deltas", [])]
    if versions != list(range(told["version"] - len(versions) + 1, told["version"] + 1)):
        raise Refused("deltas don't lead up to the version one by one")
    if told.get("snapshot", {}).get("version", 0) > told["version"]:
        raise Refused("the snapshot is newer than the version")
    return told | {"stale": now - told.get("timestamp", now) > max_age}


def plan(notification: dict, state: dict, failures: int = 0, most_failures: int = 3) -> list[str]:
    """Files to read in their order: deltas behind the state's version, or the snapshot first if there is none, a new session, a gap or too many failures."""
    deltas = {d["version"]: d["url"] for d in notification.get("deltas", [])}
    version = state.get("version") or 0
    fresh = state.get("session") != notification["session_id"] or failures >= most_failures or any(v not in deltas for v in range(version + 1, notification["version"] + 1))
    files = []
    if fresh:
        files, version = [notification["snapshot"]["url"]], notification["snapshot"]["version"]
    return files + [deltas[v] for v in range(version + 1, notification["version"] + 1)]


def parse_source(spec: str) -> dict:
    """NAME=dump:FILE[,FILE...] or NAME=nrtm4:URL,key=FILE."""
    name, equals, rest = spec.partition("=")
    kind, colon, value = rest.partition(":")
    if not equals or not colon or not name.strip() or kind not in ("dump", "nrtm4") or not value:
        raise ValueError(f"not a source: {spec}")
    parts = value.split(",")
    if kind == "dump":
        return {"name": name.strip().upper(), "kind": kind, "files": parts}
    options = dict(p.partition("=")[::2] for p in parts[1:])
    if set(options) != {"key"}:
        raise ValueError(f"a mirror needs key=FILE and nothing else: {spec}")
    return {"name": name.strip().upper(), "kind": kind, "url": parts[0], "key": options["key"]}


def unsigned(text: str) -> dict | None:
    """A verifier for files that come from a trusted place."""
    try:
        return json.loads(text)
    except ValueError:
        return None
