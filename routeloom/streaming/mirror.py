"""A mirror kept from a snapshot and ordered deltas, with Structured Streaming.

Files of JSON lines hold records {session, version, kind, operation, class, pk, source, payload}, where kind is `snapshot` or `delta`. Each
micro-batch is applied as a whole: the versions of a delta must follow the state's version one by one, older ones are ignored, and a gap or
another session leaves the state as it is until a snapshot comes, which replaces it. The records of a delta apply in their order in its
file: file, block of the file and row in the block make the place of a record. The state is a written table for each version, and
the pointer to the newest is one small JSON row, so that a restarted query goes on where the last one was.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.registry import latest

RECORD = "session string, version long, kind string, operation string, class string, pk string, source string, payload string"
FAILURES = 3


class Mirror:
    """State under a folder that all executors share; Hadoop's file system does the writing, so it can lie in any store."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def status(self) -> dict:
        jvm, path, fs = self.files()
        names = sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
        done = [n for n in names if n.endswith(".json")]
        if not done:
            return {"session": None, "version": 0, "table": None, "failures": 0, "step": 0}
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(path, done[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, status: dict) -> None:
        """Write the next pointer whole, under a name that sorts after the last."""
        jvm, path, fs = self.files()
        fs.mkdirs(path)
        status = {**status, "step": status["step"] + 1}
        part, whole = (jvm.org.apache.hadoop.fs.Path(path, f"{status['step']:012d}.{x}") for x in ("part", "json"))
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(status).encode()))
        stream.close()
        fs.rename(part, whole)

    def objects(self) -> DataFrame:
        table = self.status()["table"]
        if table is None:
            return self.spark.createDataFrame([], "class string, pk string, source string, payload string, seq long")
        return self.spark.read.parquet(table)

    def apply(self, batch: DataFrame, batch_id: int = 0) -> dict:
        """One batch of records; the state after it. Records of one version apply by their `place`, or in the order of the batch if it has no such column."""
        status = self.status()
        if "place" not in batch.columns:
            # Rows of a split keep their order, so the file, the split and the row in it tell the order of records.
            batch = batch.withColumn("place", F.struct(*[c for c in ("file", "block") if c in batch.columns], F.monotonically_increasing_id().alias("row")))
        batch = batch.persist()
        try:
            told = [r.asDict() for r in batch.groupBy("session", "kind", "version").agg(F.count("*").alias("n")).collect()]
            # One row for each version: deltas are few, whatever they hold.
            snapshots = [r for r in told if r["kind"] == "snapshot"]
            base = status
            if snapshots:
                best = max(snapshots, key=lambda r: (r["session"] != status["session"], r["version"]))
                if best["session"] != status["session"] or best["version"] > status["version"]:
                    base = {**status, "session": best["session"], "version": best["version"], "table": None, "failures": 0}
            versions = sorted(r["version"] for r in told if r["kind"] == "delta" and r["session"] == base["session"] and r["version"] > base["version"])
            last = base["version"]
            for v in versions:
                if v != last + 1:
                    break
                last = v
            gap = bool(versions) and versions[-1] > last or any(r["session"] != base["session"] for r in told if r["kind"] == "delta")
            failures = base["failures"] + 1 if gap else 0
            if base is status and last == status["version"]:
                if gap:
                    self.publish({**status, "failures": failures})
                return self.status()
            rows = batch.where((F.col("session") == base["session"]) & (F.col("kind") == "delta") & F.col("version").between(base["version"] + 1, last))
            if base is not status:
                rows = rows.unionByName(batch.where((F.col("session") == base["session"]) & (F.col("kind") == "snapshot") & (F.col("version") == base["version"])))
            changes = rows.select("class", "pk", "source", "payload", F.col("version").alias("seq"), F.coalesce("operation", F.lit("ADD")).alias("operation"), "place")
            held = self.objects().withColumns({"operation": F.lit("ADD"), "place": F.lit(None).cast(batch.schema["place"].dataType)}) if base is status else None
            table = f"{self.folder}/objects-{base['session']}-{last}-{status['step']}"
            latest(changes if held is None else held.unionByName(changes)).write.mode("overwrite").parquet(table)
            self.publish({**base, "version": last, "table": table, "failures": failures, "step": status["step"]})
            return self.status()
        finally:
            batch.unpersist()

    def needs_snapshot(self) -> bool:
        status = self.status()
        return status["session"] is None or status["failures"] >= FAILURES

    def follow(self, source: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        """Apply the files that come into a folder, all that are there (no interval) or every interval."""
        stream = self.spark.readStream.schema(RECORD).json(source).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        writer = stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
