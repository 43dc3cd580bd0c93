"""What several operators of this subpackage share: reading tables, scratch tables, hot keys, folds, samples, slices of batches."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker looks at together, unless one row has more.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: int | str) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, cut so that the texts of a slice start within SLICE_BYTES bytes; nothing is copied."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
            yield batch.slice(int(a), int(b - a))


def named(column: str) -> Column:
    """A column by its name as it is, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def map_whole(df: DataFrame, run) -> DataFrame:
    """The rows that run(batches) leaves of df, with all its columns; in the batches columns have numbers for names, as mapInArrow takes no names with dots or backticks."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of df (whatever their case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where none is set and all runs on one machine."""
    named_dir = spark.conf.get("spark.checkpoint.dir", None)
    if named_dir:
        return named_dir.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="routeloom-"))
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set_before.get().rstrip("/")


class Passing(threading.local):
    """The tables written in calls of `once` that go on in this thread."""

    def __init__(self) -> None:
        self.calls: list[list[DataFrame]] = []


PASSING = Passing()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as compressed Parquet and read back. Lost executors don't lose it; it goes when the driver ends, by `discard`, or with `once`."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    files, hadoop = file_system(spark, path)
    files.deleteOnExit(hadoop)
    if PASSING.calls:
        PASSING.calls[-1].append(out)
    return out


def once(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What build returns as a written table; the tables that were written on the way to it are deleted."""
    PASSING.calls.append([])
    try:
        df = build()
    finally:
        passing = PASSING.calls.pop()
    out = materialize(df, name)
    for old in passing:
        discard(old)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote and that no plan reads any more."""
    files, path = file_system(df.sparkSession, df._scratch)
    files.delete(path, True)


def file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, bytes_each: int = 64_000_000) -> int:
    """Partitions for a shuffle of df's rows that Python workers hold whole: spark.sql.shuffle.partitions, or more where the plan's estimated size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_partitions(df.sparkSession), size // bytes_each if size < 2**60 else 0)


#: Keys are counted in so many buckets at most; what is known of hot keys is a table of that many rows at most.
HOT_BUCKETS = 1 << 15


def hot_buckets(rows: DataFrame, key: list[str]) -> DataFrame:
    """(bucket, salts) of the hashed buckets of a key that hold so many rows that one task shouldn't get them all."""
    counts = rows.groupBy(F.pmod(F.xxhash64(*key), F.lit(HOT_BUCKETS)).cast("int").alias("bucket")).count()
    total = F.sum("count").over(everything())
    limit = F.greatest(total / (4 * shuffle_partitions(rows.sparkSession)), total * 8 / HOT_BUCKETS, F.lit(16))
    return counts.select("bucket", F.ceil(F.col("count") / limit).cast("int").alias("salts")).where("salts > 1")


def everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def salted_join(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """left join right on the columns `key`, where few keys may hold most rows of left; right has one row or few for each key.

    Buckets of keys with many rows of left get salts: left's rows are dealt over them, right's are there once for each. The table of
    salts has HOT_BUCKETS rows at most, so it is broadcast. A null key matches nothing.
    """
    bucket, salts, salt = unused(left.join(right, key), "bucket", "salts", "salt")
    hot = materialize(hot_buckets(left, key).toDF(bucket, salts), "hot").hint("broadcast")
    of = F.pmod(F.xxhash64(*key), F.lit(HOT_BUCKETS)).cast("int")
    rest = [c for c in left.columns if c not in key] or key
    dealt = left.withColumn(bucket, of).join(hot, bucket, "left").withColumn(salt, F.when(F.col(salts).isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id(), *map(named, rest)), F.col(salts)).cast("int")).otherwise(0)).drop(bucket, salts)
    copied = right.withColumn(bucket, of).join(hot, bucket, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))).drop(bucket, salts)
    return dealt.join(copied.hint("shuffle_hash"), [*key, salt], how).drop(salt)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, folds: int, held: int) -> Column:
    """True for rows whose crc32(doc_id as text) leaves the held remainder; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds) == F.lit(held), F.lit(False))


def sample_texts(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int) -> DataFrame:
    """(text, label, h) of at most `bound` labelled rows outside the held-out fold, picked by a hash of the id; repeated rows count once.

    The sample is only for fitting a classifier; its bound, in rows, is a documented parameter of each operator. Texts are taken whole
    and stay with the executors, which turn them into features.
    """
    marked = labels.where(F.col(label).isNotNull() & ~fold(F.col("doc_id"), folds, held)).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = marked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    keyed = texts.join(F.broadcast(chosen), "doc_id").select("text", "label", F.xxhash64("doc_id", "text").alias("h"))
    rows = materialize(keyed, "sample")
    top = rows.select("h").distinct().orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    return rows.where(F.col("h") <= F.lit(top)).dropDuplicates(["h"]) if top is not None else rows


def give_back() -> None:
    """Return freed memory of this Python worker to the system; workers live on, and their peaks would add up."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
