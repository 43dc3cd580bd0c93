"""Exact sets of IPv4 prefixes as intervals.

Of each length the prefixes are numbered 0 .. 2^length - 1, and a set is a table (space, plen, lo, hi) of disjoint half-open
intervals. Union, intersection and difference are one sweep over interval ends, by space and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import V4_BITS


def power(n: Column) -> Column:
    return F.pow(F.lit(2.0), n).cast("long")


def intervals(ranges: DataFrame, layer: str | None = None) -> DataFrame:
    """(space, plen, lo, hi[, layer]) of ranges (space, addr, plen, lo, hi)."""
    lengths = ranges.withColumn("__n", F.explode(F.sequence("lo", "hi")))
    begin = F.floor(F.col("addr") / power(F.lit(V4_BITS) - F.col("__n"))).cast("long")
    out = lengths.select("space", begin.alias("begin"), (begin + power(F.col("__n") - F.col("plen"))).alias("end"), F.col("__n").alias("plen"))
    out = out.select("space", "plen", F.col("begin").alias("lo"), F.col("end").alias("hi"))
    return out if layer is None else out.withColumn("layer", F.lit(layer))


def counted(layers: dict[str, DataFrame]) -> tuple[DataFrame, Window]:
    """(space, plen, at, next, a count for each layer): the stretches between ends that follow each other, and how often each layer holds them."""
    ends = None
    for name, df in layers.items():
        counts = [F.lit(1 if n == name else 0).alias(n) for n in layers]
        opened = df.select("space", "plen", F.col("lo").alias("at"), *counts)
        closed = df.select("space", "plen", F.col("hi").alias("at"), *[F.lit(-1 if n == name else 0).alias(n) for n in layers])
        ends = opened.union(closed) if ends is None else ends.union(opened).union(closed)
    summed = ends.groupBy("space", "plen", "at").agg(*[F.sum(n).alias(n) for n in layers])
    along = Window.partitionBy("space", "plen").orderBy("at")
    running = summed.select("space", "plen", "at", *[F.sum(n).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in layers], F.lead("at").over(along).alias("next"))
    return running.where(F.col("next").isNotNull()), along


def sweep(layers: dict[str, DataFrame], keep: Column) -> DataFrame:
    """Intervals where `keep`, an expression over one count for each layer, holds; neighbours are merged."""
    running, along = counted(layers)
    inside = running.where(keep)
    new = F.when(F.lag("next").over(along) == F.col("at"), 0).otherwise(1)
    island = inside.withColumn("__new", new).withColumn("__island", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("space", "plen", "__island").agg(F.min("at").alias("lo"), F.max("next").alias("hi")).drop("__island")


def sweeps(layers: dict[str, DataFrame], kinds: dict[str, Column]) -> DataFrame:
    """(space, kind, plen, lo, hi): what `sweep` gives for each kind's expression, from one pass over the ends."""
    running, _ = counted(layers)
    told = F.array_compact(F.array(*[F.when(keep, F.lit(kind)) for kind, keep in kinds.items()]))
    inside = running.select("space", "plen", "at", "next", F.explode(told).alias("kind"))
    along = Window.partitionBy("space", "plen", "kind").orderBy("at")
    new = F.when(F.lag("next").over(along) == F.col("at"), 0).otherwise(1)
    island = inside.withColumn("__new", new).withColumn("__island", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("space", "kind", "plen", "__island").agg(F.min("at").alias("lo"), F.max("next").alias("hi")).drop("__island")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep({"a": a, "b": b}, (F.col("a") > 0) | (F.col("b") > 0))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep({"a": a, "b": b}, (F.col("a") > 0) & (F.col("b") > 0))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep({"a": a, "b": b}, (F.col("a") > 0) & (F.col("b") == 0))


def not_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spaces of a that hold a prefix outside b."""
    return minus(a, b).select("space").distinct()


def inside(spaces: DataFrame, whole: DataFrame) -> DataFrame:
    """(space, inside): which of many spaces lie inside one, whole (plen, lo, hi), whose intervals aren't copied for each.

    Both are disjoint and merged, so a space lies inside if each of its intervals lies in one of the whole: its start is looked up as the
    last start of the whole that isn't behind it, in one pass over all starts of a length.
    """
    asked = spaces.select("plen", F.col("lo").alias("at"), F.lit(1).alias("asks"), "space", "hi")
    starts = whole.select("plen", F.col("lo").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("string").alias("space"), "hi")
    along = Window.partitionBy("plen").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.union(asked).withColumn("__reach", F.max(F.when(F.col("asks") == 0, F.col("hi"))).over(along)).where("asks = 1")
    return placed.groupBy("space").agg(F.every(F.coalesce(F.col("hi") <= F.col("__reach"), F.lit(False))).alias("inside"))


def example(space: DataFrame) -> DataFrame:
    """(space, addr, plen): the shortest and then first prefix of each."""
    first = space.groupBy("space").agg(F.min(F.struct("plen", "lo")).alias("s"))
    return first.select("space", (F.col("s.lo") * power(F.lit(V4_BITS) - F.col("s.plen"))).alias("addr"), F.col("s.plen").alias("plen"))


def ranges(space: DataFrame) -> DataFrame:
    """The canonical disjoint ranges (space, addr, plen, lo, hi): each interval in aligned blocks, and equal blocks of lengths that follow each other as one range."""
    # At level k of a tree over the numbers, with x = ceil(lo / 2^k) and y = floor(hi / 2^k), an odd x and the last below an odd y are blocks.
    # Blocks are as long as the interval at most.
    level = space.withColumn("__k", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("hi") - F.col("lo"))).cast("int"))))
    size = power(F.col("__k"))
    x, y = F.ceil(F.col("lo") / size).cast("long"), F.floor(F.col("hi") / size).cast("long")
    cut = level.withColumns({"__x": x, "__y": y}).where(F.col("__x") < F.col("__y"))
    odd = lambda c: F.pmod(F.col(c), F.lit(2)) == 1
    picked = F.array_compact(F.array(F.when(odd("__x"), F.col("__x")), F.when(odd("__y"), F.col("__y") - 1)))
    blocks = cut.withColumn("__block", F.explode(picked)).select("space", "plen", (F.col("plen") - F.col("__k")).alias("base"), (F.col("__block") * power(F.lit(V4_BITS) - F.col("plen") + F.col("__k"))).alias("addr"))
    along = Window.partitionBy("space", "base", "addr").orderBy("plen")
    runs = blocks.withColumn("__run", F.col("plen") - F.row_number().over(along))
    return runs.groupBy("space", "addr", "base", "__run").agg(F.min("plen").alias("lo"), F.max("plen").alias("hi")).select("space", "addr", F.col("base").alias("plen"), "lo", "hi")
