"""Expansion of the other set classes, and address ranges as prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expand import MAX_DEPTH, closure, edges_of
from .space import power


def expand_routers(tops: DataFrame, sets: DataFrame, members: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(top, router): addresses and names of all rtr-sets in the tops; members has (set_name, router, child)."""
    nodes = closure(tops.select("top", F.col("top").alias("node")), edges_of(members, sets), ["node"], max_depth)
    return nodes.join(members.where("router IS NOT NULL"), F.col("node") == F.col("set_name")).select("top", F.lower("router").alias("router")).distinct()


def expand_peerings(tops: DataFrame, sets: DataFrame, members: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(top, place, peering): texts of all peering-sets in the tops in the order of discovery, each once; members has (set_name, ord, peering, child)."""
    nodes = closure(tops.select("top", F.col("top").alias("node")), edges_of(members, sets), ["node"], max_depth)
    text = F.trim(F.regexp_replace("peering", r"\s+", " "))
    found = nodes.join(members.where("peering IS NOT NULL"), F.col("node") == F.col("set_name")).groupBy("top", text.alias("peering")).agg(F.min(F.struct("depth", "node", "ord")).alias("first"))
    return found.select("top", (F.row_number().over(Window.partitionBy("top").orderBy("first")) - 1).alias("place"), "peering")


def range_prefixes(rows: DataFrame, lo: str = "lo", hi: str = "hi", width: int = 32) -> DataFrame:
    """Each row once for each of the fewest prefixes (addr, plen) that make up its addresses lo .. hi."""
    level = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(width))))
    size = power(F.col("__k"))
    x, y = F.ceil(F.col(lo) / size).cast("long"), F.floor((F.col(hi) + 1) / size).cast("long")
    cut = level.withColumns({"__x": x, "__y": y}).where("__x < __y")
    odd = lambda c: F.pmod(F.col(c), F.lit(2)) == 1
    picked = F.array_compact(F.array(F.when(odd("__x"), F.col("__x")), F.when(odd("__y"), F.col("__y") - 1)))
    blocks = cut.withColumn("__b", F.explode(picked))
    return blocks.withColumns({"addr": F.col("__b") * power(F.col("__k")), "plen": width - F.col("__k")}).drop("__k", "__x", "__y", "__b")


def reverse_range(name: Column) -> tuple[Column, Column]:
    """First and last address of a domain under in-addr.arpa, `0-63.2.0.192.in-addr.arpa` included; nulls for others."""
    labels = F.reverse(F.split(F.regexp_extract(F.lower(F.trim(name)), r"^(.+)\.in-addr\.arpa\.?$", 1), r"\."))
    low = F.transform(labels, lambda x: F.regexp_extract(x, r"^(\d{1,3})(?:-\d{1,3})?$", 1).try_cast("long"))
    high = F.transform(labels, lambda x: F.coalesce(F.regexp_extract(x, r"^\d{1,3}-(\d{1,3})$", 1).try_cast("long"), F.regexp_extract(x, r"^(\d{1,3})$", 1).try_cast("long")))
    n = F.size(labels)
    good = n.between(1, 4) & F.forall(F.arrays_zip(low.alias("l"), high.alias("h")), lambda x: (x["l"] <= x["h"]) & (x["h"] <= 255))
    number = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    rest = power((4 - n) * 8)
    return F.when(good, number(low) * rest), F.when(good, (number(high) + 1) * rest - 1)
