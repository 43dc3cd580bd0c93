"""Connected components of a link table, by rounds of joins; links and components never leave the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, once, salted_join

#: Links that one task takes at most, some 100 bytes each.
IN_ONE_TASK = 500_000


def smallest_label(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after joining the pairs (a, b): each item gets the smallest label it is connected to."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            return label
        label = new


def components(links: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """A written table (node, component) for every node of links(a, b) that has a link to another; component is the smallest node that can be reached.

    Up to `in_one_task` links, counted first, are joined in one task. Beyond, it goes in rounds of joins: each round, the links of a node are moved to the smallest of its neighbours (larger ones first, then smaller ones), until a round
    changes nothing. Both steps group by a node; what is sent for a node is one row for each of its links, and links that meet in the
    same pair are merged before the next round, so that the table never grows beyond its first size. A node with very many links is
    dealt over several tasks. Links of a node to itself or with a null end count for nothing; repeated links count once. The tables of
    rounds that are over are deleted.
    """
    return once(lambda: stars(links, in_one_task), "components")


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links in one task."""
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    both = pa.chunked_array([*rows.column("u").chunks, *rows.column("v").chunks])
    nodes = pc.unique(both)
    nodes = nodes.take(pc.sort_indices(nodes))
    u, v = (pc.index_in(rows.column(c), nodes).to_numpy().astype(np.int64) for c in ("u", "v"))
    label = smallest_label(len(nodes), u, v, np.arange(len(nodes)))
    for at in range(0, len(nodes), 10_000):
        yield pa.record_batch([nodes.slice(at, 10_000), nodes.take(pa.array(label[at : at + 10_000]))], names=["node", "component"])


def stars(links: DataFrame, in_one_task: int) -> DataFrame:
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.count() <= in_one_task:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(joined, f"node {kind}, component {kind}")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return ends.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
