"""Registry operators that aren't recursive: validation of objects, mutation, ASPA checks, reverse look-ups, text lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import V4_BITS

#: (class, attribute, required, single) of a profile. A class that isn't listed is unknown.
Spec = list[tuple[str, str, bool, bool]]


def violations(attributes: DataFrame, spec: Spec) -> DataFrame:
    """(obj_id, rule, name): what objects break of a profile.

    A class or attribute that the profile doesn't know, an attribute that may stand once and stands more often (told once), and a
    required one that is absent or empty throughout. attributes has (obj_id, class, name, value); the profile is broadcast, as it is a
    short fixed list.
    """
    spark = attributes.sparkSession
    rows = spark.createDataFrame(spec, "class string, name string, required boolean, single boolean")
    classes = F.broadcast(rows.select("class").distinct().withColumn("__known", F.lit(True)))
    counted = attributes.groupBy("obj_id", "class", "name").agg(F.count("*").alias("n"), F.count_if(F.trim("value") != "").alias("full"))
    told = counted.join(classes, "class", "left").join(F.broadcast(rows), ["class", "name"], "left")
    rule = (
        F.when(F.col("__known").isNull(), "dict/unknown-class")
        .when(F.col("single").isNull(), "dict/unknown-attribute")
        .when(F.col("single") & (F.col("n") > 1), "dict/cardinality")
    )
    broken = told.select("obj_id", rule.alias("rule"), F.when(F.col("__known").isNull(), F.col("class")).otherwise(F.col("name")).alias("name")).where("rule IS NOT NULL").distinct()
    needed: dict[str, list[str]] = {}
    for c, n, required, _ in spec:
        if required:
            needed.setdefault(c, []).append(n)
    absent = F.coalesce(*[F.when(F.col("class") == c, F.array_except(F.array(*map(F.lit, names)), F.col("full"))) for c, names in needed.items()], F.array().cast("array<string>"))
    present = counted.groupBy("obj_id", "class").agg(F.collect_set(F.when(F.col("full") > 0, F.col("name"))).alias("full"))
    missing = present.select("obj_id", F.lit("dict/missing-required").alias("rule"), F.explode(absent).alias("name"))
    return broken.unionByName(missing)


def latest(mutations: DataFrame) -> DataFrame:
    """The state after upserts and deletions in the order of seq: the last row of each (class, pk, source), unless it deletes.

    Rows of one seq come in the order of a column `place`, if there is one; it isn't part of the state.
    """
    order = [c for c in ("seq", "place") if c in mutations.columns]
    rest = [c for c in mutations.columns if c not in ("class", "pk", "source", *order)]
    last = mutations.groupBy("class", "pk", "source").agg(F.max(F.struct(*order, *rest)).alias("last"))
    kept = [c for c in mutations.columns if c not in ("class", "pk", "source", "operation", "place")]
    return last.where(F.col("last.operation") != "DEL").select("class", "pk", "source", *[F.col(f"last.{c}").alias(c) for c in kept])


def merge(own: DataFrame, other: DataFrame) -> DataFrame:
    """Two states as one, where an object of the other replaces an own one of the same identity."""
    rest = [c for c in own.columns if c not in ("class", "pk", "source")]
    both = own.withColumn("__second", F.lit(False)).unionByName(other.withColumn("__second", F.lit(True)))
    last = both.groupBy("class", "pk", "source").agg(F.max(F.struct("__second", *rest)).alias("last"))
    return last.select("class", "pk", "source", *[F.col(f"last.{c}").alias(c) for c in rest])


def providers(aspas: DataFrame) -> DataFrame:
    """(customer, providers): records of one customer are one set."""
    return aspas.groupBy("customer").agg(F.sort_array(F.collect_set("provider")).alias("providers"))


def missing_providers(neighbours: DataFrame, aspas: DataFrame) -> DataFrame:
    """(asn, peer): providers that an AS's policy names and its ASPA doesn't list, for those that have one."""
    named = neighbours.where(F.col("kind") == "provider").select("asn", "peer").distinct()
    known = aspas.select(F.col("customer").alias("asn")).distinct()
    listed = aspas.select(F.col("customer").alias("asn"), F.col("provider").alias("peer")).distinct()
    return named.join(known, "asn", "left_semi").join(listed, ["asn", "peer"], "left_anti")


def stale_providers(neighbours: DataFrame, aspas: DataFrame) -> DataFrame:
    """(asn, peer): providers that an ASPA lists and the AS's policy doesn't name as a neighbour, for those that have a policy."""
    listed = aspas.select(F.col("customer").alias("asn"), F.col("provider").alias("peer")).distinct()
    named = neighbours.select("asn", "peer").distinct()
    return listed.join(named.select("asn").distinct(), "asn", "left_semi").join(named, ["asn", "peer"], "left_anti")


def special_as(asn: Column) -> Column:
    """AS_TRANS, and numbers kept for documentation, private use and nothing."""
    return (asn == 23456) | asn.between(64496, 65551) | (asn >= 4200000000)


def named_by(neighbours: DataFrame) -> DataFrame:
    """(asn, named_by): which AS numbers' policies name an AS."""
    return neighbours.where(F.col("peer") != F.col("asn")).select(F.col("peer").alias("asn"), F.col("asn").alias("named_by")).distinct()


def in_blocks(asns: DataFrame, blocks: DataFrame, size: int = 65_536) -> DataFrame:
    """asns with the blocks (lo, hi) that hold them: an equi-join on cells of `size` numbers, which a block takes all of that it meets."""
    cells = blocks.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    return asns.withColumn("__cell", F.floor(F.col("asn") / size)).join(cells, "__cell").where(F.col("asn").between(F.col("lo"), F.col("hi"))).drop("__cell")


def as_list_lines(asns: DataFrame, name: str, width: int = 8) -> DataFrame:
    """(line_no, line): an AS list of `width` numbers a line, in order.

    The order is global, so line numbers come from counts by range of the numbers: each range of 65 536 numbers is ranked by itself, and
    the ranges' counts, at most 65 536 rows, are summed in one task.
    """
    from pyspark.sql import Window

    cells = asns.select("asn").distinct().withColumn("__cell", F.floor(F.col("asn") / 65_536))
    counts = cells.groupBy("__cell").count()
    before = counts.select("__cell", (F.sum("count").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("__before"))
    placed = cells.withColumn("__n", F.row_number().over(Window.partitionBy("__cell").orderBy("asn"))).join(F.broadcast(before), "__cell")
    lines = placed.withColumn("line_no", F.floor((F.col("__before") + F.col("__n") - 1) / width)).groupBy("line_no").agg(F.sort_array(F.collect_list("asn")).alias("asns"))
    return lines.select("line_no", F.concat(F.lit(f"{name}: "), F.array_join(F.transform("asns", lambda x: x.cast("string")), " ")).alias("line"))


def aggregate(prefixes: DataFrame) -> DataFrame:
    """The fewest prefixes (name, addr, plen) that cover the same addresses: none that another covers, and no pair of siblings.

    Addresses as intervals, merged in one sweep, and each interval cut into aligned blocks.
    """
    from . import space

    begin = F.col("addr")
    held = prefixes.select(F.col("name").alias("space"), F.lit(V4_BITS).alias("plen"), begin.alias("lo"), (begin + space.power(F.lit(V4_BITS) - F.col("plen"))).alias("hi"))
    return space.ranges(space.sweep({"a": held}, F.col("a") > 0)).select(F.col("space").alias("name"), "addr", "plen")
