"""Covering joins: prefixes with the less or more specific prefixes of a table, as equi-joins on bit strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import bits


def with_key(df: DataFrame, addr: str = "addr", plen: str = "plen") -> DataFrame:
    return df.withColumn("key", bits(F.col(addr), F.col(plen)))


def covering(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left with the rows of right whose prefix covers theirs, right's columns renamed to cover_*; families are kept apart where both have a column af.

    Each left prefix is met once for each length that right has at all (32 at most for IPv4, 128 for IPv6), then joined by equality; the
    lengths come to the driver. Rows of the same prefix on the right are a skewed key only as far as the data repeats a prefix.
    """
    lengths = sorted(r[0] for r in right.select("plen").distinct().collect() if r[0] is not None)
    renamed = right.select(*[F.col(c).alias(f"cover_{c}") for c in right.columns])
    possible = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.col("plen")) if lengths else F.array().cast("array<int>")
    probes = left.withColumn("__length", F.explode(possible)).withColumn("__key", F.substring("key", F.lit(1), F.col("__length")))
    same = (F.col("__key") == F.col("cover_key")) & (F.col("__length") == F.col("cover_plen"))
    if "af" in left.columns and "af" in right.columns:
        same &= F.col("af") == F.col("cover_af")
    return probes.join(renamed, same).drop("__key", "__length")


def validate(routes: DataFrame, vrps: DataFrame, identity: list[str]) -> DataFrame:
    """Routes with their origin validation state: valid, invalid or not_found.

    Any match beats all that don't; AS 0 covers but never matches. A covering record costs one row, reduced by route before the state is
    joined back.
    """
    match = (F.col("origin") == F.col("cover_asn")) & (F.col("cover_asn") != 0) & (F.col("plen") <= F.col("cover_max_length"))
    af = ["af"] if "af" in routes.columns and "af" in vrps.columns else []
    told = covering(routes.select(*af, "key", "plen", "origin").distinct(), vrps.select(*af, "key", "plen", "max_length", "asn").distinct()).groupBy(*af, "key", "origin").agg(F.max(match).alias("__match"))
    state = F.when(F.col("__match"), "valid").when(F.col("__match").isNotNull(), "invalid").otherwise("not_found")
    return routes.join(told, [*af, "key", "origin"], "left").select(*identity, state.alias("state"))


def slurm(vrps: DataFrame, filters: DataFrame, assertions: DataFrame) -> DataFrame:
    """VRPs without those a filter names by AS number, by covering prefix or by both, and with the assertions, which aren't filtered."""
    by_asn = filters.where(F.col("key").isNull() & F.col("asn").isNotNull()).select("asn").distinct()
    kept = vrps.join(by_asn, "asn", "left_anti")
    named = filters.where(F.col("key").isNotNull()).select("key", "asn").withColumn("plen", F.length("key"))
    hit = covering(kept.select("key", "plen", "asn", "max_length"), named).where(F.col("cover_asn").isNull() | (F.col("cover_asn") == F.col("asn")))
    left = kept.join(hit.select("key", "asn", "max_length").distinct(), ["key", "asn", "max_length"], "left_anti")
    return left.select(*vrps.columns).unionByName(assertions.select(*vrps.columns))


def more_specific(routes: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of asked (key, plen) with the strictly more specific routes, as route_*."""
    found = covering(routes, asked)
    return found.where(F.col("plen") > F.col("cover_plen"))


def one_level_less(routes: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked prefix the covering routes of the greatest length that any registry has, itself left out."""
    found = covering(asked.select("key", "plen").distinct(), routes).where(F.col("cover_plen") < F.col("plen"))
    longest = found.groupBy("key").agg(F.max("cover_plen").alias("__longest"))
    return found.join(longest, "key").where(F.col("cover_plen") == F.col("__longest")).drop("__longest")
