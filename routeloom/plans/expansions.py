"""Queries of route-sets whose leaves come from AS numbers, as-sets, claims and named registries, and of the mirror, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expand
from ..sources.synthetic import SOURCES
from ..sources.synthetic import registry as load
from ..streaming.mirror import Mirror
from .queries import OWN, RANK, after, query
from .scratch import folder

#: Sets by the names that they are known by: their own if they win, SOURCE::NAME if not; members likewise.
NAMED = f"""won_rs AS (SELECT set_name, source FROM (SELECT *, row_number() OVER (PARTITION BY set_name ORDER BY {RANK}) AS rn FROM route_sets) WHERE rn = 1),
    named AS (SELECT set_name, source, CASE WHEN (set_name, source) IN (SELECT (set_name, source) FROM won_rs) THEN set_name ELSE source || '::' || set_name END AS name FROM route_sets),
    own_rs AS (SELECT n.name AS set_name, m.asn, CASE WHEN m.child_source IS NULL THEN m.child ELSE coalesce(c.name, m.child_source || '::' || m.child) END AS child, m.addr, m.plen, m.op
        FROM route_set_members m JOIN named n ON m.set_name = n.set_name AND m.source = n.source LEFT JOIN named c ON c.set_name = m.child AND c.source = m.child_source)"""
#: An AS number or as-set in a route-set stands for routes; an operator behind an as-set holds for all of them.
STATES = f"""{OWN}, {NAMED}, steps AS (SELECT set_name AS parent, child, op FROM own_rs WHERE child IS NOT NULL UNION SELECT parent, child, '' FROM edges),
    walk AS (SELECT DISTINCT name AS top, name AS node, '' AS op FROM named UNION SELECT top, child, CASE WHEN steps.op <> '' THEN steps.op ELSE walk.op END FROM walk JOIN steps ON node = parent),
    allowed AS (SELECT addr, plen, member_of FROM route_claims JOIN route_sets ON member_of = set_name AND route_claims.source = route_sets.source JOIN won_rs ON won_rs.set_name = route_sets.set_name AND won_rs.source = route_sets.source WHERE mbrs_by_ref = 'ANY' OR mbrs_by_ref = mnt),
    numbers AS (SELECT set_name, asn, op FROM own_rs WHERE asn IS NOT NULL UNION SELECT set_name, asn, '' FROM own WHERE asn IS NOT NULL),
    leaves AS (SELECT set_name, routes.addr, routes.plen, op FROM numbers JOIN routes ON origin = asn UNION SELECT set_name, addr, plen, op FROM own_rs WHERE addr IS NOT NULL UNION SELECT member_of, addr, plen, '' FROM allowed),
    found AS (SELECT DISTINCT top, addr, plen, CASE walk.op WHEN '' THEN plen ELSE greatest(25, plen) END AS lo, CASE walk.op WHEN '' THEN CASE leaves.op WHEN '' THEN plen ELSE 32 END ELSE 26 END AS hi FROM walk JOIN leaves ON node = set_name)"""


def route_set_tables(spark, sf_dir):
    """Chosen members of route-sets and of the as-sets that they name, and the claims that the winning sets admit."""
    sets, members, as_sets, as_members, routes, claims = load(spark, sf_dir, "route_sets", "route_set_members", "sets", "members", "routes", "route_claims")
    own = expand.chosen_members(sets, members, SOURCES).select("set_name", "asn", "child", "addr", "plen", "op")
    none = F.lit(None).cast("long")
    of_as_sets = expand.chosen_members(as_sets, as_members, SOURCES).select("set_name", "asn", "child", none.alias("addr"), none.cast("int").alias("plen"), F.lit("").alias("op"))
    won = expand.winners(sets, ["set_name"], SOURCES)
    tops = expand.named_sets(sets, SOURCES).select(F.col("name").alias("top"))
    return tops, own.union(of_as_sets), routes, expand.allowed_claims(won, claims)


@query(after(STATES, "SELECT top, addr, plen::INTEGER AS plen, lo::INTEGER AS lo, hi::INTEGER AS hi FROM found WHERE lo <= hi"), "sets", "members", "routes", "route_sets", "route_set_members", "route_claims")
def route_set_members(spark, sf_dir):
    """Ranges of route-sets: listed prefixes, routes of AS numbers, of as-sets under an operator and of claims, and sets of a named registry."""
    tops, members, routes, claims = route_set_tables(spark, sf_dir)
    found = expand.expand_ranges(tops, members, routes, claims)
    return found.select("top", "addr", *[F.col(c).cast("int").alias(c) for c in ("plen", "lo", "hi")])


@query(
    after(f"{NAMED}, steps AS (SELECT set_name AS parent, child FROM own_rs WHERE child IN (SELECT name FROM named)), walk AS (SELECT name AS top, name AS node FROM named UNION SELECT top, child FROM walk JOIN steps ON node = parent)", "SELECT top, node FROM walk"),
    "route_sets",
    "route_set_members",
)
def scoped_members(spark, sf_dir):
    """What route-sets reach where some members name the registry of a set."""
    sets, members = load(spark, sf_dir, "route_sets", "route_set_members")
    tops = expand.named_sets(sets, SOURCES).select(F.col("name").alias("top"))
    return expand.expand_sets(tops, sets, members, SOURCES).select("top", "node")


@query(
    "SELECT class, pk, source, payload FROM (SELECT class, pk, source, operation, CASE WHEN operation = 'ADD' THEN payload::VARCHAR END AS payload, row_number() OVER (PARTITION BY class, pk, source ORDER BY seq // 500 DESC, seq DESC) AS rn FROM mutations) WHERE rn = 1 AND operation <> 'DEL'",
    "mutations",
)
def mirror_state(spark, sf_dir):
    """The mirror's objects after a snapshot and deltas of 500 records, in which one object is often added and deleted."""
    (mutations,) = load(spark, sf_dir, "mutations")
    payload = F.when(F.col("operation") == "ADD", F.col("payload").cast("string"))
    version = F.floor(F.col("seq") / 500) + 1
    kind = F.when(F.floor(F.col("seq") / 500) == 0, "snapshot").otherwise("delta")
    records = mutations.select(F.lit("s1").alias("session"), version.alias("version"), kind.alias("kind"), "operation", "class", "pk", "source", payload.alias("payload"), F.col("seq").alias("place"))
    mirror = Mirror(spark, f"{folder(spark)}/mirror-{spark.sparkContext.applicationId}-{id(records)}")
    mirror.apply(records)
    return mirror.objects().select("class", "pk", "source", "payload")
