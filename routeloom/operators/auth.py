"""Who may change what: maintainers of an object, of the space and the numbers around it, and of what it refers to.

A check is a table of requirements: each row is one list of maintainers, one of which must accept the credential. An update is allowed if
all of its rows are met. Credentials are checked by a function that the caller gives; schemes it doesn't know are told apart from wrong
credentials.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cover import covering
from .registry import in_blocks

#: verifier(scheme, value, credential): True, False, or None for a scheme that it can't check.
Verifier = Callable[[str, str, str], bool | None]


def accepted(mntners: DataFrame, credentials: DataFrame, verifier: Verifier) -> DataFrame:
    """(update_id, mnt, ok, unsupported): each maintainer (mnt, auth array) against each credential (update_id, mnt, credential) given for it."""

    @F.udf("struct<ok:boolean,unsupported:boolean>", useArrow=True)
    def check(auth, credential):
        told = [verifier(*(line.split(None, 1) + [""])[:2], credential) for line in auth]
        return {"ok": any(t is True for t in told), "unsupported": any(t is None for t in told)}

    given = credentials.select("update_id", F.upper("mnt").alias("mnt"), "credential")
    asked = given.join(mntners.select(F.upper("mnt").alias("mnt"), "auth"), "mnt").select("update_id", "mnt", check("auth", "credential").alias("t"))
    return asked.groupBy("update_id", "mnt").agg(F.max("t.ok").alias("ok"), F.max("t.unsupported").alias("unsupported"))


def decide(requirements: DataFrame, answers: DataFrame) -> DataFrame:
    """(update_id, allowed, unsupported, missing): whether each requirement (update_id, reason, mnts) has a maintainer that accepts; a requirement without maintainers is never met."""
    named = requirements.select("update_id", "reason", F.explode_outer(F.array_distinct(F.transform("mnts", lambda x: F.upper(F.trim(x))))).alias("mnt"))
    met = named.join(answers, ["update_id", "mnt"], "left").groupBy("update_id", "reason").agg(F.coalesce(F.max("ok"), F.lit(False)).alias("ok"), F.coalesce(F.max("unsupported"), F.lit(False)).alias("unsupported"))
    return met.groupBy("update_id").agg(F.min("ok").alias("allowed"), F.max(F.col("unsupported") & ~F.col("ok")).alias("unsupported"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("reason")))).alias("missing"))


def route_requirements(updates: DataFrame, aut_nums: DataFrame, space: DataFrame) -> DataFrame:
    """What a new route needs: its own maintainers, those of its origin, and those of the address space around it.

    updates has (update_id, key, plen, origin, mnts); aut_nums (asn, mnts, mnt_routes); space (key, plen, mnts, mnt_lower, mnt_routes) routes
    and inetnums. The most specific object that covers the route answers for the space, by mnt-routes, else mnt-lower, else mnt-by.
    """
    own = updates.select("update_id", F.lit("object").alias("reason"), "mnts")
    first = lambda *names: F.coalesce(*[F.when(F.size(F.col(n)) > 0, F.col(n)) for n in names], F.array().cast("array<string>"))
    origin = updates.select("update_id", "origin").join(aut_nums.select("asn", first("mnt_routes", "mnts").alias("mnts")), F.col("origin") == F.col("asn"), "left").select("update_id", F.lit("origin").alias("reason"), "mnts")
    around = covering(updates.select("update_id", "key", "plen"), space.withColumn("authority", first("mnt_routes", "mnt_lower", "mnts")))
    nearest = around.groupBy("update_id").agg(F.max_by("cover_authority", "cover_plen").alias("mnts"))
    held = updates.select("update_id").join(nearest, "update_id", "left").select("update_id", F.lit("space").alias("reason"), "mnts")
    return own.unionByName(origin).unionByName(held)


def aut_num_requirements(updates: DataFrame, blocks: DataFrame) -> DataFrame:
    """What a new aut-num (update_id, asn, mnts) needs: its own maintainers, and those of the smallest as-block (lo, hi, mnts, mnt_lower) around it."""
    own = updates.select("update_id", F.lit("object").alias("reason"), "mnts")
    authority = F.when(F.size("mnt_lower") > 0, F.col("mnt_lower")).otherwise(F.col("mnts"))
    around = in_blocks(updates.select("update_id", "asn"), blocks.select("lo", "hi", authority.alias("authority")))
    nearest = around.groupBy("update_id").agg(F.max_by("authority", F.col("lo") - F.col("hi")).alias("mnts"))
    return own.unionByName(updates.select("update_id").join(nearest, "update_id", "left").select("update_id", F.lit("as-block").alias("reason"), "mnts"))


def set_requirements(updates: DataFrame, sets: DataFrame, aut_nums: DataFrame) -> DataFrame:
    """What a new set (update_id, set_name, mnts) needs: its own maintainers, and for a hierarchical name those of its parent, a set or an aut-num."""
    own = updates.select("update_id", F.lit("object").alias("reason"), "mnts")
    nested = updates.where(F.col("set_name").contains(":")).select("update_id", F.expr("substring(set_name, 1, length(set_name) - length(substring_index(set_name, ':', -1)) - 1)").alias("parent"))
    authority = F.when(F.size("mnt_lower") > 0, F.col("mnt_lower")).otherwise(F.col("mnts"))
    parents = sets.select(F.col("set_name").alias("parent"), authority.alias("mnts")).unionByName(aut_nums.select(F.concat(F.lit("AS"), F.col("asn").cast("string")).alias("parent"), "mnts"))
    return own.unionByName(nested.join(parents, "parent", "left").select("update_id", F.lit("parent").alias("reason"), "mnts"))


def referral_chain(mntners: DataFrame, tops: DataFrame, max_depth: int = 16) -> DataFrame:
    """(top, node, depth): maintainers that are reached by referral-by."""
    from .expand import closure

    edges = mntners.where("referral_by IS NOT NULL AND upper(referral_by) <> upper(mnt)").select(F.upper("mnt").alias("parent"), F.upper("referral_by").alias("child"))
    return closure(tops.select(F.upper("mnt").alias("top"), F.upper("mnt").alias("node")), edges, ["node"], max_depth)
