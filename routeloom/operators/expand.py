"""Recursive expansion of named sets, for any number of top sets at once.

A closure goes level by level: the frontier is joined to the edges, what was reached before is removed, and the rest is the next
frontier, so a set is met once for each top at its shortest distance, and cycles end. Each level is a written table, or, if it has a few
thousand rows at most, a table that the plan holds; nothing else but the number of new rows comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import apply_operator, apply_stack, push_operator
from ..plans.scratch import written

MAX_DEPTH = 32
MAX_VISITED = 131_072
#: Levels that are kept as tables of their own before they are written as one.
COMPACT = 8
RESERVED = ("AS-ANY", "RS-ANY", "RTRS-ANY", "PRNG-ANY", "FLTR-ANY")


class SetTooLarge(Exception):
    """A closure goes past its limit of depth or of sets."""


#: Rows of a level that are kept with the plan instead of a written table.
FEW = 5_000


def level(rows: DataFrame, after_few: bool) -> tuple[DataFrame, int | None]:
    """A level of a closure, cut from its plan, and its rows if they are FEW at most. A level that comes after few is looked at first; others are written at once."""
    if after_few:
        held = rows.limit(FEW + 1).toArrow()
        if held.num_rows <= FEW:
            return rows.sparkSession.createDataFrame(held, rows.schema), held.num_rows
    return written(rows, "level"), None


def closure(tops: DataFrame, edges: DataFrame, state: list[str], max_depth: int = MAX_DEPTH, max_visited: int = MAX_VISITED, step=None) -> DataFrame:
    """tops(top, *state) and all states reached through edges, with their depth.

    edges has `parent` (matched with the first column of state) and what `step` makes the next state from; without a step,
    the next state is the column `child`. A set deeper than max_depth is an error, not cut off; so are more than max_visited states of
    one top, looked for at the end and whenever levels are written as one.
    """

    def check(found: DataFrame) -> None:
        if not found.groupBy("top").count().where(F.col("count") > max_visited).isEmpty():
            raise SetTooLarge(f"a set holds more than {max_visited} sets")

    key = ["top", *state]
    edges = written(edges, "edges")
    frontier, few = level(tops.select(*key).distinct().withColumn("depth", F.lit(0)), True)
    levels, depth = [frontier], 0
    while True:
        joined = frontier.join(edges, F.col(state[0]) == F.col("parent"))
        onward = joined.select("top", *(step(joined) if step else [F.col("child").alias(state[0])])).distinct()
        seen = reduce(DataFrame.unionByName, levels).select(*key)
        fresh = onward.join(seen, [onward[k].eqNullSafe(seen[k]) for k in key], "left_anti")
        frontier, few = level(fresh.withColumn("depth", F.lit(depth + 1)), few is not None)
        if few == 0 or few is None and frontier.isEmpty():
            break
        depth += 1
        levels.append(frontier)
        if len(levels) > COMPACT:
            levels = [written(reduce(DataFrame.unionByName, levels), "levels")]
        if depth > max_depth:
            raise SetTooLarge(f"sets nest deeper than {max_depth}")
        if len(levels) == 1:
            check(levels[0])
    found = reduce(DataFrame.unionByName, levels)
    check(found)
    return found


def nestable(parent: Column, child: Column) -> Column:
    """Which classes may stand in which: as-sets in as-sets, route-sets and as-sets in route-sets, others in their own class."""
    same = parent == child
    return same | ((parent == "route-set") & (child == "as-set"))


def class_of(name: Column) -> Column:
    """Class of a set name: that of its first set component."""
    part = F.element_at(F.filter(F.split(F.upper(name), ":"), lambda x: x.rlike("^(AS|RS|RTRS|FLTR|PRNG)-")), 1)
    prefix = F.regexp_extract(part, "^([A-Z]+)-", 1)
    return F.when(prefix == "AS", "as-set").when(prefix == "RS", "route-set").when(prefix == "RTRS", "rtr-set").when(prefix == "FLTR", "filter-set").when(prefix == "PRNG", "peering-set")


def winners(rows: DataFrame, identity: list[str], precedence: tuple[str, ...], order: list[str] | None = None) -> DataFrame:
    """One row for each identity: that of the source listed first, then by `order`; unlisted sources come last.

    Aggregation with partial maxima, not a window, so that an identity with very many rows is reduced before the shuffle.
    """
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(k)) for k, s in enumerate(precedence)], F.lit(len(precedence)))
    rest = [c for c in rows.columns if c not in identity]
    best = rows.groupBy(*identity).agg(F.min(F.struct(rank.alias("__rank"), *(order or []), *[F.col(c).alias(f"__{c}") for c in rest])).alias("best"))
    return best.select(*identity, *[F.col(f"best.__{c}").alias(c) for c in rest])


def scoped(source: Column | str, name: Column | str) -> Column:
    return F.concat_ws("::", source, name)


def named_sets(sets: DataFrame, precedence: tuple[str, ...]) -> DataFrame:
    """(set_name, source, name): every set with the name that it is known by, its own if it wins by precedence and SOURCE::NAME if not."""
    held = sets.select("set_name", "source").distinct()
    won = winners(held, ["set_name"], precedence).withColumn("__won", F.lit(True))
    name = F.when(F.col("__won"), F.col("set_name")).otherwise(scoped("source", "set_name"))
    return held.join(won, ["set_name", "source"], "left").select("set_name", "source", name.alias("name"))


def chosen_members(sets: DataFrame, members: DataFrame, precedence: tuple[str, ...]) -> DataFrame:
    """Members of the sets that win by precedence.

    Where members have a column child_source, a reference may name a registry: then the members of all sets are there under the names
    of `named_sets`, and a child is the one of its registry, as SOURCE::NAME if that isn't the winner or isn't there at all.
    """
    if "child_source" not in members.columns:
        won = winners(sets.select("set_name", "source"), ["set_name"], precedence)
        return members.join(won, ["set_name", "source"])
    names = named_sets(sets, precedence)
    asked = names.select(F.col("set_name").alias("child"), F.col("source").alias("child_source"), F.col("name").alias("__child"))
    own = members.join(names, ["set_name", "source"]).join(asked, ["child", "child_source"], "left")
    child = F.when(F.col("child_source").isNull(), F.col("child")).otherwise(F.coalesce("__child", scoped("child_source", "child")))
    told = {"set_name": F.col("name"), "child": child}
    return own.select(*[told.get(c, F.col(c)).alias(c) for c in members.columns])


def edges_of(members: DataFrame, sets: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(parent, child) between sets that exist and may nest; reserved and excluded names are never followed."""
    nested = members.where(F.col("child").isNotNull() & ~F.upper(F.substring_index("child", "::", -1)).isin(*RESERVED))
    if excluded:
        nested = nested.where(~F.col("child").isin(*excluded))
    known = sets.select(F.col("set_name").alias("child")).distinct()
    return nested.where(nestable(class_of(F.col("set_name")), class_of(F.col("child")))).join(known, "child").select(F.col("set_name").alias("parent"), "child").distinct()


def missing(reached: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(top, missing): nested names that no registry has."""
    named = reached.join(members.where(F.col("child").isNotNull()), reached["node"] == members["set_name"]).select("top", F.col("child").alias("missing"))
    known = sets.select(F.explode(F.array("set_name", scoped("source", "set_name"))).alias("missing"))
    return named.join(known, "missing", "left_anti").select("top", "missing").distinct()


def expand_sets(tops: DataFrame, sets: DataFrame, members: DataFrame, precedence: tuple[str, ...], excluded: list[str] | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(top, node, depth) of all sets in the tops; a top is a column `top` and is never excluded itself."""
    own = chosen_members(sets, members, precedence)
    known = named_sets(sets, precedence).select(F.col("name").alias("set_name")) if "child_source" in members.columns else sets
    return closure(tops.select("top", F.col("top").alias("node")), edges_of(own, known, excluded), ["node"], max_depth)


def allowed_claims(sets: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims on sets of the same source that admit any claimant, or one with a shared maintainer; only A-Z are folded."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    admits = F.transform(F.split("mbrs_by_ref", ","), lambda x: F.trim(fold(x)))
    owned = sets.where(F.col("mbrs_by_ref") != "").select("set_name", F.trim(fold(F.col("source"))).alias("__source"), admits.alias("__admits"))
    made = claims.withColumn("__source", F.trim(fold(F.col("source")))).withColumn("__mnt", F.transform(F.split("mnt", ","), lambda x: F.trim(fold(x))))
    joined = made.join(owned, (made["member_of"] == owned["set_name"]) & made["__source"].eqNullSafe(owned["__source"]))
    return joined.where(F.array_contains("__admits", "any") | F.arrays_overlap("__mnt", "__admits")).select(*claims.columns)


def expand_as(reached: DataFrame, members: DataFrame, claims: DataFrame | None = None, excluded: list[int] | None = None) -> DataFrame:
    """(top, asn): AS numbers of all sets reached, with the allowed claims on them."""
    leaves = members.where(F.col("asn").isNotNull()).select("set_name", "asn")
    if claims is not None:
        leaves = leaves.unionByName(claims.select(F.col("member_of").alias("set_name"), "asn"))
    if excluded:
        leaves = leaves.where(~F.col("asn").isin(*excluded))
    return reached.join(leaves, reached["node"] == leaves["set_name"]).select("top", "asn").distinct()


def originated(asns: DataFrame, routes: DataFrame) -> DataFrame:
    """(top, addr, plen): distinct routes that the AS numbers originate, in any registry."""
    return asns.join(routes, asns["asn"] == routes["origin"]).select("top", "addr", "plen").distinct()


def expand_ranges(tops: DataFrame, members: DataFrame, routes: DataFrame | None = None, claims: DataFrame | None = None, max_rounds: int = 66 * MAX_DEPTH) -> DataFrame:
    """(top, addr, plen, lo, hi) of route-sets, operators composed along each path.

    members are those chosen by precedence and scope (see `chosen_members`), of route-sets and of the as-sets in them. Prefixes count with
    their operators; AS numbers, those of nested as-sets and of claiming aut-nums included, with the routes that they originate in any
    registry; claiming routes with their own prefix. claims are the allowed ones (class, asn, addr, plen, member_of). Without routes
    or claims only what is listed counts.

    A state is a set with the operator stack of the path to it, so that the closure is a least fixpoint over (set, stack). Rounds
    are bounded by how often a lower bound can rise along a path, not by the depth of sets.
    """
    stack = ["a", "c", "k", "h"]
    start = tops.select("top", F.col("top").alias("node"), *[F.lit(None if x == "h" else 0).cast("int").alias(x) for x in stack])
    may_nest = nestable(class_of(F.col("set_name")), class_of(F.col("child"))) & ~F.upper(F.substring_index("child", "::", -1)).isin(*RESERVED)
    nested = members.where(F.col("child").isNotNull() & may_nest).select(F.col("set_name").alias("parent"), "child", "op").distinct()

    def step(joined: DataFrame) -> list[Column]:
        pushed = push_operator({x: F.col(x) for x in stack}, F.col("op"))
        return [F.col("child").alias("node"), *[pushed[x].alias(x) for x in stack]]

    states = closure(start, nested, ["node", *stack], max_rounds, step=step)
    leaves = members.where(F.col("addr").isNotNull()).select("set_name", "addr", F.col("plen").cast("int").alias("plen"), "op")
    numbers = members.where(F.col("asn").isNotNull()).select("set_name", "asn", "op") if "asn" in members.columns else None
    if claims is not None:
        named = F.col("member_of").alias("set_name")
        leaves = leaves.union(claims.where("addr IS NOT NULL").select(named, "addr", F.col("plen").cast("int"), F.lit("")))
        claimed = claims.where("addr IS NULL AND asn IS NOT NULL").select(named, "asn", F.lit("").alias("op"))
        numbers = claimed if numbers is None else numbers.union(claimed)
    if routes is not None and numbers is not None:
        held = routes.select(F.col("origin").alias("asn"), "addr", F.col("plen").cast("int").alias("plen")).distinct()
        leaves = leaves.union(numbers.distinct().join(held, "asn").select("set_name", "addr", "plen", "op"))
    low, high = apply_operator(F.col("plen"), F.col("plen"), F.col("op"))
    leaves = leaves.withColumns({"lo": low, "hi": high}).where(F.col("lo").isNotNull()).select("set_name", "addr", "plen", "lo", "hi")
    joined = states.join(leaves, states["node"] == leaves["set_name"])
    low, high = apply_stack(F.col("lo"), F.col("hi"), {x: F.col(x) for x in stack})
    return joined.select("top", "addr", "plen", low.alias("lo"), high.alias("hi")).where(F.col("lo").isNotNull()).distinct()
