"""The registry's queries over the synthetic registry, each with the same answer in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prefix as px
from ..operators import auth, cover, expand, generate, model, policy, registry, space
from ..operators import members as other_sets
from .scratch import written
from ..sources.synthetic import OCTETS, SOURCES, with_views
from ..sources.synthetic import registry as load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views)
        return f

    return add


# ---- SQL pieces

RANK = "CASE source WHEN 'RIPE' THEN 0 WHEN 'RADB' THEN 1 ELSE 2 END"
#: Members of the sets that win by precedence, edges between sets that exist, and all that AS-WORLD and each region reach.
OWN = f"""won AS (SELECT set_name, source FROM (SELECT *, row_number() OVER (PARTITION BY set_name ORDER BY {RANK}) AS rn FROM sets) WHERE rn = 1),
    own AS (SELECT members.* FROM members JOIN won USING (set_name, source)),
    edges AS (SELECT DISTINCT set_name AS parent, child FROM own WHERE child IN (SELECT set_name FROM sets))"""
REACH = f"""{OWN}, tops AS (SELECT DISTINCT set_name AS top FROM sets),
    reached AS (SELECT top, top AS node FROM tops UNION SELECT top, child FROM reached JOIN edges ON node = parent)"""
ASNS = f"{REACH}, asns AS (SELECT DISTINCT top, asn FROM reached JOIN own ON set_name = node WHERE asn IS NOT NULL)"
CLAIMED = """allowed AS (SELECT claims.* FROM claims JOIN sets ON member_of = set_name AND lower(claims.source) = lower(sets.source)
    WHERE mbrs_by_ref = 'ANY' OR list_contains(list_transform(string_split(lower(mbrs_by_ref), ','), lambda x: trim(x)), lower(claims.mnt)))"""
KEYED = "substr(lpad(bin(addr), 32, '0'), 1, plen) AS key"
TEXT = OCTETS


def reached(spark: SparkSession, sf_dir: str, tops: DataFrame | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    sets, members = load(spark, sf_dir, "sets", "members")
    tops = sets.select(F.col("set_name").alias("top")).distinct() if tops is None else tops
    return expand.expand_sets(tops, sets, members, SOURCES, **kw), expand.chosen_members(sets, members, SOURCES)


def world(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("AS-WORLD",)], "top string")


# ---- recursive expansion


def after(ctes: str, select: str) -> str:
    """More tables after the views, then the query; `with_views` puts the views before."""
    return f", {ctes} {select}"


@query(after(ASNS, "SELECT top, asn FROM asns"), "sets", "members")
def asn_closure(spark, sf_dir):
    nodes, members = reached(spark, sf_dir)
    return expand.expand_as(nodes, members)


@query(after(ASNS, f"SELECT DISTINCT concat({TEXT.format('addr')}, '/', plen) AS prefix FROM asns JOIN routes ON origin = asn WHERE top = 'AS-WORLD'"), "sets", "members", "routes")
def as_set_prefixes(spark, sf_dir):
    nodes, members = reached(spark, sf_dir, world(spark))
    (routes,) = load(spark, sf_dir, "routes")
    found = expand.originated(expand.expand_as(nodes, members), routes)
    return found.select(px.prefix_text(F.col("addr"), F.col("plen")).alias("prefix")).distinct()


@query(
    after(f"{OWN}, tops AS (SELECT DISTINCT set_name AS top FROM sets), walk AS (SELECT top, top AS node, 0 AS depth FROM tops UNION SELECT top, child, depth + 1 FROM walk JOIN edges ON node = parent WHERE depth < 8)", "SELECT top, node, min(depth) AS depth FROM walk GROUP BY ALL"),
    "sets",
    "members",
)
def set_depth(spark, sf_dir):
    return reached(spark, sf_dir)[0]


@query(after(REACH, "SELECT DISTINCT top, child AS missing FROM reached JOIN own ON node = set_name WHERE child IS NOT NULL AND child NOT IN (SELECT set_name FROM sets)"), "sets", "members")
def set_missing(spark, sf_dir):
    nodes, members = reached(spark, sf_dir)
    (sets,) = load(spark, sf_dir, "sets")
    return expand.missing(nodes, members, sets)


@query(after(REACH, "SELECT DISTINCT top AS set_name FROM reached JOIN edges ON node = parent WHERE child = top"), "sets", "members")
def set_cycles(spark, sf_dir):
    sets, members = load(spark, sf_dir, "sets", "members")
    edges = expand.edges_of(expand.chosen_members(sets, members, SOURCES), sets)
    nodes = expand.closure(sets.select(F.col("set_name").alias("top"), F.col("set_name").alias("node")), edges, ["node"])
    back = nodes.join(edges, (F.col("node") == F.col("parent")) & (F.col("child") == F.col("top")))
    return back.select(F.col("top").alias("set_name")).distinct()


@query(after(CLAIMED, "SELECT asn, member_of, source FROM allowed"), "sets", "claims")
def claims_allowed(spark, sf_dir):
    sets, claims = load(spark, sf_dir, "sets", "claims")
    return expand.allowed_claims(sets, claims).select("asn", "member_of", "source")


@query(after(CLAIMED, "SELECT asn, member_of, source FROM claims WHERE (asn, member_of) NOT IN (SELECT (asn, member_of) FROM allowed)"), "sets", "claims")
def claims_rejected(spark, sf_dir):
    sets, claims = load(spark, sf_dir, "sets", "claims")
    return claims.join(expand.allowed_claims(sets, claims), ["asn", "member_of"], "left_anti").select("asn", "member_of", "source")


@query(after(f"{ASNS}, {CLAIMED}", "SELECT top, asn FROM asns UNION SELECT top, allowed.asn FROM reached JOIN allowed ON member_of = node"), "sets", "members", "claims")
def claimed_closure(spark, sf_dir):
    sets, claims = load(spark, sf_dir, "sets", "claims")
    nodes, members = reached(spark, sf_dir)
    return expand.expand_as(nodes, members, expand.allowed_claims(sets, claims))


@query(after(OWN, "SELECT set_name, source FROM won"), "sets", "members")
def precedence_winner(spark, sf_dir):
    (sets,) = load(spark, sf_dir, "sets")
    return expand.winners(sets.select("set_name", "source"), ["set_name"], SOURCES)


@query(
    after(f"{OWN}, reached AS (SELECT 'AS-WORLD' AS node UNION SELECT child FROM reached JOIN edges ON node = parent WHERE child NOT IN ('AS-R1', 'AS-N3'))", "SELECT DISTINCT asn FROM reached JOIN own ON set_name = node WHERE asn IS NOT NULL AND asn <> 100001"),
    "sets",
    "members",
)
def exclude_set(spark, sf_dir):
    nodes, members = reached(spark, sf_dir, world(spark), excluded=["AS-R1", "AS-N3"])
    return expand.expand_as(nodes, members, excluded=[100001]).select("asn")


@query(f"SELECT DISTINCT origin, concat({TEXT.format('addr')}, '/', plen) AS prefix FROM routes", "routes")
def originated_routes(spark, sf_dir):
    (routes,) = load(spark, sf_dir, "routes")
    return routes.select("origin", px.prefix_text(F.col("addr"), F.col("plen")).alias("prefix")).distinct()


@query("SELECT origin, count(DISTINCT (addr, plen)) AS n_prefixes, min(plen)::INTEGER AS shortest, max(plen)::INTEGER AS longest FROM routes GROUP BY origin", "routes")
def routes_per_origin(spark, sf_dir):
    (routes,) = load(spark, sf_dir, "routes")
    return routes.groupBy("origin").agg(F.countDistinct("addr", "plen").alias("n_prefixes"), F.min("plen").cast("int").alias("shortest"), F.max("plen").cast("int").alias("longest"))


# ---- ranges and operators

WINDOW = "CASE {op} WHEN '' THEN {lo} WHEN '^+' THEN {lo} WHEN '^-' THEN {lo} + 1 WHEN '^26' THEN greatest(26, {lo}) WHEN '^26-28' THEN greatest(26, {lo}) WHEN '^24-26' THEN greatest(24, {lo}) ELSE greatest(25, {lo}) END"
TOP = "CASE {op} WHEN '' THEN {hi} WHEN '^+' THEN 32 WHEN '^-' THEN 32 WHEN '^26' THEN 26 WHEN '^26-28' THEN 28 WHEN '^24-26' THEN 26 ELSE 27 END"
LEAVES = f"leaves AS (SELECT set_name, addr, plen, {WINDOW.format(op='op', lo='plen')} AS lo, {TOP.format(op='op', hi='plen')} AS hi FROM range_members WHERE addr IS NOT NULL)"


@query(after(LEAVES, "SELECT DISTINCT set_name, addr, plen::INTEGER AS plen, lo::INTEGER AS lo, hi::INTEGER AS hi FROM leaves WHERE lo <= hi"), "range_members")
def range_apply_operator(spark, sf_dir):
    (members,) = load(spark, sf_dir, "range_members")
    low, high = px.apply_operator(F.col("plen"), F.col("plen"), F.col("op"))
    leaves = members.where("addr IS NOT NULL").select("set_name", "addr", F.col("plen").cast("int").alias("plen"), low.cast("int").alias("lo"), high.cast("int").alias("hi"))
    return leaves.where("lo IS NOT NULL").distinct()


@query(after(LEAVES, "SELECT op, count(*) AS n, min(hi - lo)::INTEGER AS narrowest FROM (SELECT CASE WHEN lo = plen AND hi = plen THEN '' WHEN lo = plen AND hi = 32 THEN '^+' WHEN lo = plen + 1 AND hi = 32 THEN '^-' WHEN lo = hi THEN '^n' ELSE '^n-m' END AS op, lo, hi FROM leaves) GROUP BY op"), "range_members")
def prefix_ranges(spark, sf_dir):
    (members,) = load(spark, sf_dir, "range_members")
    low, high = px.apply_operator(F.col("plen"), F.col("plen"), F.col("op"))
    named = F.when((low == F.col("plen")) & (high == F.col("plen")), "").when((low == F.col("plen")) & (high == 32), "^+").when((low == F.col("plen") + 1) & (high == 32), "^-").when(low == high, "^n").otherwise("^n-m")
    return members.where("addr IS NOT NULL").select(named.alias("op"), (high - low).alias("w")).groupBy("op").agg(F.count("*").alias("n"), F.min("w").cast("int").alias("narrowest"))


#: A path in SQL is what it makes of each lower bound from 24 to 33 (null: deleted), and its outermost upper bound.
PATHS = f"""{LEAVES},
    nested AS (SELECT DISTINCT set_name AS parent, child, op, CASE op WHEN '^26-28' THEN 26 ELSE 0 END AS n, CASE op WHEN '^26-28' THEN 28 ELSE 32 END AS m, CASE op WHEN '^-' THEN 1 ELSE 0 END AS d FROM range_members WHERE child IS NOT NULL),
    walk AS (SELECT DISTINCT set_name AS top, set_name AS node, range(24, 34) AS f, NULL::BIGINT AS h FROM range_members
        UNION SELECT top, child, CASE WHEN op = '' THEN f ELSE list_transform(range(24, 34), lambda x: CASE WHEN greatest(n, x + d) > m THEN NULL ELSE f[greatest(n, x + d) - 23] END) END, CASE WHEN op = '' THEN h ELSE coalesce(h, m) END FROM walk JOIN nested ON node = parent),
    found AS (SELECT DISTINCT top, addr, plen, CASE WHEN h IS NULL THEN lo ELSE f[lo - 23] END AS lo, coalesce(h, hi) AS hi FROM walk JOIN leaves ON node = set_name WHERE lo <= hi)"""


@query(after(PATHS, "SELECT top, addr, plen::INTEGER AS plen, lo::INTEGER AS lo, hi::INTEGER AS hi FROM found WHERE lo <= hi"), "range_members")
def route_set_ranges(spark, sf_dir):
    (members,) = load(spark, sf_dir, "range_members")
    found = expand.expand_ranges(members.select(F.col("set_name").alias("top")).distinct(), members)
    return found.select("top", "addr", *[F.col(c).cast("int").alias(c) for c in ("plen", "lo", "hi")])


@query(
    after(LEAVES, "SELECT set_name, count(*) AS n FROM (SELECT DISTINCT set_name, n.l AS l, addr + i.i * (1 << (32 - n.l)) AS a FROM leaves, range(23, 33) n(l), range(0, 512) i(i) WHERE lo <= hi AND n.l BETWEEN lo AND hi AND i.i < (1 << (n.l - plen))) GROUP BY set_name"),
    "range_members",
)
def materialize_ranges(spark, sf_dir):
    ranges = range_apply_operator(spark, sf_dir)
    made = ranges.select("set_name", F.explode(px.materialized(F.col("addr"), F.col("plen"), F.col("lo"), F.col("hi"))).alias("p"))
    return made.select("set_name", "p.*").distinct().groupBy("set_name").agg(F.count("*").alias("n"))


RANGES = f"ranges AS (SELECT DISTINCT set_name, addr, plen, lo, hi, {KEYED} FROM leaves WHERE lo <= hi), asked AS (SELECT DISTINCT addr, plen, {KEYED} FROM routes)"


@query(after(f"{LEAVES}, {RANGES}", "SELECT set_name, count(*) AS n FROM (SELECT DISTINCT set_name, asked.key FROM ranges JOIN asked ON starts_with(asked.key, ranges.key) AND asked.plen BETWEEN lo AND hi) GROUP BY set_name"), "range_members", "routes")
def range_contains(spark, sf_dir):
    ranges = cover.with_key(range_apply_operator(spark, sf_dir))
    (routes,) = load(spark, sf_dir, "routes")
    found = cover.covering(cover.with_key(routes.select("addr", "plen").distinct()), ranges)
    inside = found.where(F.col("plen").between(F.col("cover_lo"), F.col("cover_hi")))
    return inside.select(F.col("cover_set_name").alias("set_name"), "key").distinct().groupBy("set_name").agg(F.count("*").alias("n"))


@query(
    after(f"{LEAVES}, {RANGES}, pairs AS (SELECT x.set_name, y.set_name AS other, greatest(x.lo, y.lo, x.plen, y.plen) AS lo, least(x.hi, y.hi) AS hi FROM ranges x JOIN ranges y ON (starts_with(x.key, y.key) OR starts_with(y.key, x.key)) AND x.set_name < y.set_name)", "SELECT set_name, other, count(*) AS n FROM pairs WHERE lo <= hi GROUP BY ALL"),
    "range_members",
    "routes",
)
def range_intersect(spark, sf_dir):
    ranges = cover.with_key(range_apply_operator(spark, sf_dir))
    found = cover.covering(ranges, ranges).where(F.col("set_name") != F.col("cover_set_name"))
    both = px.intersect(F.col("key"), F.col("lo"), F.col("hi"), F.col("cover_key"), F.col("cover_lo"), F.col("cover_hi"))
    # A pair with one base is met from both sides; one of them counts.
    once = found.where(both["key"].isNotNull() & ((F.col("key") != F.col("cover_key")) | (F.col("set_name") < F.col("cover_set_name"))))
    return once.groupBy(F.least("set_name", "cover_set_name").alias("set_name"), F.greatest("set_name", "cover_set_name").alias("other")).agg(F.count("*").alias("n"))


# ---- route search, RPKI

SEARCH = f"keyed AS (SELECT DISTINCT addr, plen, {KEYED}, origin FROM routes), asked AS (SELECT DISTINCT key, plen FROM keyed)"


def searched(spark, sf_dir):
    (routes,) = load(spark, sf_dir, "routes")
    keyed = cover.with_key(routes).select("addr", "plen", "key", "origin").distinct()
    return keyed, keyed.select("key", "plen").distinct()


@query(after(SEARCH, "SELECT key, origin FROM keyed JOIN asked USING (key, plen)"), "routes")
def route_search_exact(spark, sf_dir):
    keyed, asked = searched(spark, sf_dir)
    return keyed.join(asked, ["key", "plen"], "left_semi").select("key", "origin")


@query(after(SEARCH, "SELECT asked.key, keyed.plen::INTEGER AS plen, keyed.origin FROM asked JOIN keyed ON starts_with(asked.key, keyed.key)"), "routes")
def route_search_less(spark, sf_dir):
    keyed, asked = searched(spark, sf_dir)
    return cover.covering(asked, keyed).select("key", F.col("cover_plen").cast("int").alias("plen"), F.col("cover_origin").alias("origin"))


@query(after(f"{SEARCH}, less AS (SELECT asked.key, keyed.plen, keyed.origin FROM asked JOIN keyed ON starts_with(asked.key, keyed.key) AND keyed.plen < asked.plen)", "SELECT key, plen::INTEGER AS plen, origin FROM less WHERE plen = (SELECT max(l.plen) FROM less l WHERE l.key = less.key)"), "routes")
def route_search_one_less(spark, sf_dir):
    keyed, asked = searched(spark, sf_dir)
    return cover.one_level_less(keyed, asked).select("key", F.col("cover_plen").cast("int").alias("plen"), F.col("cover_origin").alias("origin"))


@query(after(SEARCH, "SELECT asked.key, keyed.key AS found, keyed.origin FROM asked JOIN keyed ON starts_with(keyed.key, asked.key) AND keyed.plen > asked.plen"), "routes")
def route_search_more(spark, sf_dir):
    keyed, asked = searched(spark, sf_dir)
    return cover.more_specific(keyed, asked).select(F.col("cover_key").alias("key"), F.col("key").alias("found"), "origin")


STATES = f"""keyed AS (SELECT DISTINCT addr, plen, {KEYED}, origin FROM routes), pays AS (SELECT DISTINCT {KEYED}, max_length, asn FROM vrps),
    told AS (SELECT keyed.key, keyed.origin, max((pays.asn = keyed.origin AND pays.asn <> 0 AND keyed.plen <= max_length)::INTEGER) AS m FROM keyed JOIN pays ON starts_with(keyed.key, pays.key) GROUP BY ALL),
    states AS (SELECT addr, plen, origin, CASE WHEN m = 1 THEN 'valid' WHEN m = 0 THEN 'invalid' ELSE 'not_found' END AS state FROM keyed LEFT JOIN told USING (key, origin))"""


def states(spark, sf_dir):
    routes, vrps = load(spark, sf_dir, "routes", "vrps")
    return cover.validate(cover.with_key(routes.select("addr", "plen", "origin").distinct()), cover.with_key(vrps), ["addr", "plen", "origin"])


@query(after(STATES, "SELECT addr, plen::INTEGER AS plen, origin, state FROM states"), "routes", "vrps")
def rpki_state(spark, sf_dir):
    return states(spark, sf_dir).withColumn("plen", F.col("plen").cast("int"))


@query(after(f"{ASNS}, {STATES}", "SELECT DISTINCT addr, plen::INTEGER AS plen FROM asns JOIN states ON origin = asn WHERE top = 'AS-R0' AND state <> 'invalid'"), "sets", "members", "routes", "vrps")
def rpki_filtered_prefixes(spark, sf_dir):
    nodes, members = reached(spark, sf_dir, spark.createDataFrame([("AS-R0",)], "top string"))
    kept = states(spark, sf_dir).where("state <> 'invalid'")
    return expand.originated(expand.expand_as(nodes, members), kept).select("addr", F.col("plen").cast("int").alias("plen")).distinct()


@query(
    after(
        f"pays AS (SELECT DISTINCT addr, plen, {KEYED}, max_length, asn FROM vrps), cut AS (SELECT * FROM pays WHERE asn <> 0 AND NOT starts_with(key, substr(lpad(bin(167772160), 32, '0'), 1, 18)) AND NOT (starts_with(key, substr(lpad(bin(167804928), 32, '0'), 1, 18)) AND asn = 64999))",
        "SELECT addr, plen::INTEGER AS plen, max_length::INTEGER AS max_length, asn FROM cut UNION ALL SELECT 167772160, 16, 24, 0",
    ),
    "vrps",
)
def slurm_apply(spark, sf_dir):
    (vrps,) = load(spark, sf_dir, "vrps")
    keyed = cover.with_key(vrps.distinct())
    key = lambda a: f"{a:032b}"[:18]
    filters = spark.createDataFrame([(None, 0), (key(167772160), None), (key(167804928), 64999)], "key string, asn long")
    added = cover.with_key(spark.createDataFrame([(167772160, 16, 24, 0)], "addr long, plen int, max_length int, asn long"))
    return cover.slurm(keyed, filters, added).select("addr", F.col("plen").cast("int").alias("plen"), F.col("max_length").cast("int").alias("max_length"), "asn")


@query(f"SELECT DISTINCT concat('route: ', {TEXT.format('addr')}, '/', plen, chr(10), 'descr: max-length ', max_length, chr(10), 'origin: AS', asn, chr(10), 'source: RPKI', chr(10)) AS text FROM vrps", "vrps")
def pseudo_routes(spark, sf_dir):
    (vrps,) = load(spark, sf_dir, "vrps")
    once = vrps.select("addr", "plen", "max_length", "asn").distinct()
    lines = [F.concat(F.lit("route: "), px.prefix_text(F.col("addr"), F.col("plen"))), F.concat(F.lit("descr: max-length "), F.col("max_length").cast("string")), F.concat(F.lit("origin: AS"), F.col("asn").cast("string")), F.lit("source: RPKI"), F.lit("")]
    return once.select(F.concat_ws("\n", *lines).alias("text")).distinct()


# ---- ASPA, reverse look-ups


@query("SELECT DISTINCT asn, peer FROM neighbours WHERE kind = 'provider' AND asn IN (SELECT customer FROM aspas) AND (asn, peer) NOT IN (SELECT (customer, provider) FROM aspas)", "neighbours", "aspas")
def aspa_missing_provider(spark, sf_dir):
    return registry.missing_providers(*load(spark, sf_dir, "neighbours", "aspas"))


@query("SELECT DISTINCT customer AS asn, provider AS peer FROM aspas WHERE customer IN (SELECT asn FROM neighbours) AND (customer, provider) NOT IN (SELECT (asn, peer) FROM neighbours)", "neighbours", "aspas")
def aspa_stale_provider(spark, sf_dir):
    return registry.stale_providers(*load(spark, sf_dir, "neighbours", "aspas"))


@query("SELECT customer, array_to_string(list_sort(list(DISTINCT provider)), ' ') AS providers FROM aspas GROUP BY customer", "aspas")
def aspa_providers(spark, sf_dir):
    (aspas,) = load(spark, sf_dir, "aspas")
    return registry.providers(aspas).withColumn("providers", F.array_join(F.transform("providers", lambda x: x.cast("string")), " "))


@query(after(ASNS, "SELECT top, count(*) AS customers FROM asns WHERE asn IN (SELECT customer FROM aspas) GROUP BY top"), "sets", "members", "aspas")
def aspa_customer_set(spark, sf_dir):
    nodes, members = reached(spark, sf_dir)
    (aspas,) = load(spark, sf_dir, "aspas")
    customers = expand.expand_as(nodes, members).join(aspas.select(F.col("customer").alias("asn")).distinct(), "asn", "left_semi")
    return customers.groupBy("top").agg(F.count("*").alias("customers"))


@query("SELECT DISTINCT peer AS asn, asn AS named_by FROM neighbours WHERE peer <> asn", "neighbours")
def named_by(spark, sf_dir):
    return registry.named_by(*load(spark, sf_dir, "neighbours"))


@query("SELECT member_of AS set_name, asn FROM claims", "claims")
def inverse_member_of(spark, sf_dir):
    (claims,) = load(spark, sf_dir, "claims")
    return claims.select(F.col("member_of").alias("set_name"), "asn")


@query("SELECT origin, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM routes GROUP BY origin", "routes")
def inverse_origin(spark, sf_dir):
    (routes,) = load(spark, sf_dir, "routes")
    return routes.groupBy("origin").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n"))


@query("SELECT DISTINCT set_name, member FROM (SELECT set_name, source, coalesce('AS' || asn, child) AS member FROM members) JOIN (SELECT set_name, source FROM sets) USING (set_name, source)", "sets", "members")
def direct_members(spark, sf_dir):
    sets, members = load(spark, sf_dir, "sets", "members")
    named = members.select("set_name", "source", F.coalesce(F.concat(F.lit("AS"), F.col("asn").cast("string")), "child").alias("member"))
    return named.join(sets.select("set_name", "source"), ["set_name", "source"]).select("set_name", "member").distinct()


@query("SELECT asn, source, lo, hi FROM aut_nums JOIN (SELECT 100000 + i * 37 AS lo, 100000 + i * 37 + 50 AS hi FROM range(0, 30) r(i)) ON asn BETWEEN lo AND hi", "aut_nums")
def as_block_join(spark, sf_dir):
    (nums,) = load(spark, sf_dir, "aut_nums")
    blocks = spark.range(30).select((100000 + F.col("id") * 37).alias("lo"), (100000 + F.col("id") * 37 + 50).alias("hi"))
    return registry.in_blocks(nums.select("asn", "source"), blocks, size=64)


@query("SELECT asn FROM (SELECT (asn * 40499) % 4294967296 AS asn FROM aut_nums UNION ALL SELECT 64496 + asn % 1500 FROM aut_nums) WHERE NOT (asn = 23456 OR asn BETWEEN 64496 AND 65551 OR asn >= 4200000000)", "aut_nums")
def special_as_filter(spark, sf_dir):
    (nums,) = load(spark, sf_dir, "aut_nums")
    made = nums.select(((F.col("asn") * 40499) % 4294967296).alias("asn")).union(nums.select(64496 + F.col("asn") % 1500))
    return made.where(~registry.special_as(F.col("asn")))


# ---- validation, mutation

SPEC = [("route", "route", True, True), ("route", "origin", True, True), ("route", "descr", False, False), ("route", "mnt-by", True, False), ("route", "source", True, True)]
COUNTED = "counted AS (SELECT obj_id, name, count(*) AS n, count(*) FILTER (WHERE trim(value) <> '') AS f FROM attributes GROUP BY obj_id, name)"
BROKEN = f"""{COUNTED}, broken AS (SELECT DISTINCT obj_id, 'dict/unknown-attribute' AS rule, name FROM counted WHERE name NOT IN ('route', 'origin', 'descr', 'mnt-by', 'source')
    UNION ALL SELECT obj_id, 'dict/cardinality', name FROM counted WHERE n > 1 AND name IN ('route', 'origin', 'source')
    UNION ALL SELECT o.obj_id, 'dict/missing-required', r.name FROM (SELECT DISTINCT obj_id FROM counted) o CROSS JOIN (VALUES ('route'), ('origin'), ('mnt-by'), ('source')) r(name) WHERE NOT EXISTS (SELECT 1 FROM counted c WHERE c.obj_id = o.obj_id AND c.name = r.name AND f > 0))"""


@query(after(BROKEN, "SELECT obj_id, rule, name FROM broken"), "attributes")
def profile_violations(spark, sf_dir):
    return registry.violations(*load(spark, sf_dir, "attributes"), SPEC)


@query(after(BROKEN, "SELECT rule, name, count(*) AS n, min(obj_id) AS first_obj FROM broken GROUP BY rule, name"), "attributes")
def diagnostic_histogram(spark, sf_dir):
    found = registry.violations(*load(spark, sf_dir, "attributes"), SPEC)
    return found.groupBy("rule", "name").agg(F.count("*").alias("n"), F.min("obj_id").alias("first_obj"))


@query("SELECT class, name, count(*) AS n, count(DISTINCT obj_id) AS objects FROM attributes GROUP BY class, name", "attributes")
def class_counts(spark, sf_dir):
    (attributes,) = load(spark, sf_dir, "attributes")
    return attributes.groupBy("class", "name").agg(F.count("*").alias("n"), F.countDistinct("obj_id").alias("objects"))


LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class, pk, source ORDER BY seq DESC) AS rn FROM mutations {where}) WHERE rn = 1 AND operation <> 'DEL')"


@query(after(LAST.format(where=""), "SELECT class, pk, source, payload, seq FROM last"), "mutations")
def corpus_upsert(spark, sf_dir):
    return registry.latest(*load(spark, sf_dir, "mutations")).select("class", "pk", "source", "payload", "seq")


@query(after(f"{LAST.format(where='WHERE seq % 2 = 0')}, {LAST.format(where='WHERE seq % 2 = 1').replace('last AS', 'other AS')}", "SELECT class, pk, source, payload, seq FROM other UNION ALL SELECT class, pk, source, payload, seq FROM last WHERE (class, pk, source) NOT IN (SELECT (class, pk, source) FROM other)"), "mutations")
def corpus_merge(spark, sf_dir):
    (mutations,) = load(spark, sf_dir, "mutations")
    own, other = (registry.latest(mutations.where(F.col("seq") % 2 == k)) for k in (0, 1))
    return registry.merge(own, other).select("class", "pk", "source", "payload", "seq")


# ---- prefix spaces

SPACES = f"{LEAVES}, ranges AS (SELECT DISTINCT substr(set_name, 1, 5) AS space, addr, plen, lo, hi FROM leaves WHERE lo <= hi)"
#: Every prefix listed: intervals are checked by what they hold.
LISTED = f"{SPACES}, listed AS (SELECT DISTINCT space, n.l AS l, (addr >> (32 - n.l)) + i.i AS i FROM ranges, range(23, 33) n(l), range(0, 512) i(i) WHERE n.l BETWEEN lo AND hi AND i.i < (1 << (n.l - plen)))"


def spaces(spark, sf_dir):
    ranges = range_apply_operator(spark, sf_dir).select(F.substring("set_name", 1, 5).alias("space"), "addr", "plen", "lo", "hi")
    return ranges.distinct()


def pair(spark, sf_dir):
    """Sets RS-B1 and RS-B2 as two layers of one space."""
    held = spaces(spark, sf_dir)
    a, b = (space.intervals(held.where(F.col("space") == f"RS-B{k}").withColumn("space", F.lit("x"))) for k in (1, 2))
    return a, b


def sized(df):
    return df.groupBy("plen").agg(F.sum(F.col("hi") - F.col("lo")).alias("prefixes"), F.count("*").alias("intervals")).withColumn("plen", F.col("plen").cast("int"))


ISLANDS = "SELECT l::INTEGER AS plen, count(*) AS prefixes, count(DISTINCT g) AS intervals FROM (SELECT l, i, i - row_number() OVER (PARTITION BY l ORDER BY i) AS g FROM ({picked})) GROUP BY l"


@query(after(LISTED, ISLANDS.format(picked="SELECT DISTINCT l, i FROM listed WHERE space IN ('RS-B1', 'RS-B2')")), "range_members")
def space_union(spark, sf_dir):
    return sized(space.union(*pair(spark, sf_dir)))


@query(after(LISTED, ISLANDS.format(picked="SELECT l, i FROM listed WHERE space = 'RS-B1' EXCEPT SELECT l, i FROM listed WHERE space = 'RS-B2'")), "range_members")
def space_minus(spark, sf_dir):
    return sized(space.minus(*pair(spark, sf_dir)))


@query(after(LISTED, ISLANDS.format(picked="SELECT l, i FROM listed WHERE space = 'RS-B1' INTERSECT SELECT l, i FROM listed WHERE space = 'RS-B2'")), "range_members")
def space_intersect(spark, sf_dir):
    return sized(space.intersection(*pair(spark, sf_dir)))


@query(after(LISTED, "SELECT DISTINCT space, space NOT IN (SELECT space FROM listed WHERE (l, i) NOT IN (SELECT (l, i) FROM listed WHERE space = 'RS-B1')) AS inside FROM listed"), "range_members")
def space_subset(spark, sf_dir):
    """Which spaces lie inside that of RS-B1: by the prefixes that they share with it and hold in all, so that one is never copied for all others."""
    held = written(space.sweep({"a": space.intervals(spaces(spark, sf_dir))}, F.col("a") > 0), "spaces")
    return space.inside(held, held.where("space = 'RS-B1'").drop("space")).select("space", "inside")


@query(after(LISTED, f"SELECT space, concat({TEXT.format('(i << (32 - l))')}, '/', l) AS prefix FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY l, i) AS rn FROM listed) WHERE rn = 1"), "range_members")
def space_example(spark, sf_dir):
    found = space.example(space.sweep({"a": space.intervals(spaces(spark, sf_dir))}, F.col("a") > 0))
    return found.select("space", px.prefix_text(F.col("addr"), F.col("plen")).alias("prefix"))


#: A block of length b at a place holds all prefixes of a length l below it; the shortest such blocks of each length, then runs of lengths.
CANONICAL = f"""{LISTED}, blocks AS (SELECT space, l, b.b AS b, i >> (l - b.b) AS j FROM listed, range(0, 33) b(b) WHERE b.b <= l GROUP BY ALL HAVING count(*) = (1::BIGINT << (l - b.b))),
    longest AS (SELECT * FROM blocks x WHERE NOT EXISTS (SELECT 1 FROM blocks y WHERE y.space = x.space AND y.l = x.l AND y.b = x.b - 1 AND y.j = x.j >> 1)),
    runs AS (SELECT *, l - row_number() OVER (PARTITION BY space, b, j ORDER BY l) AS g FROM longest)"""


@query(after(CANONICAL, "SELECT space, j << (32 - b) AS addr, b::INTEGER AS plen, min(l)::INTEGER AS lo, max(l)::INTEGER AS hi FROM runs GROUP BY space, b, j, g"), "range_members")
def space_ranges(spark, sf_dir):
    """The canonical ranges of each space: of each aligned block that no longer one holds, and of each run of its lengths, one row."""
    canonical = space.ranges(space.sweep({"a": space.intervals(spaces(spark, sf_dir))}, F.col("a") > 0))
    return canonical.select("space", "addr", *[F.col(c).cast("int").alias(c) for c in ("plen", "lo", "hi")])


# ---- lists


@query("SELECT ((rn - 1) // 8) AS line_no, concat('as-list: ', string_agg(asn, ' ' ORDER BY asn)) AS line FROM (SELECT asn, row_number() OVER (ORDER BY asn) AS rn FROM aut_nums) GROUP BY 1", "aut_nums")
def as_list_lines(spark, sf_dir):
    (nums,) = load(spark, sf_dir, "aut_nums")
    return registry.as_list_lines(nums, "as-list", 8)


@query(after(ASNS, f"SELECT top, concat_ws(chr(10), 'no ip prefix-list ' || top, string_agg(line, chr(10) ORDER BY addr, plen)) AS text FROM (SELECT DISTINCT top, addr, plen, concat('ip prefix-list ', top, ' permit ', {TEXT.format('addr')}, '/', plen) AS line FROM asns JOIN routes ON origin = asn) GROUP BY top"), "sets", "members", "routes")
def prefix_list_text(spark, sf_dir):
    (routes,) = load(spark, sf_dir, "routes")
    nodes, members = reached(spark, sf_dir)
    found = expand.originated(expand.expand_as(nodes, members), routes)
    line = F.concat(F.lit("ip prefix-list "), F.col("top"), F.lit(" permit "), px.prefix_text(F.col("addr"), F.col("plen")))
    listed = found.groupBy("top").agg(F.sort_array(F.collect_list(F.struct("addr", "plen", line.alias("line")))).alias("rows"))
    return listed.select("top", F.concat_ws("\n", F.concat(F.lit("no ip prefix-list "), F.col("top")), F.array_join("rows.line", "\n")).alias("text"))


AGGREGATED = f"""keyed AS (SELECT DISTINCT {KEYED} FROM routes),
    bare AS (SELECT key FROM keyed WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE starts_with(keyed.key, k.key) AND k.key <> keyed.key)),
    joined AS (SELECT key, 33 AS step FROM bare UNION ALL SELECT DISTINCT CASE WHEN length(key) = step - 1 AND n = 2 THEN substr(key, 1, step - 2) ELSE key END, step - 1 FROM (SELECT key, step, count(*) OVER (PARTITION BY step, length(key), CASE WHEN length(key) = step - 1 THEN substr(key, 1, step - 2) ELSE key END) AS n FROM joined WHERE step > 1))"""


@query(after(AGGREGATED, "SELECT DISTINCT key FROM joined WHERE step = (SELECT min(step) FROM joined)"), "routes")
def aggregate_prefixes(spark, sf_dir):
    (routes,) = load(spark, sf_dir, "routes")
    made = registry.aggregate(routes.select(F.lit("x").alias("name"), "addr", "plen"))
    return cover.with_key(made).select("key")


# ---- policies


def policy_tables(spark, sf_dir):
    policies, members, routes = load(spark, sf_dir, "policies", "range_members", "routes")
    found = written(policy.terms(policies), "terms")
    literals = resolved_literals(found, members, routes)
    return found, written(policy.term_spaces(found, literals), "spaces")


def resolved_literals(found, members, routes):
    """The spaces of all literals; only the sets that they name are expanded."""
    named = written(policy.literals_of(found), "named")
    tops = policy.sets_of(named).join(members.select(F.col("set_name").alias("top")).distinct(), "top", "left_semi")
    return policy.resolved(named, expand.expand_ranges(tops, members), routes)


@query("SELECT asn, attr, ord::INTEGER AS ord, CASE WHEN text = 'from accept' THEN NULL ELSE regexp_extract(text, '^(?:from|to) AS([0-9]+)', 1)::BIGINT END AS peer, nullif(regexp_extract(text, 'pref=([0-9]+)', 1), '') AS pref, nullif(regexp_extract(text, '(?:accept|announce) (.+)$', 1), '') AS filter, CASE WHEN text = 'from accept' THEN 'policy/syntax' END AS rule FROM policies", "policies")
def policy_terms(spark, sf_dir):
    (policies,) = load(spark, sf_dir, "policies")
    pref = F.transform(F.filter("actions", lambda a: a["attribute"] == "pref"), lambda a: a["value"])
    return policy.terms(policies).select("asn", "attr", "ord", "peer", F.try_element_at(pref, F.lit(1)).alias("pref"), "filter", "rule")


#: The prefixes that each direction announces and accepts, one by one.
DIRECTIONS = f"""{PATHS}, listed AS (SELECT DISTINCT top, n.l AS l, (addr >> (32 - n.l)) + i.i AS i FROM found, range(23, 33) n(l), range(0, 512) i(i) WHERE top IN (SELECT 'RS-B' || (n_nationkey + 1) FROM nation) AND lo <= hi AND n.l BETWEEN lo AND hi AND i.i < (1 << (n.l - plen))),
    nations AS (SELECT n_nationkey AS n, 200000 + n_nationkey AS from_as, 200000 + (n_nationkey * 3 + 1) % 25 AS to_as, 'RS-B' || (n_nationkey + 1) AS s FROM nation),
    announced AS (SELECT n, from_as, to_as, l, i FROM nations JOIN listed ON top = s),
    denied AS (SELECT n, l, i FROM announced WHERE l >= 17 AND (i >> (l - 17)) = ((10 << 24) + ((n % 8) << 16)) >> 15),
    second AS (SELECT n, l, i FROM announced WHERE n % 2 = 0 AND CASE n % 3 WHEN 0 THEN l = 24 AND (i >> 6) = (10 << 24) >> 14 WHEN 1 THEN (i >> (l - 16)) = ((10 << 24) + (200 << 16)) >> 16 ELSE (i >> (l - 17)) = ((10 << 24) + ((n % 8) << 16) + (128 << 8)) >> 15 END)"""


@query(after(DIRECTIONS, "SELECT from_as, to_as, count(*) AS n FROM announced WHERE (n, l, i) IN (SELECT (n, l, i) FROM denied) AND (n, l, i) NOT IN (SELECT (n, l, i) FROM second) GROUP BY ALL"), "range_members")
def pair_consistency(spark, sf_dir):
    """How many prefixes an AS announces that its neighbour doesn't accept."""
    _, spaces = policy_tables(spark, sf_dir)
    return policy.not_imported(spaces).groupBy("from_as", "to_as").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))


@query(after(PATHS, """SELECT asn, attr, ord::INTEGER AS ord FROM policies WHERE ord BETWEEN 100 AND 199 AND ((ord + 2) % 3 = 2 AND EXISTS (SELECT 1 FROM found WHERE lo <= hi AND top = 'RS-B' || (ord - 99) AND (addr >> 15) = ((10 << 24) + (((ord + 4) % 8) << 16) + (128 << 8)) >> 15))"""), "range_members", "policies")
def lint_shadowed(spark, sf_dir):
    found, spaces = policy_tables(spark, sf_dir)
    return policy.shadowed(found, spaces).select("asn", "attr", "ord")


@query(
    after(
        PATHS,
        """SELECT asn, attr, ord::INTEGER AS ord FROM policies WHERE text LIKE '%AS-MISSING9' OR (ord BETWEEN 100 AND 199 AND CASE (ord + 2) % 3 WHEN 0 THEN false
        WHEN 1 THEN NOT EXISTS (SELECT 1 FROM found WHERE lo <= hi AND top = 'RS-B' || (ord - 99) AND (addr >> 16) = ((10 << 24) + (200 << 16)) >> 16)
        ELSE NOT EXISTS (SELECT 1 FROM found WHERE lo <= hi AND top = 'RS-B' || (ord - 99) AND (addr >> 15) = ((10 << 24) + (((ord + 4) % 8) << 16) + (128 << 8)) >> 15) END)""",
    ),
    "range_members",
    "policies",
)
def lint_empty(spark, sf_dir):
    found, spaces = policy_tables(spark, sf_dir)
    return policy.empty(found, spaces).select("asn", "attr", "ord")


@query("SELECT DISTINCT asn, 999999::BIGINT AS peer FROM policies WHERE text LIKE '%AS999999%'", "policies")
def lint_no_aut_num(spark, sf_dir):
    (policies,) = load(spark, sf_dir, "policies")
    return policy.without_aut_num(policy.terms(policies), policies.select("asn"))


@query("SELECT coalesce(rule, 'ok') AS rule, count(*) AS n, count(DISTINCT asn) AS ases FROM (SELECT asn, CASE WHEN text = 'from accept' THEN 'policy/syntax' END AS rule FROM policies) GROUP BY 1", "policies")
def sweep_totals(spark, sf_dir):
    (policies,) = load(spark, sf_dir, "policies")
    found = policy.terms(policies)
    return found.groupBy(F.coalesce("rule", F.lit("ok")).alias("rule")).agg(F.count("*").alias("n"), F.countDistinct("asn").alias("ases"))


@query("SELECT asn, n FROM (SELECT asn, count(*) AS n FROM policies WHERE text = 'from accept' OR text LIKE '%AS-MISSING9' GROUP BY asn) ORDER BY n DESC, asn LIMIT 5", "policies")
def top_warnings(spark, sf_dir):
    (policies,) = load(spark, sf_dir, "policies")
    warned = policy.terms(policies).where("rule IS NOT NULL OR filter = 'AS-MISSING9'")
    return warned.groupBy("asn").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "asn").limit(5)


@query(
    after(f"{ASNS}, sessions AS (SELECT asn AS local, 100000 + ord AS peer FROM (SELECT DISTINCT 300000 + n_nationkey AS asn FROM nation), range(0, 40) r(ord))", """SELECT local, peer, 'import' AS attr, k::INTEGER AS ord, 'match' AS verdict FROM sessions, range(0, 3) t(k)
        WHERE CASE k WHEN 0 THEN peer IN (SELECT asn FROM asns WHERE top = 'AS-N' || (local - 300000)) WHEN 1 THEN peer IN (SELECT asn FROM asns WHERE top = 'AS-WORLD') AND peer NOT IN (SELECT asn FROM asns WHERE top = 'AS-R0') ELSE peer = 100007 END
        UNION ALL SELECT local, peer, 'import', 3, 'undecided' FROM sessions"""),
    "sets",
    "members",
)
def evaluate_sessions(spark, sf_dir):
    sets, members, nations = load(spark, sf_dir, "sets", "members", "policies")
    ases = nations.select((F.col("asn") + 100000).alias("asn")).distinct()
    texts = [F.concat(F.lit("from AS-N"), (F.col("asn") - 300000).cast("string"), F.lit(" accept ANY")), F.lit("from AS-WORLD EXCEPT AS-R0 action pref=1; accept ANY"), F.lit("from AS100007 accept ANY"), F.lit("from AS-NOWHERE accept ANY")]
    made = ases.select("asn", F.lit("import").alias("attr"), F.posexplode(F.array(*texts)).alias("ord", "text"))
    nodes, own = reached(spark, sf_dir)
    membership = expand.expand_as(nodes, own)
    sessions = ases.select(F.col("asn").alias("local"), F.explode(F.sequence(F.lit(100000).cast("long"), F.lit(100039).cast("long"))).alias("peer"))
    told = policy.evaluate(sessions, policy.terms(made), membership, sets.select(F.col("set_name").alias("top")))
    return told.select("local", "peer", "attr", "ord", "verdict")


@query(
    after(
        f"""{DIRECTIONS}, extra AS (SELECT n FROM nations WHERE n % 6 = 0 AND EXISTS (SELECT 1 FROM range(0, 64) r(i) WHERE (n, 24, (10 << 16) + r.i) NOT IN (SELECT (n, l, i) FROM announced)))""",
        """SELECT DISTINCT from_as, to_as, 'not-imported' AS kind, 'warning' AS severity FROM announced WHERE (n, l, i) IN (SELECT (n, l, i) FROM denied) AND (n, l, i) NOT IN (SELECT (n, l, i) FROM second)
        UNION ALL SELECT from_as, to_as, 'not-exported', 'info' FROM nations JOIN extra USING (n)
        UNION ALL SELECT 200000 + n, 999999, 'no-aut-num', 'warning' FROM nations WHERE n % 5 = 0""",
    ),
    "range_members",
)
def pair_findings(spark, sf_dir):
    policies, members, routes = load(spark, sf_dir, "policies", "range_members", "routes")
    found = written(policy.terms(policies), "terms")
    return policy.findings(found, resolved_literals(found, members, routes), policies.select("asn")).select("from_as", "to_as", "kind", "severity")


@query("SELECT DISTINCT asn, 'AS-MISSING9' AS missing FROM policies WHERE text LIKE '%AS-MISSING9'", "policies")
def lint_missing_set(spark, sf_dir):
    policies, members = load(spark, sf_dir, "policies", "range_members")
    return policy.missing_sets(policy.terms(policies), members.select("set_name").distinct()).select("asn", "missing")


# ---- scan, members, other sets, generators, authorisation


@query(
    """SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN regexp_full_match(line, '[ \t]*\r*') THEN 'blank' WHEN line[1] = '#' THEN 'comment' WHEN line[1] IN (' ', chr(9), '+') THEN 'continuation' WHEN regexp_matches(line, '^([^ \t+#:][^#:]*)?:') THEN 'attribute' ELSE 'malformed' END AS kind
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY ALL""",
    "aut_nums",
)
def line_kinds(spark, sf_dir):
    """Kinds of the lines of hostile texts; a line that begins with a blank counts as a continuation."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    kind = F.when(F.col("line").rlike(r"^[ \t]*\r*$"), "blank").when(F.col("line").startswith("#"), "comment").when(F.col("line").rlike(r"^[ \t+]"), "continuation").when(F.col("line").rlike(r"^([^ \t+#:][^#:]*)?:"), "attribute").otherwise("malformed")
    return lines.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"))


ITEMS = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN concat('AS', CAST(p_partkey AS STRING)) WHEN 1 THEN concat('as1.', CAST(p_partkey % 1000 AS STRING)) WHEN 2 THEN concat('RIPE::AS', CAST(p_partkey AS STRING), ':AS-Foo') WHEN 3 THEN concat('10.', CAST(p_partkey % 200 AS STRING), '/16^', CAST(p_size AS STRING)) WHEN 4 THEN concat('rs-b', CAST(p_size AS STRING), '^+') ELSE 'junk item' END AS item FROM {part}"


@query(
    f"""SELECT id, CASE id % 6 WHEN 0 THEN id WHEN 1 THEN 65536 + id % 1000 END AS asn, CASE id % 6 WHEN 2 THEN 'AS' || id || ':AS-FOO' WHEN 4 THEN 'RS-B' || p_size END AS child, CASE id % 6 WHEN 2 THEN 'RIPE' END AS child_source,
    CASE id % 6 WHEN 3 THEN 167772160 + (id % 200) * 65536 END AS addr, CASE id % 6 WHEN 3 THEN 16 END::INTEGER AS plen, CASE id % 6 WHEN 3 THEN '^' || p_size WHEN 4 THEN '^+' ELSE '' END AS op FROM (SELECT p_partkey AS id, p_size FROM part)""",
    "aut_nums",
)
def member_parse(spark, sf_dir):
    items = spark.sql(ITEMS, part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    told = items.withColumns(model.member_columns(F.col("item")))
    return told.select("id", "asn", "child", "child_source", "addr", F.col("plen").cast("int").alias("plen"), "op")


BLOCKS = "spans AS (SELECT c_custkey AS id, 167772160 + c_custkey * 977 AS lo, 167772160 + c_custkey * 977 + (c_custkey * 7919) % 5000 AS hi FROM customer)"


@query(
    after(
        f"{BLOCKS}, walk AS (SELECT id, lo, hi, NULL::BIGINT AS addr, NULL::INTEGER AS plen FROM spans UNION ALL SELECT id, lo + size, hi, lo, 32 - log2(size)::INTEGER FROM (SELECT id, lo, hi, (SELECT max(1 << k) FROM range(0, 14) r(k) WHERE lo % (1 << k) = 0 AND lo + (1 << k) - 1 <= hi) AS size FROM walk WHERE lo <= hi))",
        "SELECT id, addr, plen FROM walk WHERE addr IS NOT NULL",
    ),
    "aut_nums",
)
def range_prefixes(spark, sf_dir):
    """Address ranges as the fewest prefixes."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), (167772160 + F.col("c_custkey") * 977).alias("lo"), (167772160 + F.col("c_custkey") * 977 + (F.col("c_custkey") * 7919) % 5000).alias("hi"))
    return other_sets.range_prefixes(rows).select("id", "addr", F.col("plen").cast("int").alias("plen"))


NESTED = "nested AS (SELECT 'RTRS-R' || r_regionkey AS set_name, NULL AS router, 'RTRS-N' || n_nationkey AS child FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'RTRS-N' || s_nationkey, 'rtr' || s_suppkey || '.example.net', NULL FROM supplier UNION ALL SELECT 'RTRS-N' || n_nationkey, NULL, 'RTRS-R' || n_regionkey FROM nation WHERE n_nationkey % 5 = 0)"


@query(after(f"{NESTED}, reached AS (SELECT DISTINCT set_name AS top, set_name AS node FROM nested UNION SELECT top, child FROM reached JOIN nested ON node = set_name WHERE child IN (SELECT set_name FROM nested))", "SELECT DISTINCT top, router FROM reached JOIN nested ON node = set_name WHERE router IS NOT NULL"), "aut_nums")
def router_sets(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    n = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    nation = read("nation")
    rows = nation.select(n("RTRS-R", "n_regionkey").alias("set_name"), none.alias("router"), n("RTRS-N", "n_nationkey").alias("child"))
    rows = rows.union(read("supplier").select(n("RTRS-N", "s_nationkey"), F.concat(n("rtr", "s_suppkey"), F.lit(".example.net")), none)).union(nation.where("n_nationkey % 5 = 0").select(n("RTRS-N", "n_nationkey"), none, n("RTRS-R", "n_regionkey")))
    sets = rows.select("set_name").distinct()
    return other_sets.expand_routers(sets.select(F.col("set_name").alias("top")), sets, rows)


ENTRIES = "entries AS (SELECT DISTINCT 'L' || origin % 7 AS name, addr, plen, CASE WHEN addr % 1024 = 0 THEN plen + 1 ELSE plen END AS lo, CASE WHEN addr % 512 = 0 THEN plen + 2 ELSE plen END AS hi FROM routes)"


def entries(spark, sf_dir):
    (routes,) = load(spark, sf_dir, "routes")
    wide, late = F.col("addr") % 512 == 0, F.col("addr") % 1024 == 0
    return routes.select(F.concat(F.lit("L"), (F.col("origin") % 7).cast("string")).alias("name"), "addr", "plen", F.when(late, F.col("plen") + 1).otherwise(F.col("plen")).alias("lo"), F.when(wide, F.col("plen") + 2).otherwise(F.col("plen")).alias("hi")).distinct()


def list_sql(head: str, exact: str, ranged: str, upto: str, tail: str, between: str) -> str:
    q = lambda t: "concat(" + ", ".join({"p": f"concat({TEXT.format('addr')}, '/', plen)", "name": "name", "lo": "lo", "hi": "hi", "n": "plen"}.get(x, "'" + x.replace("\n", "' || chr(10) || '") + "'") for x in re.split(r"<(p|name|lo|hi|n)>", t)) + ")"
    line = f"CASE WHEN lo = plen AND hi = plen THEN {q(exact)} WHEN lo > plen THEN {q(ranged)} ELSE {q(upto)} END"
    return after(ENTRIES, f"SELECT name, concat({q(head)}, string_agg({line}, {q(between)} ORDER BY addr, plen, lo, hi), {q(tail)}) AS text FROM entries GROUP BY name")


@query(list_sql("no ip prefix-list <name>\n", "ip prefix-list <name> permit <p>\n", "ip prefix-list <name> permit <p> ge <lo> le <hi>\n", "ip prefix-list <name> permit <p> le <hi>\n", "", ""), "routes")
def filter_list_ios(spark, sf_dir):
    return generate.prefix_lists(entries(spark, sf_dir), "ios")


@query(list_sql("<name> = [", "\n    <p>", "\n    <p>{<lo>,<hi>}", "\n    <p>{<n>,<hi>}", "\n];\n", ","), "routes")
def filter_list_bird(spark, sf_dir):
    return generate.prefix_lists(entries(spark, sf_dir), "bird")


@query(list_sql("policy-options {\nreplace:\n  route-filter-list <name> {\n", "    <p> exact;\n", "    <p> prefix-length-range /<lo>-/<hi>;\n", "    <p> upto /<hi>;\n", "  }\n}\n", ""), "routes")
def filter_list_junos(spark, sf_dir):
    return generate.prefix_lists(entries(spark, sf_dir), "junos-route-filter-list")


@query(
    """SELECT name, concat('no ip as-path access-list ', name, chr(10), 'ip as-path access-list ', name, ' permit ^', me, '(_', me, ')*$', chr(10), string_agg(concat('ip as-path access-list ', name, ' permit ^', me, '(_[0-9]+)*_(', l, ')$', chr(10)), '' ORDER BY g)) AS text
    FROM (SELECT name, me, g, string_agg(asn, '|' ORDER BY asn) AS l FROM (SELECT 'P' || nation AS name, min(asn) OVER w AS me, asn, (row_number() OVER (w ORDER BY asn) - 2) // 4 AS g FROM aut_nums WINDOW w AS (PARTITION BY nation)) WHERE asn <> me GROUP BY ALL) GROUP BY name, me""",
    "aut_nums",
)
def as_path_text(spark, sf_dir):
    (nums,) = load(spark, sf_dir, "aut_nums")
    named = nums.select(F.concat(F.lit("P"), F.col("nation").cast("string")).alias("name"), "asn")
    near = named.groupBy("name").agg(F.min("asn").alias("me"), F.count("*").alias("n"))
    return generate.as_paths(named.join(near.where("n > 1").select("name"), "name"), near.where("n > 1").select("name", "me"), "ios")


AUTH = f"""asked AS (SELECT c_custkey AS update_id, 167772160 + (c_custkey % 2000) * 256 AS addr, 25 AS plen, 100001 + c_custkey % {{n}} AS origin FROM customer), spaces AS (SELECT DISTINCT addr, plen, 'MNT-' || addr % 7 AS mnt FROM routes WHERE plen = 24),
    needs AS (SELECT update_id, 'object' AS reason, 'MNT-0' AS mnt FROM asked UNION ALL SELECT update_id, 'origin', aut_nums.mnt FROM asked LEFT JOIN aut_nums ON asn = origin
    UNION ALL SELECT update_id, 'space', spaces.mnt FROM asked LEFT JOIN spaces ON spaces.addr = asked.addr),
    told AS (SELECT update_id, reason, coalesce(mnt IN ('MNT-0', 'MNT-1', 'MNT-2', 'MNT-3', 'MNT-4'), false) AS ok FROM needs)""".replace("{n}", "(SELECT count(*) FROM supplier)")


@query(after(AUTH, "SELECT update_id, bool_and(ok) AS allowed, coalesce(string_agg(reason, ',' ORDER BY reason) FILTER (WHERE NOT ok), '') AS missing FROM told GROUP BY update_id"), "routes", "aut_nums")
def authorise_routes(spark, sf_dir):
    """Route creation: the object's, the origin's and the covering space's maintainers, for credentials of five maintainers."""
    routes, nums = load(spark, sf_dir, "routes", "aut_nums")
    n = F.broadcast(nums.agg(F.count("*").alias("__n")))
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").join(n).select(F.col("c_custkey").alias("update_id"), (167772160 + (F.col("c_custkey") % 2000) * 256).alias("addr"), F.lit(25).alias("plen"), (100001 + F.col("c_custkey") % F.col("__n")).alias("origin"), F.array(F.lit("mnt-0")).alias("mnts"))
    none = F.array().cast("array<string>")
    held = cover.with_key(routes.where("plen = 24").select("addr", "plen").distinct()).select("key", "plen", F.array(F.concat(F.lit("MNT-"), (F.col("addr") % 7).cast("string"))).alias("mnts"), none.alias("mnt_lower"), none.alias("mnt_routes"))
    owners = nums.select("asn", F.array("mnt").alias("mnts"), none.alias("mnt_routes"))
    needs = auth.route_requirements(cover.with_key(asked), owners, held)
    answers = asked.select("update_id", F.explode(F.array(*[F.lit(f"MNT-{k}") for k in range(5)])).alias("mnt"), F.lit(True).alias("ok"), F.lit(False).alias("unsupported"))
    return auth.decide(needs, answers).select("update_id", "allowed", F.array_join("missing", ",").alias("missing"))


@query("SELECT id, alternatives, negatives FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 2 END::BIGINT AS alternatives, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 2 END::BIGINT AS negatives FROM part)", "aut_nums")
def normalized_filters(spark, sf_dir):
    """Filters in normal form: how many alternatives, and how many negative literals in all of them."""
    texts = [["AS", " AND NOT AS1"], ["AS", " AND NOT (AS1 AND AS2)"], ["(AS", " OR AS1) AND (AS2 OR AS3)"], ["NOT (AS", " AND {10.0.0.0/8^+})"]]
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    text = F.coalesce(*[F.when(F.col("id") % 4 == k, F.concat(F.lit(f"from AS1 accept {a}"), (F.col("id") + 1000).cast("string"), F.lit(b))) for k, (a, b) in enumerate(texts)])
    found = policy.terms(part.select(F.col("id").alias("asn"), F.lit("import").alias("attr"), F.lit(0).alias("ord"), text.alias("text")))
    return found.select(F.col("asn").alias("id"), F.size("conjuncts").cast("long").alias("alternatives"), F.aggregate("conjuncts", F.lit(0).cast("long"), lambda s, c: s + F.size(c["negative"])).alias("negatives"))


from . import dumps, expansions, language  # noqa: E402, F401  (they add their queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

