"""Queries of the policy language, of look-up commands and of authorisation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attributes as at
from ..functions import policy as lang
from ..functions.prefix import bits, prefix_text
from ..operators import auth, expand, members, policy, protocol
from ..sources.synthetic import SOURCES
from ..sources.synthetic import registry as load
from .queries import ASNS, KEYED, OWN, TEXT, after, query


def part_ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))


def numbered(*pieces):
    """Text of literals and columns."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in pieces])


def made_terms(spark, sf_dir, text, attr="import", filter_sets=None):
    rows = part_ids(spark, sf_dir).select(F.col("id").alias("asn"), F.lit(attr).alias("attr"), F.lit(0).alias("ord"), text.alias("text"))
    return policy.terms(rows, filter_sets=filter_sets)


# ---- expressions


@query(
    """SELECT p_partkey AS id, k AS term, CASE k WHEN 0 THEN 1000 + p_partkey ELSE 7 END AS peer,
        CASE WHEN k = 0 AND p_partkey % 2 = 0 THEN 'pref=10;med=' || p_size ELSE 'pref=20' END AS actions FROM part, range(0, 2) r(k) WHERE p_partkey % 2 = 0 OR k = 0""",
    "aut_nums",
)
def structured_terms(spark, sf_dir):
    """Terms of a braced policy, and of EXCEPT, where the exception comes first."""
    first = numbered("{ from AS", F.col("id") + 1000, " action pref=10; med=", F.col("size"), "; accept AS1; from AS7 action pref=20; accept ANY; }")
    other = numbered("from AS-ANY action pref=30; accept ANY EXCEPT from AS", F.col("id") + 1000, " action pref=20; accept AS1")
    found = made_terms(spark, sf_dir, F.when(F.col("id") % 2 == 0, first).otherwise(other)).where("peer IS NOT NULL")
    return found.select(F.col("asn").alias("id"), F.col("term").cast("long").alias("term"), "peer", F.array_join(F.transform("actions", lambda a: F.concat(a["attribute"], a["op"], a["value"])), ";").alias("actions"))


@query("SELECT p_partkey AS id, 1000 + p_partkey AS peer, 'pref=10;med=5' AS actions, 'AS1 AND {10.0.0.0/8^+}' AS filter FROM part", "aut_nums")
def refined_terms(spark, sf_dir):
    """REFINE: both sides' actions and the filters of both, for the sessions that both peerings take."""
    text = numbered("from AS-ANY action pref=10; accept AS1 REFINE from AS", F.col("id") + 1000, " action med=5; accept {10.0.0.0/8^+}")
    found = made_terms(spark, sf_dir, text).where("peer IS NOT NULL")
    return found.select(F.col("asn").alias("id"), "peer", F.array_join(F.transform("actions", lambda a: F.concat(a["attribute"], a["op"], a["value"])), ";").alias("actions"), "filter")


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS pref, CASE WHEN p_partkey % 3 = 1 THEN concat('65000,', p_partkey) ELSE '' END AS prepended,
        CASE p_partkey % 3 WHEN 2 THEN concat('65000:', p_size, ',65535:65281') ELSE '' END AS communities FROM part""",
    "aut_nums",
)
def action_columns(spark, sf_dir):
    """Actions as columns: preference, AS numbers put before the path, communities with names as numbers."""
    action = F.when(F.col("id") % 3 == 0, numbered("pref=", F.col("size"))).when(F.col("id") % 3 == 1, numbered("aspath.prepend(AS65000, AS", F.col("id"), ")")).otherwise(numbered("community.append(65000:", F.col("size"), ", NO_EXPORT)"))
    found = made_terms(spark, sf_dir, F.concat(F.lit("from AS1 action "), action, F.lit("; accept ANY")))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    numbers = F.transform(at.communities(F.col("actions")), lambda x: F.when(x == "NO_EXPORT", "65535:65281").otherwise(x))
    return found.select(F.col("asn").alias("id"), at.action_number(F.col("actions"), "pref").alias("pref"), joined(at.prepended(F.col("actions"))).alias("prepended"), joined(numbers).alias("communities"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '{10.0.0.0/8^24-26}' WHEN 1 THEN '{10.0.0.0/8^+, 192.0.2.0/24^26}' ELSE '{10.0.0.0/8^-}' END AS filter FROM part", "aut_nums")
def listed_operators(spark, sf_dir):
    """Operators behind a list, composed with those in it; a range that both leave nothing of is gone."""
    lists = ["{10.0.0.0/8^20-24}^24-26", "{10.0.0.0/8^+, 192.0.2.0/24^26}", "{10.0.0.0/8^+, 192.0.2.0/32^+}^-"]
    text = F.coalesce(*[F.when(F.col("id") % 3 == k, F.lit(f"from AS1 accept {x}")) for k, x in enumerate(lists)])
    return made_terms(spark, sf_dir, text).select(F.col("asn").alias("id"), "filter")


@query("SELECT p_partkey AS id, 'AS' || p_partkey || ',NOT AS' || p_size AS literals FROM part", "aut_nums")
def inlined_filter_sets(spark, sf_dir):
    """A filter with a filter-set's own filter in its place; the inner one names an as-set, so that no part's AS number contradicts it."""
    sets = {"FLTR-OWN": lang.parse_filter("NOT FLTR-INNER")[0]} | {"FLTR-INNER": lang.parse_filter("AS-SIZE")[0]}
    found = made_terms(spark, sf_dir, numbered("from AS1 accept AS", F.col("id"), " AND FLTR-OWN"), filter_sets=sets)
    told = found.select(F.col("asn").alias("id"), F.explode("conjuncts").alias("c")).join(part_ids(spark, sf_dir), "id")
    negative = F.transform("c.negative", lambda x: F.concat(F.lit("NOT "), F.regexp_replace(x, "^AS-SIZE$", numbered("AS", F.col("size")))))
    return told.select("id", F.array_join(F.concat("c.positive", negative), ",").alias("literals"))


@query("SELECT p_partkey AS id, 9 + p_partkey AS peer, CASE p_partkey % 2 WHEN 0 THEN '{0.0.0.0/0}' ELSE 'ANY' END AS filter FROM part", "aut_nums")
def default_terms(spark, sf_dir):
    """Defaults: where to, and for which networks."""
    text = F.when(F.col("id") % 2 == 0, numbered("to AS", F.col("id") + 9, " action pref=1; networks {0.0.0.0/0}")).otherwise(numbered("to AS", F.col("id") + 9))
    return made_terms(spark, sf_dir, text, "default").select(F.col("asn").alias("id"), "peer", "filter")


@query("SELECT DISTINCT policies.asn, regexp_extract(text, '(RS-B[0-9]+|AS-MISSING9)', 1) AS literal FROM policies WHERE text <> 'from accept' AND regexp_matches(text, '(RS-B[0-9]+|AS-MISSING9)')", "policies")
def named_literals(spark, sf_dir):
    """Sets that the normal forms of all filters name."""
    (policies,) = load(spark, sf_dir, "policies")
    found = policy.terms(policies)
    literal = found.select("asn", F.explode("conjuncts").alias("c")).select("asn", F.explode(F.concat("c.positive", "c.negative")).alias("literal"))
    return literal.where(F.col("literal").rlike("^(RS|AS)-")).distinct()


# ---- paths, communities

PATHS = [("^AS1 .* AS2$", "^ 1 ( [0-9]+ )* 2 $"), ("[AS3 AS4]+ AS5", "( 3 | 4 )+ 5 "), ("^[^AS1]*$", "^( 0 | [2-9] )*$"), ("AS1 (AS2 | AS3)?", " 1 "), ("^AS1-AS4{2}", "^(( 1 )|( 2 )|( 3 )|( 4 )){2}")]


@query(
    "SELECT o, k::INTEGER AS k FROM (SELECT l_orderkey AS o, string_agg(concat(' ', l_suppkey % 10, ' '), '' ORDER BY l_linenumber, l_suppkey % 10) AS path FROM lineitem GROUP BY l_orderkey), (VALUES " + ", ".join(f"({k}, '{sql}')" for k, (_, sql) in enumerate(PATHS)) + ") t(k, re) WHERE regexp_matches(path, re)",
    "aut_nums",
)
def as_path_matches(spark, sf_dir):
    """Paths of up to seven AS numbers against expressions."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    paths = items.groupBy(F.col("l_orderkey").alias("o")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 10).alias("a")))), lambda x: x["a"]).alias("path"))
    compiled = [lang.path_expression(text).pattern for text, _ in PATHS]
    # The expressions are plain patterns over "<1> <2> ", so the JVM tries them.
    told = F.concat(F.lit(""), F.array_join(F.transform("path", lambda a: F.concat(F.lit("<"), a.cast("string"), F.lit("> "))), ""))
    hits = F.array_compact(F.array(*[F.when(told.rlike(p), F.lit(k)) for k, p in enumerate(compiled)]))
    return paths.select("o", F.explode(hits).alias("k"))


@query(
    """SELECT c_custkey AS id, list_has_all(have, want) AS has_all, list_has_all(have, want) AND list_has_all(want, have) AS equals FROM (SELECT c_custkey, list_transform(range(0, c_custkey % 5 + 1), lambda x: '65000:' || (x * c_custkey) % 7) AS have, list_transform(range(0, c_custkey % 3), lambda x: '65000:' || (x * 2) % 7) AS want FROM customer)""",
    "aut_nums",
)
def community_matches(spark, sf_dir):
    made = lambda n, m: F.transform(F.sequence(F.lit(0).cast("long"), n), lambda x: F.concat(F.lit("65000:"), ((x * m) % 7).cast("string")))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    have = made(F.col("id") % 5, F.col("id"))
    want = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(made(F.col("id") % 3 - 1, F.lit(2)))
    return rows.select("id", at.community_match(have, want).alias("has_all"), at.community_match(have, want, equals=True).alias("equals"))


# ---- look-up commands


@query(
    after(
        f"{ASNS}, mine AS (SELECT DISTINCT addr, plen, origin, source, concat({TEXT.format('addr')}, '/', plen) AS p, {KEYED} FROM routes), told AS ("
        + " UNION ALL ".join(
            [
                "SELECT '!gAS100001' AS command, (SELECT string_agg(p, ' ' ORDER BY addr, plen) FROM (SELECT DISTINCT addr, plen, p FROM mine WHERE origin = 100001)) AS data",
                "SELECT '!iAS-N1,1', (SELECT string_agg('AS' || asn, ' ' ORDER BY asn) FROM asns WHERE top = 'AS-N1')",
                "SELECT '!iAS-R1', (SELECT string_agg(child, ' ' ORDER BY child) FROM own WHERE set_name = 'AS-R1')",
                "SELECT '!a4AS-N2', (SELECT string_agg(p, ' ' ORDER BY addr, plen) FROM (SELECT DISTINCT addr, plen, p FROM asns JOIN mine ON origin = asn WHERE top = 'AS-N2'))",
                "SELECT '!a6AS-N2', ''",
                "SELECT '!r10.0.1.0/24,o', (SELECT string_agg('AS' || origin, ' ' ORDER BY origin) FROM (SELECT DISTINCT origin FROM mine WHERE p = '10.0.1.0/24'))",
                "SELECT '!r10.0.1.0/24,M', (SELECT string_agg(concat('route: ', p, chr(10), 'origin: AS', origin, chr(10), 'source: ', source), chr(10) || chr(10) ORDER BY plen, key, origin, source) FROM mine WHERE starts_with(key, '000010100000000000000001') AND plen > 24)",
                "SELECT '!jRIPE,NONE', concat('RIPE:Y:0-3', chr(10), 'NONE:X:')",
                "SELECT '!s-lc', 'RIPE,RADB,TEST'",
            ]
        )
        + "), others AS (SELECT * FROM (VALUES ('!6AS100001', 'D' || chr(10)), ('!gASx', 'F Malformed AS number' || chr(10)), ('!iAS-NOWHERE,1', 'D' || chr(10)), ('!sNONE', 'F One or more selected sources are unavailable.' || chr(10)), ('!!', 'C' || chr(10)), ('!nclient', 'C' || chr(10)), ('!zz', 'F Unrecognized command' || chr(10))) t(command, answer))",
        "SELECT command, CASE WHEN coalesce(data, '') = '' THEN 'C' || chr(10) ELSE concat('A', length(data) + 1, chr(10), data, chr(10), 'C', chr(10)) END AS answer FROM told UNION ALL SELECT command, answer FROM others",
    ),
    "sets",
    "members",
    "routes",
)
def command_answers(spark, sf_dir):
    """Framed answers of look-up commands: routes by origin, members, prefixes of a family, search, sources, refusals."""
    sets, members_, routes = load(spark, sf_dir, "sets", "members", "routes")
    keyed = routes.distinct().withColumn("key", bits(F.col("addr"), F.col("plen"))).select(F.lit(4).alias("af"), prefix_text(F.col("addr"), F.col("plen")).alias("prefix"), "plen", "key", "origin", "source")
    none = spark.createDataFrame([], "class string, pk string, source string, text string, name string, value string")
    tables = protocol.Tables(sets, members_, keyed, none, none, {"RIPE": 3, "RADB": 2, "TEST": 1})
    commands = ["!gAS100001", "!iAS-N1,1", "!iAS-R1", "!a4AS-N2", "!a6AS-N2", "!r10.0.1.0/24,o", "!r10.0.1.0/24,M", "!jRIPE,NONE", "!s-lc", "!6AS100001", "!gASx", "!iAS-NOWHERE,1", "!sNONE", "!!", "!nclient", "!zz"]
    return spark.createDataFrame([(c, protocol.Session(tables).do(c)) for c in commands], "command string, answer string")


@query(after(OWN, f"SELECT k.class, k.pk, string_agg(o.source || ':' || o.n, ',' ORDER BY o.source) AS found FROM (SELECT 'route' AS class, concat({TEXT.format('addr')}, '/', plen, 'AS', origin) AS pk, source, count(*) AS n FROM routes GROUP BY ALL) o JOIN (SELECT DISTINCT 'route' AS class, concat({TEXT.format('addr')}, '/', plen, 'AS', origin) AS pk FROM routes) k USING (class, pk) GROUP BY ALL"), "sets", "members", "routes")
def route_keys(spark, sf_dir):
    """Objects by class and key, with the registries that have them."""
    (routes,) = load(spark, sf_dir, "routes")
    named = routes.select(F.lit("route").alias("class"), F.concat(prefix_text(F.col("addr"), F.col("plen")), F.lit("AS"), F.col("origin").cast("string")).alias("pk"), "source")
    counted = named.groupBy("class", "pk", "source").count()
    return counted.groupBy("class", "pk").agg(F.array_join(F.array_sort(F.collect_list(F.concat("source", F.lit(":"), F.col("count").cast("string")))), ",").alias("found"))


# ---- other set classes, domains, authorisation


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 4 THEN lo END AS lo, CASE WHEN c_custkey % 5 <> 4 THEN hi END AS hi FROM (SELECT c_custkey, 167772160 + (c_custkey % 200) * 65536 + (c_custkey % 250) * 256 + CASE c_custkey % 5 WHEN 3 THEN 64 ELSE 0 END AS lo, 167772160 + (c_custkey % 200) * 65536 + (c_custkey % 250) * 256 + CASE c_custkey % 5 WHEN 3 THEN 127 ELSE 255 END AS hi FROM customer)", "aut_nums")
def reverse_domains(spark, sf_dir):
    """Address ranges of reverse domains, of parts of a /24 too."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    zone = numbered(F.col("id") % 250, ".", F.col("id") % 200, ".10.IN-ADDR.arpa")
    name = F.when(F.col("id") % 5 == 4, numbered("300.", zone)).when(F.col("id") % 5 == 3, numbered("64-127.", zone)).otherwise(zone)
    lo, hi = members.reverse_range(name)
    return rows.select("id", lo.alias("lo"), hi.alias("hi"))


@query(
    after("refers AS (SELECT 'MNT-S' || s_suppkey AS mnt, CASE WHEN s_suppkey % 9 <> 0 THEN 'MNT-S' || (s_suppkey // 2) END AS up FROM supplier), walk AS (SELECT mnt AS top, mnt AS node, 0 AS depth FROM refers UNION SELECT top, up, depth + 1 FROM walk JOIN refers ON node = mnt WHERE up IS NOT NULL)", "SELECT top, node, min(depth)::INTEGER AS depth FROM walk GROUP BY ALL"),
    "aut_nums",
)
def referral_chains(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    refers = rows.select(numbered("mnt-S", F.col("k")).alias("mnt"), F.when(F.col("k") % 9 != 0, numbered("MNT-S", F.floor(F.col("k") / 2))).alias("referral_by"))
    return auth.referral_chain(refers, refers.select("mnt")).select("top", "node", F.col("depth").cast("int").alias("depth"))


@query("SELECT c_custkey AS id, coalesce(mnt IN ('MNT-0', 'MNT-1', 'MNT-2', 'MNT-3', 'MNT-4'), false) AS allowed FROM (SELECT c_custkey, CASE WHEN a % 50 <= 49 - (a // 50) % 3 * 10 THEN 'MNT-' || a // 50 WHEN a < 700 THEN 'MNT-1' END AS mnt FROM (SELECT c_custkey, c_custkey % 1400 AS a FROM customer))", "aut_nums")
def authorise_aut_nums(spark, sf_dir):
    """New AS numbers: the object's maintainers and those of the smallest block around; some numbers are in a wide block only, some in none."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("update_id"), (100000 + F.col("c_custkey") % 1400).alias("asn"), F.array(F.lit("mnt-0")).alias("mnts"))
    none, i = F.array().cast("array<string>"), F.col("id")
    blocks = spark.range(30).select((100000 + i * 50).alias("lo"), (100049 + i * 50 - i % 3 * 10).alias("hi"), F.array(F.lit("MNT-99")).alias("mnts"), F.array(numbered("MNT-", i)).alias("mnt_lower"))
    wide = spark.range(1).select(F.lit(100000).cast("long").alias("lo"), F.lit(100699).cast("long").alias("hi"), F.array(F.lit("MNT-1")).alias("mnts"), none.alias("mnt_lower"))
    answers = rows.select("update_id", F.explode(F.array(*[F.lit(f"MNT-{k}") for k in range(5)])).alias("mnt"), F.lit(True).alias("ok"), F.lit(False).alias("unsupported"))
    return auth.decide(auth.aut_num_requirements(rows, blocks.union(wide)), answers).select(F.col("update_id").alias("id"), "allowed")


@query("SELECT c_custkey AS id, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS allowed, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN '' ELSE 'parent' END AS missing FROM customer", "aut_nums")
def authorise_sets(spark, sf_dir):
    """New sets: the object's maintainers, and those of the parent of a hierarchical name."""
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    name = F.when(F.col("k") % 3 == 0, numbered("AS-C", F.col("k"))).when(F.col("k") % 5 == 0, numbered("AS7:AS-C", F.col("k"))).otherwise(numbered("AS-P:AS-C", F.col("k")))
    rows = ids.select(F.col("k").alias("update_id"), name.alias("set_name"), F.array(F.lit("mnt-0")).alias("mnts"))
    none = F.array().cast("array<string>")
    sets = spark.createDataFrame([("AS-P", ["MNT-9"])], "set_name string, mnts array<string>").withColumn("mnt_lower", none)
    nums = spark.createDataFrame([(7, ["MNT-1"])], "asn long, mnts array<string>")
    answers = rows.select("update_id", F.explode(F.array(F.lit("MNT-0"), F.lit("MNT-1"))).alias("mnt"), F.lit(True).alias("ok"), F.lit(False).alias("unsupported"))
    return auth.decide(auth.set_requirements(rows, sets, nums), answers).select(F.col("update_id").alias("id"), "allowed", F.array_join("missing", ",").alias("missing"))


@query(
    after("sets AS (SELECT 'PRNG-R' || r_regionkey AS name FROM region UNION ALL SELECT 'PRNG-N' || n_nationkey FROM nation), steps AS (SELECT 'PRNG-R' || n_regionkey AS parent, 'PRNG-N' || n_nationkey AS child FROM nation UNION ALL SELECT 'PRNG-N' || n_nationkey, 'PRNG-R' || n_regionkey FROM nation WHERE n_nationkey % 6 = 0), walk AS (SELECT name AS top, name AS node FROM sets UNION SELECT top, child FROM walk JOIN steps ON node = parent)", "SELECT DISTINCT top, 'AS' || (100000 + s_suppkey) || ' at r' || s_suppkey % 3 AS peering FROM walk JOIN supplier ON node = 'PRNG-N' || s_nationkey"),
    "aut_nums",
)
def peering_sets(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    none, nation = F.lit(None).cast("string"), read("nation")
    rows = nation.select(numbered("PRNG-R", F.col("n_regionkey")).alias("set_name"), F.lit(0).alias("ord"), none.alias("peering"), numbered("PRNG-N", F.col("n_nationkey")).alias("child"))
    rows = rows.union(nation.where("n_nationkey % 6 = 0").select(numbered("PRNG-N", F.col("n_nationkey")), F.lit(1), none, numbered("PRNG-R", F.col("n_regionkey"))))
    rows = rows.union(read("supplier").select(numbered("PRNG-N", F.col("s_nationkey")), F.col("s_suppkey").cast("int"), numbered(" AS", F.col("s_suppkey") + 100000, "  at r", F.col("s_suppkey") % 3), none))
    sets = rows.select("set_name").distinct()
    return members.expand_peerings(sets.select(F.col("set_name").alias("top")), sets, rows).select("top", "peering")


@query(
    after(f"{ASNS}, sessions AS (SELECT 100000 + i AS peer FROM range(0, 40) r(i))", """SELECT k::INTEGER AS ord, why, string_agg(peer::VARCHAR, ' ' ORDER BY peer) AS peers FROM sessions, (VALUES (0, 'peer router not given'), (1, 'local router not given'), (2, 'peering regexp'), (3, 'unknown set')) t(k, why)
        WHERE CASE k WHEN 0 THEN peer = 100007 WHEN 1 THEN peer IN (SELECT asn FROM asns WHERE top = 'AS-N1') ELSE true END GROUP BY k, why"""),
    "sets",
    "members",
)
def undecided_terms(spark, sf_dir):
    """Terms that can't be told for some sessions, with the reason, merged over the peers."""
    sets, members_ = load(spark, sf_dir, "sets", "members")
    texts = ["from AS100007 192.0.2.1 accept ANY", "from AS-N1 at 192.0.2.2 accept ANY", "from <^AS1 .*$> accept ANY", "from AS-NOWHERE accept ANY", "from AS100003 accept ANY"]
    policies = spark.createDataFrame([(300000, "import", k, t) for k, t in enumerate(texts)], "asn long, attr string, ord int, text string")
    tops = sets.where("set_name = 'AS-N1'").select(F.col("set_name").alias("top")).distinct()
    membership = expand.expand_as(expand.expand_sets(tops, sets, members_, SOURCES), expand.chosen_members(sets, members_, SOURCES))
    sessions = spark.range(100000, 100040).select(F.lit(300000).cast("long").alias("local"), F.col("id").alias("peer"))
    told = policy.evaluate(sessions, policy.terms(policies), membership, sets.select(F.col("set_name").alias("top")))
    return policy.undecided(told).select("ord", "why", F.array_join(F.transform("peers", lambda x: x.cast("string")), " ").alias("peers"))


@query("SELECT p_partkey AS asn, 'AS-W' || p_partkey % 20 AS name FROM part WHERE p_partkey % 20 >= 5 AND (p_partkey % 20) % 5 = 0", "aut_nums")
def lint_any_set(spark, sf_dir):
    """Path expressions that name a set which reaches AS-ANY: of twenty sets in four chains of five the first of three chains do."""
    chains = [(f"AS-W{k}", f"AS-W{k + 1}" if k % 5 < 4 else "AS-ANY" if k > 4 else "AS-LAST") for k in range(20)]
    members_ = spark.createDataFrame(chains, "set_name string, child string")
    found = made_terms(spark, sf_dir, F.when(F.col("id") % 20 % 5 == 0, numbered("from AS1 accept <^AS1 AS-W", F.col("id") % 20, "+$>")).otherwise(F.lit("from AS1 accept <^AS1 AS2$>")))
    return policy.any_sets(found, members_).select("asn", "name")


@query("SELECT p_partkey AS asn, CASE WHEN p_partkey % 100 = 7 THEN 'policy/limit' WHEN p_partkey % 3 = 0 THEN 'policy/peeras' ELSE 'policy/filter-set-cycle' END AS rule FROM part", "aut_nums")
def lint_limit(spark, sf_dir):
    """Filters whose normal form meets a limit: a PeerAS without a peer, filter-sets that hold each other, too many alternatives."""
    sets = {"FLTR-A": lang.parse_filter("FLTR-B OR AS1")[0], "FLTR-B": lang.parse_filter("NOT FLTR-A")[0]}
    many = " AND ".join(f"(AS{10 * k + 1} OR AS{10 * k + 2})" for k in range(13))
    text = F.when(F.col("id") % 100 == 7, f"from AS1 accept {many}").when(F.col("id") % 3 == 0, "from AS-ANY accept PeerAS").otherwise("from AS1 accept FLTR-A")
    return policy.limits(made_terms(spark, sf_dir, text, filter_sets=sets)).select("asn", "rule")


REPEATS = [("^AS1~+ AS2", "^( 1 )+ 2 "), ("^.~{2} ", "^(( 0  0 )|( 1  1 )|( 2  2 )|( 3  3 )|( 4  4 )|( 5  5 )|( 6  6 )|( 7  7 )|( 8  8 )|( 9  9 ))"), ("^[AS3 AS4]~*$", "^(( 3 )*|( 4 )*)$")]


@query(
    "SELECT o, k::INTEGER AS k FROM (SELECT l_orderkey AS o, string_agg(concat(' ', l_suppkey % 10, ' '), '' ORDER BY l_linenumber, l_suppkey % 10) AS path FROM lineitem GROUP BY l_orderkey), (VALUES " + ", ".join(f"({k}, '{sql}')" for k, (_, sql) in enumerate(REPEATS)) + ") t(k, re) WHERE regexp_matches(path, re)",
    "aut_nums",
)
def as_path_repeats(spark, sf_dir):
    """Repeats of one AS: what stands again is the AS that was met, not any that the item takes."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    paths = items.groupBy(F.col("l_orderkey").alias("o")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 10).alias("a")))), lambda x: x["a"]).alias("path"))
    told = F.array_join(F.transform("path", lambda a: F.concat(F.lit("<"), a.cast("string"), F.lit("> "))), "")
    hits = F.array_compact(F.array(*[F.when(told.rlike(lang.path_expression(text).pattern), F.lit(k)) for k, (text, _) in enumerate(REPEATS)]))
    return paths.select("o", F.explode(hits).alias("k"))
