"""A routing registry made of the star-schema tables, by the same SQL in Spark and in DuckDB.

Sets nest (suppliers in nations in regions in AS-WORLD), with cycles, missing sets and sets that two registries hold; parts originate
IPv4 routes and customers more specific ones; brands are route-sets with range operators; customers claim membership; ROAs cover a
third of the parts; events change objects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Registries in order of precedence.
SOURCES = ("RIPE", "RADB", "TEST")
SOURCE = "CASE {0} % 3 WHEN 0 THEN 'RIPE' WHEN 1 THEN 'RADB' ELSE 'TEST' END"
SUPPLIERS = "(SELECT count(*) FROM {supplier})"
OCTETS = "concat(CAST(CAST(floor({0} / 16777216) AS BIGINT) AS STRING), '.', CAST(CAST(floor({0} / 65536) AS BIGINT) % 256 AS STRING), '.', CAST(CAST(floor({0} / 256) AS BIGINT) % 256 AS STRING), '.', CAST({0} % 256 AS STRING))"
PART_ADDRESS = "(167772160 + (p_partkey % 65536) * 256)"

VIEWS = {
    "aut_nums": f"SELECT 100000 + s_suppkey AS asn, s_nationkey AS nation, {SOURCE.format('s_suppkey')} AS source, concat('MNT-', CAST(s_suppkey % 7 AS STRING)) AS mnt FROM {{supplier}}",
    "sets": """
        SELECT concat('AS-N', CAST(n_nationkey AS STRING)) AS set_name, 'as-set' AS class, 'RIPE' AS source, CASE WHEN n_nationkey % 6 = 0 THEN 'ANY' ELSE 'BUILDING,machinery' END AS mbrs_by_ref FROM {nation}
        UNION ALL SELECT concat('AS-N', CAST(n_nationkey AS STRING)), 'as-set', 'RADB', '' FROM {nation} WHERE n_nationkey % 4 = 0
        UNION ALL SELECT concat('AS-R', CAST(r_regionkey AS STRING)), 'as-set', 'RADB', '' FROM {region}
        UNION ALL SELECT 'AS-WORLD', 'as-set', 'TEST', ''""",
    "members": """
        SELECT concat('AS-N', CAST(s_nationkey AS STRING)) AS set_name, 'RIPE' AS source, 100000 + s_suppkey AS asn, CAST(NULL AS STRING) AS child FROM {supplier}
        UNION ALL SELECT concat('AS-N', CAST(n_nationkey AS STRING)), 'RADB', 99, NULL FROM {nation} WHERE n_nationkey % 4 = 0
        UNION ALL SELECT concat('AS-N', CAST(n_nationkey AS STRING)), 'RIPE', NULL, concat('AS-R', CAST(n_regionkey AS STRING)) FROM {nation} WHERE n_nationkey % 5 = 0
        UNION ALL SELECT concat('AS-N', CAST(n_nationkey AS STRING)), 'RIPE', NULL, concat('AS-MISSING', CAST(n_nationkey AS STRING)) FROM {nation} WHERE n_nationkey % 7 = 0
        UNION ALL SELECT concat('AS-R', CAST(n_regionkey AS STRING)), 'RADB', NULL, concat('AS-N', CAST(n_nationkey AS STRING)) FROM {nation}
        UNION ALL SELECT 'AS-WORLD', 'TEST', NULL, concat('AS-R', CAST(r_regionkey AS STRING)) FROM {region}""",
    "routes": f"""
        SELECT {PART_ADDRESS} AS addr, 24 AS plen, 100001 + p_partkey % {SUPPLIERS} AS origin, {SOURCE.format('p_partkey')} AS source FROM {{part}}
        UNION ALL SELECT 167772160 + (c_custkey % 2000) * 256 + CAST(floor(c_custkey / 2000) AS BIGINT) % 2 * 128, 25 + CAST(c_custkey % 4 AS INT), 100001 + c_custkey % {SUPPLIERS}, {SOURCE.format('c_custkey')} FROM {{customer}}""",
    "claims": f"SELECT 200000 + c_custkey AS asn, concat('AS-N', CAST(c_nationkey AS STRING)) AS member_of, c_mktsegment AS mnt, {SOURCE.format('c_custkey')} AS source FROM {{customer}}",
    # Route-sets of nations: AS numbers, a nation's as-set, another nation's route-set of one registry or of any, and routes that claim to be in them.
    "route_sets": """
        SELECT concat('RS-M', CAST(n_nationkey AS STRING)) AS set_name, 'RIPE' AS source, CASE WHEN n_nationkey % 3 = 0 THEN 'ANY' ELSE 'BUILDING' END AS mbrs_by_ref FROM {nation}
        UNION ALL SELECT concat('RS-M', CAST(n_nationkey AS STRING)), 'RADB', '' FROM {nation} WHERE n_nationkey % 4 = 0""",
    "route_set_members": """
        SELECT concat('RS-M', CAST(s_nationkey AS STRING)) AS set_name, 'RIPE' AS source, 100000 + s_suppkey AS asn, CAST(NULL AS STRING) AS child, CAST(NULL AS STRING) AS child_source, CAST(NULL AS BIGINT) AS addr, CAST(NULL AS INT) AS plen, CASE WHEN s_suppkey % 2 = 0 THEN '^+' ELSE '' END AS op FROM {supplier} WHERE s_suppkey % 3 = 0
        UNION ALL SELECT concat('RS-M', CAST(n_nationkey AS STRING)), 'RADB', CAST(NULL AS BIGINT), NULL, NULL, 2886729728 + n_nationkey * 256, 24, '' FROM {nation} WHERE n_nationkey % 4 = 0
        UNION ALL SELECT concat('RS-M', CAST(n_nationkey AS STRING)), 'RIPE', NULL, concat('AS-N', CAST(n_nationkey AS STRING)), NULL, NULL, NULL, '^25-26' FROM {nation} WHERE n_nationkey % 2 = 0
        UNION ALL SELECT concat('RS-M', CAST(n_nationkey AS STRING)), 'RIPE', NULL, concat('RS-M', CAST((n_nationkey * 3 + 1) % 25 AS STRING)), NULL, NULL, NULL, '' FROM {nation} WHERE n_nationkey % 5 = 1
        UNION ALL SELECT concat('RS-M', CAST(n_nationkey AS STRING)), 'RIPE', NULL, concat('RS-M', CAST((n_nationkey + 4) % 25 AS STRING)), 'RADB', NULL, NULL, '' FROM {nation}""",
    "route_claims": f"SELECT 'route' AS class, 300000 + c_custkey AS asn, {PART_ADDRESS.replace('p_partkey', 'c_custkey')} AS addr, 24 AS plen, concat('RS-M', CAST(c_nationkey AS STRING)) AS member_of, c_mktsegment AS mnt, CASE WHEN c_custkey % 5 = 0 THEN 'RADB' ELSE 'RIPE' END AS source FROM {{customer}} WHERE c_custkey % 3 = 0",
    "vrps": f"SELECT {PART_ADDRESS} AS addr, 24 AS plen, 24 + p_size % 5 AS max_length, CASE WHEN p_partkey % 11 = 0 THEN 0 WHEN p_partkey % 3 <> 0 THEN 100001 + p_partkey % {SUPPLIERS} ELSE 64999 END AS asn FROM {{part}} WHERE p_size % 3 = 0",
    "range_members": f"""
        SELECT replace(p_brand, 'Brand#', 'RS-B') AS set_name, CAST(NULL AS STRING) AS child, {PART_ADDRESS} AS addr, 24 AS plen, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '^+' WHEN 2 THEN '^-' WHEN 3 THEN '^26' ELSE '^25-27' END AS op FROM {{part}}
        UNION ALL SELECT DISTINCT concat('RS-G', substr(p_brand, 7, 1)), replace(p_brand, 'Brand#', 'RS-B'), NULL, NULL, CASE CAST(substr(p_brand, 7) AS INT) % 4 WHEN 0 THEN '' WHEN 1 THEN '^+' WHEN 2 THEN '^-' ELSE '^26-28' END FROM {{part}}
        UNION ALL SELECT DISTINCT replace(p_brand, 'Brand#', 'RS-B'), concat('RS-G', substr(p_brand, 7, 1)), NULL, NULL, '^+' FROM {{part}} WHERE CAST(substr(p_brand, 7) AS INT) % 14 = 1
        UNION ALL SELECT concat('RS-B', CAST(CAST(substr(p_brand, 7) AS INT) % 25 + 1 AS STRING)), NULL, {PART_ADDRESS} - {PART_ADDRESS} % 512, 23, '^24-26' FROM {{part}} WHERE p_partkey % 7 = 0""",
    "aspas": "SELECT 100000 + s_suppkey AS customer, 100000 + (s_suppkey * 7 + 3) % 100 AS provider FROM {supplier} WHERE s_suppkey % 2 = 0 UNION SELECT 100000 + s_suppkey, 100000 + (s_suppkey * 5 + 1) % 100 FROM {supplier} WHERE s_suppkey % 4 = 0",
    "neighbours": "SELECT 100000 + s_suppkey AS asn, 100000 + (s_suppkey * 7 + 3) % 100 AS peer, CASE WHEN s_suppkey % 3 = 0 THEN 'provider' ELSE 'peer' END AS kind FROM {supplier} UNION ALL SELECT 100000 + s_suppkey, 100000 + (s_suppkey * 11 + 5) % 130, 'provider' FROM {supplier}",
    # Each nation announces a brand's route-set to one other; that one takes most of it, in one or two terms, the second sometimes idle.
    "policies": """
        SELECT 200000 + n_nationkey AS asn, 'export' AS attr, 0 AS ord, concat('to AS', CAST(200000 + (n_nationkey * 3 + 1) % 25 AS STRING), ' announce RS-B', CAST(n_nationkey + 1 AS STRING)) AS text FROM {nation}
        UNION ALL SELECT 200000 + (n_nationkey * 3 + 1) % 25, 'import', n_nationkey, concat('from AS', CAST(200000 + n_nationkey AS STRING), ' action pref=', CAST(10 + n_nationkey AS STRING), '; accept RS-B', CAST(n_nationkey + 1 AS STRING), ' AND NOT {{10.', CAST(n_nationkey % 8 AS STRING), '.0.0/17^+}}') FROM {nation}
        UNION ALL SELECT 200000 + (n_nationkey * 3 + 1) % 25, 'import', 100 + n_nationkey, concat('from AS', CAST(200000 + n_nationkey AS STRING), ' accept ', CASE n_nationkey % 3 WHEN 0 THEN '{{10.0.0.0/18^24}}' WHEN 1 THEN concat('RS-B', CAST(n_nationkey + 1 AS STRING), ' AND {{10.200.0.0/16^+}}') ELSE concat('RS-B', CAST(n_nationkey + 1 AS STRING), ' AND {{10.', CAST(n_nationkey % 8 AS STRING), '.128.0/17^+}}') END) FROM {nation} WHERE n_nationkey % 2 = 0
        UNION ALL SELECT 200000 + n_nationkey, 'import', 200, 'from AS999999 accept AS-MISSING9' FROM {nation} WHERE n_nationkey % 5 = 0
        UNION ALL SELECT 200000 + n_nationkey, 'import', 300, 'from accept' FROM {nation} WHERE n_nationkey % 6 = 0""",
    "mutations": "SELECT CASE user_id % 2 WHEN 0 THEN 'aut-num' ELSE 'route' END AS class, concat('K', CAST(user_id AS STRING)) AS pk, CASE user_id % 3 WHEN 0 THEN 'RIPE' WHEN 1 THEN 'RADB' ELSE 'TEST' END AS source, CASE WHEN event_type = 'error' OR event_id % 9 = 0 THEN 'DEL' ELSE 'ADD' END AS operation, CAST(floor(value) AS BIGINT) AS payload, event_id AS seq FROM {events}",
    "attributes": """
        SELECT o_orderkey AS obj_id, 'route' AS class, 'route' AS name, CAST(o_orderkey AS STRING) AS value FROM {orders}
        UNION ALL SELECT o_orderkey, 'route', 'origin', concat('AS', CAST(o_custkey AS STRING)) FROM {orders} WHERE o_orderkey % 13 <> 0
        UNION ALL SELECT l_orderkey, 'route', CASE WHEN l_linenumber = 1 THEN 'descr' WHEN l_linenumber = 2 THEN 'mnt-by' WHEN l_linenumber = 3 THEN 'origin' WHEN l_linenumber = 4 THEN 'source' ELSE 'x-unknown' END, CASE WHEN l_linenumber = 2 AND l_orderkey % 5 = 0 THEN ' ' ELSE l_returnflag END FROM {lineitem}""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def registry(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named relations as frames; nothing is read that they don't need."""
    return [spark.sql(VIEWS[n], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f"{{{t}}}" in VIEWS[n]}) for n in names]


def with_views(query: str, *names: str) -> str:
    """`query` for DuckDB, with the named relations before it."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in BASE})})" for n in names) + " " + query.strip()
