"""From dump text to expanded sets, on a small registry with every trait."""

import json

import pytest
from pyspark.sql import functions as F

from routeloom.operators import expand, model, registry
from routeloom.sources import rpsl

TEXT = """# harbour registry, first part
aut-num: AS3301
member-of: AS-PIER
mnt-by: quay-mnt
import: from AS21
        accept ANY
export: to AS21 announce AS3301
source: HARBOUR

route: 172.20.16.0/20
origin: AS3320
mnt-by: M
source: HARBOUR

as-set: AS-BREAKWATER
members: AS3320, as3321,
+ AS-LIGHTSHIP
source: HARBOUR

route-set: RS-DOCKS
members: 172.24.0.0/22^23-24, 172.25.8.0/29^+, RS-SLIPWAY^25-26, 172.26.0.6/31^-, 100/8
source: HARBOUR

as-set: as-pier
members: AS3322
mbrs-by-ref: QUAY-MNT
source: HARBOUR

as-set: AS-LIGHTSHIP
members: AS-BREAKWATER, AS3323 # the cycle
source: HARBOUR

as-set: AS-TIDE
members: AS3330
source: LAGOON

as-set: AS-TIDE
members: AS3331
source: HARBOUR

as-set: AS-CHART
members: AS-TIDE, AS-BREAKWATER
src-members: LAGOON::AS-TIDE, HARBOUR::AS-DOUBLE, LAGOON::AS-DOUBLE
source: HARBOUR

aut-num: AS3302
member-of: AS-PIER
mnt-by: OTHER-MNT
source: HARBOUR

aut-num: 977
source: HARBOUR

route: 172.20.400.0/24
origin: AS3320
source: HARBOUR

as-set: WHARF
no colon here
source: HARBOUR
"""
ORDER = ("HARBOUR", "LAGOON")


@pytest.fixture(scope="module")
def objects(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "harbour.db"
    path.write_text(TEXT)
    return rpsl.scan(spark, str(path)).cache()


def test_expansion_from_a_dump(spark, objects):
    sets, members = model.sets(objects), model.members(objects)
    tops = sets.where("class = 'as-set'").select(F.col("set_name").alias("top")).distinct()
    own = expand.chosen_members(sets, members, ORDER)
    nodes = expand.expand_sets(tops, sets, members, ORDER)
    claims = expand.allowed_claims(sets, model.claims(objects).where("class = 'aut-num'"))
    got = {}
    for r in expand.expand_as(nodes, own, claims).collect():
        got.setdefault(r["top"], set()).add(r["asn"])
    assert got["AS-BREAKWATER"] == got["AS-LIGHTSHIP"] == {3320, 3321, 3323}
    assert got["AS-PIER"] == {3322, 3301} and got["AS-TIDE"] == {3331}
    # A scoped member is the set of its registry, whatever wins elsewhere.
    assert got["AS-CHART"] == {3330, 3320, 3321, 3323}
    assert not expand.missing(nodes, own, sets).count()


def test_members(objects):
    rows = {(r["set_name"], r["item"]): r for r in model.members(objects).collect()}
    assert rows["AS-CHART", "LAGOON::AS-TIDE"]["child_source"] == "LAGOON"
    assert ("AS-CHART", "AS-TIDE") not in rows and not any("DOUBLE" in k[1] for k in rows)
    told = rows["RS-DOCKS", "172.24.0.0/22^23-24"]
    assert (told["plen"], told["op"]) == (22, "^23-24") and rows["RS-DOCKS", "100/8"]["addr"] == 100 << 24
    assert (rows["RS-DOCKS", "RS-SLIPWAY^25-26"]["child"], rows["RS-DOCKS", "RS-SLIPWAY^25-26"]["op"]) == ("RS-SLIPWAY", "^25-26")


def test_ranges_from_a_dump(spark, objects):
    members = model.members(objects)
    got = expand.expand_ranges(spark.createDataFrame([("RS-DOCKS",)], "top string"), members).where("plen > 8")
    assert {(r["plen"], r["lo"], r["hi"]) for r in got.collect()} == {(22, 23, 24), (29, 29, 32), (31, 32, 32)}


def test_routes_policies_and_typed(objects):
    assert [(r["plen"], r["origin"], r["source"]) for r in model.routes(objects).collect()] == [(20, 3320, "HARBOUR")]
    assert [(r["asn"], r["attr"], r["text"]) for r in model.policies(objects).orderBy("ord").collect()] == [(3301, "import", "from AS21 accept ANY"), (3301, "export", "to AS21 announce AS3301")]
    row = model.typed(objects, "aut-num").where("aut_num = 'AS3301'").first()
    assert row["member_of"] == ["AS-PIER"] and row["source"] == "HARBOUR" and row["default"] == []


def test_diagnostics_and_report(objects):
    rules = sorted(r["rule"] for r in model.diagnostics(objects).collect())
    assert rules == ["lexer/malformed-line", "object/as-set-name", "object/aut-num-bare-number", "object/route-prefix"]
    told = json.loads(model.report(objects).first()["report"])
    assert told["objects"] == 13 and told["class_counts"]["as-set"] == 7 and told["diagnostics_total"] == 4


def test_profile(spark, objects):
    rows = rpsl.attributes(objects).select(F.concat_ws("/", "file", "block", "seq").alias("obj_id"), "class", "name", "value")
    found = {(r["rule"], r["name"]) for r in registry.violations(rows.where("class = 'route'"), model.profile()).collect()}
    assert found == {("dict/missing-required", "mnt-by")}
    odd = spark.createDataFrame([("1", "route", "origin", "a"), ("1", "route", "origin", "b"), ("1", "route", "zzz", "b"), ("2", "cat", "cat", "x")], "obj_id string, class string, name string, value string")
    found = {(r["obj_id"], r["rule"], r["name"]) for r in registry.violations(odd, model.profile()).collect()}
    assert {("1", "dict/cardinality", "origin"), ("1", "dict/unknown-attribute", "zzz"), ("2", "dict/unknown-class", "cat"), ("1", "dict/missing-required", "route")} <= found


def test_profiles_by_name(spark):
    rows = [("1", "aut-num", n, "x") for n in ("aut-num", "as-name", "admin-c", "tech-c", "source", "created", "created")] + [("2", "mntner", "mntner", "M"), ("3", "as-set", "src-members", "x"), ("3", "as-set", "as-set", "x"), ("3", "as-set", "mnt-by", "x"), ("3", "as-set", "source", "x")]
    df = spark.createDataFrame(rows, "obj_id string, class string, name string, value string")
    told = lambda classes: {(r["obj_id"], r["rule"], r["name"]) for r in registry.violations(df, model.profile(classes)).collect()}
    irr, arin = told(model.PROFILES["irr"]), told(model.with_src_members(model.PROFILES["arin"]))
    assert irr == {("1", "dict/unknown-attribute", "created"), ("2", "dict/unknown-class", "mntner"), ("3", "dict/unknown-attribute", "src-members")}
    assert arin == {("1", "dict/cardinality", "created"), ("2", "dict/unknown-class", "mntner")}


def test_gzip_by_its_first_bytes(spark, tmp_path):
    import gzip

    (tmp_path / "packed.db").write_bytes(gzip.compress(b"route: 10.0.0.0/8\norigin: AS1\nsource: T\n\nas-set: AS-X\nsource: T\n"))
    (tmp_path / "plain.db").write_text("route: 10.1.0.0/16\norigin: AS2\nsource: T\n")
    (tmp_path / "named.db.gz").write_bytes(gzip.compress(b"route: 10.2.0.0/16\norigin: AS3\nsource: T\n"))
    assert {r["key"] for r in rpsl.scan(spark, str(tmp_path)).collect()} == {"10.0.0.0/8", "10.1.0.0/16", "10.2.0.0/16", "AS-X"}


def test_texts(objects):
    raw = {r["text"] for r in model.object_text(objects).collect()}
    assert {t.strip() for t in TEXT.split("\n\n")} == {t.strip() for t in raw}
    neat = [r["text"] for r in model.formatted(objects).collect() if "AS3301\n" in r["text"]]
    assert "aut-num:        AS3301\n" in neat[0] and "import:         from AS21\n                accept ANY\n" in neat[0]


def test_both_families(spark, tmp_path):
    from routeloom.functions.prefix import parsed
    from routeloom.operators import cover

    (tmp_path / "x.db").write_text("route6: 2001:DB8:1::1/48\norigin: AS1\nsource: T\n\nroute: 32.1.0.0/16\norigin: AS1\nsource: T\n\nroute6: 10.0.0.0/8\norigin: AS1\nsource: T\n\nroute6: 2001:db8:2::/48\norigin: AS2\nsource: T\n")
    routes = model.all_routes(rpsl.scan(spark, str(tmp_path / "x.db"))).cache()
    assert {(r["af"], r["prefix"], r["origin"]) for r in routes.collect()} == {(6, "2001:db8:1::/48", 1), (4, "32.1.0.0/16", 1), (6, "2001:db8:2::/48", 2)}
    vrps = spark.createDataFrame([("2001:db8::/32", 48, 1), ("2000::/8", 8, 7)], "t string, max_length int, asn long").select(parsed("t").alias("p"), "max_length", "asn").select("p.af", "p.plen", "p.key", "max_length", "asn")
    got = {r["prefix"]: r["state"] for r in cover.validate(routes, vrps, ["prefix"]).collect()}
    assert got == {"2001:db8:1::/48": "valid", "2001:db8:2::/48": "invalid", "32.1.0.0/16": "not_found"}
