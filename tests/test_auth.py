"""Authorisation, router and peering sets, ranges as prefixes."""

import ipaddress
import random

from pyspark.sql import functions as F

from routeloom.operators import auth, members

key = lambda a, n: f"{a:032b}"[:n]
TEN = 10 << 24


def test_route_creation(spark):
    # Workers don't import this file, so the function is made here and goes along.
    def verifier(scheme, value, credential):
        return value == credential if scheme.upper() == "PASS" else None

    mntners = spark.createDataFrame([("M-OWN", ["PASS a"]), ("M-AS", ["PASS b", "X509 k"]), ("M-LOW", ["PASS c"]), ("M-TOP", ["X509 z"])], "mnt string, auth array<string>")
    updates = spark.createDataFrame([(n, key(TEN + (1 << 16), 16), 16, o, ["m-own"]) for n, o in ((1, 1), (2, 1), (3, 9))] + [(4, key(1 << 24, 8), 8, 1, ["M-OWN"])], "update_id int, key string, plen int, origin long, mnts array<string>")
    nums = spark.createDataFrame([(1, ["M-AS"], [])], "asn long, mnts array<string>, mnt_routes array<string>")
    around = spark.createDataFrame([(key(TEN, 8), 8, ["M-TOP"], [], []), (key(TEN, 12), 12, ["M-TOP"], ["M-LOW"], [])], "key string, plen int, mnts array<string>, mnt_lower array<string>, mnt_routes array<string>")
    given = [(n, m, c) for n in (1, 3, 4) for m, c in (("M-OWN", "a"), ("M-AS", "b"), ("M-LOW", "c"))] + [(2, "M-OWN", "a"), (2, "M-AS", "bad"), (2, "M-LOW", "c")]
    answers = auth.accepted(mntners, spark.createDataFrame(given, "update_id int, mnt string, credential string"), verifier)
    got = {r["update_id"]: r for r in auth.decide(auth.route_requirements(updates, nums, around), answers).collect()}
    assert {n: (r["allowed"], r["missing"]) for n, r in got.items()} == {1: (True, []), 2: (False, ["origin"]), 3: (False, ["origin"]), 4: (False, ["space"])}
    assert got[2]["unsupported"] and not got[1]["unsupported"]


def test_other_requirements(spark):
    nums = spark.createDataFrame([(1, 500, ["A"]), (2, 5000, ["A"])], "update_id int, asn long, mnts array<string>")
    blocks = spark.createDataFrame([(1, 1000, ["B"], []), (400, 600, ["C"], ["D"])], "lo long, hi long, mnts array<string>, mnt_lower array<string>")
    rows = {(r["update_id"], r["reason"]): r["mnts"] for r in auth.aut_num_requirements(nums, blocks).collect()}
    assert rows == {(1, "object"): ["A"], (2, "object"): ["A"], (1, "as-block"): ["D"], (2, "as-block"): None}
    sets = spark.createDataFrame([("AS1:AS-X", ["S"], [])], "set_name string, mnts array<string>, mnt_lower array<string>")
    asked = spark.createDataFrame([(1, "AS1:AS-X:AS-Y", ["A"]), (2, "AS7:AS-Z", ["A"]), (3, "AS-P", ["A"])], "update_id int, set_name string, mnts array<string>")
    rows = {(r["update_id"], r["reason"]): r["mnts"] for r in auth.set_requirements(asked, sets, spark.createDataFrame([(7, ["N"])], "asn long, mnts array<string>")).collect()}
    assert rows[1, "parent"] == ["S"] and rows[2, "parent"] == ["N"] and (3, "parent") not in rows
    chain = auth.referral_chain(spark.createDataFrame([("a", "B"), ("B", "c"), ("C", "C"), ("d", "a")], "mnt string, referral_by string"), spark.createDataFrame([("A",)], "mnt string"))
    assert {(r["node"], r["depth"]) for r in chain.collect()} == {("A", 0), ("B", 1), ("C", 2)}


def test_routers_and_peerings(spark):
    sets = spark.createDataFrame([("RTRS-A",), ("RTRS-B",), ("PRNG-A",), ("PRNG-B",)], "set_name string")
    tops = lambda x: spark.createDataFrame([(x,)], "top string")
    rows = spark.createDataFrame([("RTRS-A", "10.0.0.1", None), ("RTRS-A", None, "RTRS-B"), ("RTRS-B", "R.Example.net", None), ("RTRS-B", None, "RTRS-A")], "set_name string, router string, child string")
    assert {r["router"] for r in members.expand_routers(tops("RTRS-A"), sets, rows).collect()} == {"10.0.0.1", "r.example.net"}
    rows = spark.createDataFrame([("PRNG-A", 1, "AS2  at 1.1.1.1", None), ("PRNG-A", 0, "AS1", None), ("PRNG-A", 2, None, "PRNG-B"), ("PRNG-B", 0, "AS2 at 1.1.1.1", None), ("PRNG-B", 1, "AS3", None)], "set_name string, ord int, peering string, child string")
    assert [r["peering"] for r in members.expand_peerings(tops("PRNG-A"), sets, rows).orderBy("place").collect()] == ["AS1", "AS2 at 1.1.1.1", "AS3"]


def test_ranges_as_prefixes(spark):
    rng = random.Random(4)
    pairs = [(0, 2**32 - 1), (5, 5)] + [tuple(sorted((rng.randrange(2**32), rng.randrange(2**32)))) for _ in range(60)]
    got = {}
    for r in members.range_prefixes(spark.createDataFrame(pairs, "lo long, hi long")).collect():
        got.setdefault((r["lo"], r["hi"]), set()).add((r["addr"], r["plen"]))
    for lo, hi in pairs:
        want = ipaddress.summarize_address_range(ipaddress.IPv4Address(lo), ipaddress.IPv4Address(hi))
        assert got[lo, hi] == {(int(n.network_address), n.prefixlen) for n in want}


def test_reverse_domains(spark):
    names = ["2.0.192.in-addr.arpa", "0-63.2.0.192.IN-ADDR.ARPA.", "10.in-addr.arpa", "300.in-addr.arpa", "8.b.d.0.1.0.0.2.ip6.arpa", "x"]
    low, high = members.reverse_range(F.col("n"))
    got = [tuple(r) for r in spark.createDataFrame([(n,) for n in names], "n string").select(low, high).collect()]
    net = 192 << 24 | 2 << 8
    assert got == [(net, net + 255), (net, net + 63), (TEN, TEN + 2**24 - 1), (None, None), (None, None), (None, None)]
