"""Commands and their framed answers."""

import pytest
from pyspark.sql import functions as F

from routeloom.functions.prefix import parsed
from routeloom.operators import cover
from routeloom.operators.protocol import Session, Tables

TEN = 10 << 24


@pytest.fixture(scope="module")
def session(spark):
    sets = spark.createDataFrame([("AS-A", "as-set", "RIPE", ""), ("AS-B", "as-set", "RADB", "")], "set_name string, class string, source string, mbrs_by_ref string")
    members = spark.createDataFrame([("AS-A", "RIPE", 2, None), ("AS-A", "RIPE", None, "AS-B"), ("AS-B", "RADB", 10, None), ("AS-B", "RADB", None, "AS-A")], "set_name string, source string, asn long, child string")
    routes = cover.with_key(spark.createDataFrame([(TEN, 8, 2, "RIPE"), (TEN, 16, 10, "RADB"), (TEN, 16, 2, "RIPE"), (TEN + 256, 24, 10, "RADB")], "addr long, plen int, origin long, source string"))
    text = lambda k: f"aut-num: AS{k}\nmember-of: AS-A, AS-Z\nsource: RIPE\n"
    objects = spark.createDataFrame([("aut-num", "AS2", "RIPE", text(2)), ("aut-num", "AS10", "RADB", text(10))], "class string, pk string, source string, text string")
    attributes = spark.createDataFrame([("aut-num", "AS2", "RIPE", "member-of", "AS-A, AS-Z"), ("aut-num", "AS10", "RADB", "mnt-by", "M")], "class string, pk string, source string, name string, value string")
    return Session(Tables(sets, members, routes, objects, attributes, {"RIPE": 5, "RADB": 9}))


@pytest.mark.parametrize(
    ("line", "data"),
    [
        ("!gAS2", "10.0.0.0/8 10.0.0.0/16"),
        ("!iAS-A", "AS2 AS-B"),
        ("!iAS-A,1", "AS2 AS10"),
        ("!aAS-B", "10.0.0.0/8 10.0.0.0/16 10.0.1.0/24"),
        ("!r10.0.0.0/16,o", "AS2 AS10"),
        ("!r10.0.1.0/24,l", "route: 10.0.0.0/16\norigin: AS2\nsource: RIPE\n\nroute: 10.0.0.0/16\norigin: AS10\nsource: RADB"),
        ("!s-lc", "RIPE,RADB"),
        ("!j-*", "RIPE:Y:0-5\nRADB:Y:0-9"),
        ("!jNONE", "NONE:X:"),
        ("!maut-num,as2", "aut-num: AS2\nmember-of: AS-A, AS-Z\nsource: RIPE"),
    ],
)
def test_answers(session, line, data):
    assert session.do(line) == f"A{len(data) + 1}\n{data}\nC\n"


def test_search_depths(session):
    count = lambda line: session.do(line).count("route:")
    assert [count("!r10.0.1.0/24,L"), count("!r10.0.0.0/8,M"), count("!r10.0.0.0/8")] == [4, 3, 1]


def test_errors_and_state(session):
    assert session.do("!gAS77") == "D\n" and session.do("!iAS-NO") == "D\n" and session.do("!r192.0.2.0/24") == "D\n"
    assert session.do("!gFOO").startswith("F ") and session.do("!rx").startswith("F ") and session.do("!e").startswith("F ") and session.do("!?").startswith("F ")
    assert session.do("!sNONE").startswith("F ") and session.do("!sRADB") == "C\n"
    try:
        assert session.do("!gAS2") == "D\n"
    finally:
        session.do("!sRIPE,RADB")
    assert session.do("!!") == "C\n" and session.persistent and session.do("!n x") == "C\n"


def test_inverse(session):
    assert session.do("-i member-of AS-A").startswith("aut-num: AS2\n")
    assert session.do("-K -i mnt-by m") == "aut-num: AS10\n\n"
    assert session.do("-T route AS2") == "% No entries found\n\n" and session.do("-i x y").startswith("%%") and session.do("-Z a").startswith("%%")


def test_both_families(spark):
    """Commands with routes of both families: !6 and !a6 answer with IPv6, !a with both, !r by the prefix."""
    sets = spark.createDataFrame([("AS-A", "as-set", "RIPE", "")], "set_name string, class string, source string, mbrs_by_ref string")
    members = spark.createDataFrame([("AS-A", "RIPE", 7, None), ("AS-A", "RIPE", 8, None)], "set_name string, source string, asn long, child string")
    rows = [("10.2.0.0/16", 7), ("2001:db8:20::/44", 7), ("2001:db8::/32", 8), ("2001:db8:20::/48", 8), ("10.1.0.0/16", 8)]
    routes = spark.createDataFrame([(p, o, "RIPE") for p, o in rows], "t string, origin long, source string").select(parsed("t").alias("p"), "origin", "source").select("p.af", F.col("p.text").alias("prefix"), "p.plen", "p.key", "origin", "source")
    none = spark.createDataFrame([], "class string, pk string, source string, text string, name string, value string")
    s = Session(Tables(sets, members, routes, none, none, {"RIPE": 1}))
    data = lambda line: s.do(line).split("\n", 1)[1].removesuffix("\nC\n")
    assert data("!6AS7") == "2001:db8:20::/44" and data("!gAS8") == "10.1.0.0/16" and s.do("!6AS9") == "D\n"
    assert data("!a6AS-A") == "2001:db8::/32 2001:db8:20::/44 2001:db8:20::/48" and data("!a4AS-A") == "10.1.0.0/16 10.2.0.0/16"
    assert data("!aAS-A") == data("!a4AS-A") + " " + data("!a6AS-A")
    assert data("!r2001:db8:20::/48,o") == "AS8" and data("!r2001:db8:20::/48,l") == "route6: 2001:db8:20::/44\norigin: AS7\nsource: RIPE"
