"""The policy language: parsing, printing, flattening and normal forms, against a plain model of routes."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.functions import policy as p
from routeloom.operators import policy as tables

LEAVES = st.sampled_from([("any",), ("as", 1, ""), ("as", 2, "^+"), ("set", "AS-FOO", ""), ("set", "RS-BAR", "^24-26"), ("prefixes", (("10.0.0.0/8", ""), ("10.1.0.0/16", "^+"))), ("path", "^AS1 .*$"), ("community", "contains", ("1:2", "3:4")), ("community", "equals", ("5:6",)), ("peeras", "")])
FILTERS = st.recursive(LEAVES, lambda x: st.one_of(x.filter(lambda f: f[0] != "not").map(lambda f: ("not", f)), st.tuples(st.sampled_from(["and", "or"]), st.lists(x, min_size=2, max_size=3).map(tuple))), max_leaves=7)


def flat(f):
    """AND in AND and OR in OR are one."""
    if f[0] == "not":
        return ("not", flat(f[1]))
    if f[0] not in ("and", "or"):
        return f
    return (f[0], tuple(y for x in map(flat, f[1]) for y in (x[1] if x[0] == f[0] else (x,))))


@given(FILTERS)
@settings(max_examples=300, deadline=None)
def test_text_parses_again(f):
    got, errors = p.parse_filter(p.text_of(f))
    assert not errors and flat(got) == flat(f)


def holds(f, world):
    kind = f[0]
    if kind == "any":
        return True
    if kind == "not":
        return not holds(f[1], world)
    if kind in ("and", "or"):
        return (all if kind == "and" else any)(holds(x, world) for x in f[1])
    return world[p.text_of(("as", 7, f[1]) if kind == "peeras" else f)]


@given(FILTERS, st.integers(0, 2**32))
@settings(max_examples=300, deadline=None)
def test_normal_form_means_the_same(f, seed):
    rng = random.Random(seed)
    names = {p.text_of(("as", 7, "")), *(p.text_of(x) for x in [("as", 1, ""), ("as", 2, "^+"), ("set", "AS-FOO", ""), ("set", "RS-BAR", "^24-26"), ("prefixes", (("10.0.0.0/8", ""), ("10.1.0.0/16", "^+"))), ("path", "^AS1 .*$"), ("community", "contains", ("1:2", "3:4")), ("community", "equals", ("5:6",))])}
    conjuncts = p.normalize(f, peer=7)
    for _ in range(20):
        world = {n: rng.random() < 0.5 for n in names}
        got = any(all(world[x] for x in c.positive) and not any(world[x] for x in c.negative) and all(world[t] != no for t, no in c.tests) for c in conjuncts)
        assert got == holds(f, world)


def test_import_with_actions():
    e, errors = p.parse("import", "from AS2 1.2.3.4 at 5.6.7.8 action pref=10; community.append(1:2, 3:4); from AS-X EXCEPT AS3 accept { 10.0.0.0/8^16-24 } OR <^AS2> AND NOT AS9")
    assert not errors
    a, b = e[2]
    assert a.peering == (("as", 2), "1.2.3.4", "5.6.7.8") and a.actions == (("pref", "=", "10"), ("community", "append", "1:2 3:4"))
    assert b.peering[0] == ("except", ("set", "AS-X"), ("as", 3)) and b.actions == ()
    assert p.text_of(a.filter) == "{10.0.0.0/8^16-24} OR <^AS2> AND NOT AS9" and a.filter == b.filter


def test_families():
    e, _ = p.parse("mp-import", "afi ipv6.unicast, ipv4 from AS1 accept ANY")
    assert [bool(p.flatten(e, "mp-import", f)) for f in ("ipv4.unicast", "ipv6.unicast", "ipv6.multicast", "ipv4.multicast")] == [True, True, False, True]
    assert p.applies((), "import", "ipv4.unicast") and not p.applies((), "import", "ipv6.unicast") and p.applies((), "mp-export", "ipv6.unicast")


def first_fit(terms, peer, world):
    for t in terms:
        if p.matches_peer(t.peering[0], peer, {}) and holds(t.filter, world):
            return t.actions
    return None


def test_except_and_refine_by_first_fit():
    e, errors = p.parse("import", "from AS1 action pref=1; accept AS1 EXCEPT { from AS1 action pref=2; accept AS2; from AS3 accept ANY; }")
    assert not errors
    terms = p.flatten(e, "import", "ipv4.unicast")
    for a in (False, True):
        for b in (False, True):
            got = first_fit(terms, 1, {"AS1": a, "AS2": b})
            assert got == (None if not a else (("pref", "=", "2"),) if b else (("pref", "=", "1"),))
    e, _ = p.parse("import", "{ from AS-ANY action pref=1; accept AS1; } REFINE { from AS5 action med=0; accept AS2; }")
    (t,) = p.flatten(e, "import", "ipv4.unicast")
    assert t.peering[0] == ("as", 5) and t.actions == (("pref", "=", "1"), ("med", "=", "0")) and t.filter == ("and", (("as", 1, ""), ("as", 2, "")))


@pytest.mark.parametrize("text", ["", "from", "from AS1", "from AS1 accept", "from AS1 accept ((ANY)", "from AS1 action pref=1 accept ANY", "from AS1 accept {10.0.0.0/8,", "from FOO accept ANY", "from AS1 accept ANY }", "from AS99999999999 accept ANY"])
def test_errors_are_told(text):
    e, errors = p.parse("import", text)
    assert e is None and errors[0][0] == "policy/syntax"


def test_limits():
    assert p.parse_filter("(" * 1500 + "ANY" + ")" * 1500)[1]
    big = ("and", tuple(("or", tuple(("as", 10 * k + j, "") for j in range(4))) for k in range(8)))
    with pytest.raises(p.TooLarge):
        p.normalize(big)


def test_three_values():
    sets = {"AS-X": {1, 2}}
    parse = lambda t: p.Parser(t).as_expression()
    assert p.matches_peer(parse("AS-X EXCEPT AS2"), 1, sets) is True
    assert p.matches_peer(parse("AS-X AND AS2"), 1, sets) is False
    assert p.matches_peer(parse("AS-Y OR AS1"), 1, sets) is True
    assert p.matches_peer(parse("AS-Y AND AS1"), 1, sets) is None
    assert p.matches_peer(parse("AS-Y AND AS2"), 1, sets) is False


def test_paths():
    assert p.match_path("^AS1 AS2* AS3$", [1, 2, 2, 3]) and not p.match_path("^AS1 AS2* AS3$", [1, 4, 3])
    assert p.match_path("AS2", [1, 2, 3]) and not p.match_path("AS2", [12, 22])
    assert p.match_path("^[AS1-AS3 AS9]{2} .$", [3, 9, 70]) and not p.match_path("^[^AS1]$", [1]) and p.match_path("^[^AS1]$", [2])
    assert p.match_path("^(AS1|AS-X)+ PeerAS$", [1, 5, 7], peer=7, sets={"AS-X": {5}})
    assert p.match_path(". .", [1, 2]) and not p.match_path("^.$", [])
    for bad in ("[AS1", "AS1 %", "(AS1", "AS-Y", "PeerAS"):
        with pytest.raises(p.Unreadable):
            p.path_expression(bad)


def test_filter_sets_in_place_and_cycles():
    sets = {"FLTR-A": p.parse_filter("AS1 AND NOT FLTR-B")[0], "FLTR-B": p.parse_filter("{10.0.0.0/8^+}")[0], "FLTR-C": p.parse_filter("AS2 OR FLTR-D")[0], "FLTR-D": p.parse_filter("FLTR-C")[0]}
    assert p.text_of(p.inlined(p.parse_filter("FLTR-A OR FLTR-X")[0], sets)) == "AS1 AND NOT {10.0.0.0/8^+} OR FLTR-X"
    with pytest.raises(p.Cycle):
        p.inlined(("set", "FLTR-C", ""), sets)


def test_findings(spark):
    """Certain and undecided differences, one-sided policies and unknown neighbours."""
    from routeloom.operators import policy as op

    rows = [
        (1, "export", 0, "to AS2 announce {10.0.0.0/8^8-9}"),
        (2, "import", 0, "from AS1 accept {10.0.0.0/8} OR ({10.0.0.0/9} AND <^AS1>)"),
        (2, "export", 1, "to AS1 announce FLTR-ALL"),
        (1, "export", 2, "to AS3 announce ANY"),
        (3, "import", 0, "from AS2 accept ANY"),
        (3, "import", 1, "from AS9 accept RS-GONE"),
        (3, "export", 2, "to AS2 announce FLTR-LOOP"),
    ]
    sets = {"FLTR-ALL": ("any",), "FLTR-LOOP": ("not", ("set", "FLTR-LOOP", ""))}
    found = op.terms(spark.createDataFrame(rows, "asn long, attr string, ord int, text string"), filter_sets=sets).cache()
    assert [r["rule"] for r in found.where("rule IS NOT NULL").collect()] == ["policy/filter-set-cycle"]
    literals = op.resolved(found.select(p_explode("conjuncts")).select(p_literals()), spark.createDataFrame([], "top string, addr long, plen int, lo int, hi int"), spark.createDataFrame([], "origin long, addr long, plen int"))
    got = {(r["from_as"], r["to_as"], r["kind"], r["of_kind"]): (r["severity"], r["ranges"]) for r in op.findings(found, literals, spark.createDataFrame([(1,), (2,), (3,)], "asn long")).collect()}
    assert got == {
        (1, 2, "not-imported", ""): ("warning", ["10.128.0.0/9^9-9"]),
        (1, 2, "undecided", "not-imported"): ("info", ["10.0.0.0/9^9-9"]),
        (2, 1, "no-import", ""): ("warning", []),
        (1, 3, "no-import", ""): ("warning", []),
        (2, 3, "no-export", ""): ("info", []),
        (3, 9, "no-aut-num", ""): ("warning", []),
    }
    assert {tuple(r) for r in op.missing_sets(found, spark.createDataFrame([("RS-X",)], "set_name string")).collect()} == {(3, "RS-GONE")}


def p_explode(column):
    from pyspark.sql import functions as F

    return F.explode(column).alias("c")


def p_literals():
    from pyspark.sql import functions as F

    return F.explode(F.concat("c.positive", "c.negative")).alias("literal")


@pytest.mark.parametrize(
    ("text", "told"),
    [
        ("{10.0.0.0/8^+}^24", "{10.0.0.0/8^24}"),
        ("{10.0.0.0/8^20-24}^22-30", "{10.0.0.0/8^22-30}"),
        ("{10.0.0.0/8^-}^-", "{10.0.0.0/8^10-32}"),
        ("{10.0.0.0/8^+, 192.0.2.0/24}^+", "{10.0.0.0/8^+, 192.0.2.0/24^+}"),
        ("{192.0.2.0/30^+, 192.0.2.0/32^+}^16-20", "{}"),
        ("{2001:db8::/32^+}^48", "{2001:db8::/32^48}"),
    ],
)
def test_operators_behind_lists(text, told):
    f, errors = p.parse_filter(text)
    assert not errors and p.text_of(f) == told
    again, errors = p.parse_filter(told)
    assert not errors and again == f


def test_deep_nesting():
    deep = lambda n: "(" * n + "AS1" + ")" * n
    assert p.parse_filter(deep(990)) == (("as", 1, ""), [])
    assert p.parse_filter(deep(1001))[1][0][0] == "policy/filter"
    nots = "NOT (AS1 OR " * 900 + "AS2" + ")" * 900
    f, errors = p.parse_filter(nots)
    assert not errors and p.parse_filter(p.text_of(f))[0] == f


def test_shadowed_terms_equal_plain_covering(spark):
    """Terms of two peers with prefix lists; a term is shadowed if the earlier ones hold all of its prefixes."""
    rng = random.Random(4)
    rows, want = [], set()
    for asn in range(6):
        held = {}
        for k in range(12):
            peer, own = rng.randrange(2), set()
            for _ in range(rng.randrange(1, 4)):
                n = rng.randrange(1, 6)
                lo = rng.randrange(1 << n)
                hi = rng.randrange(lo + 1, min(1 << n, lo + 4) + 1)
                rows.append((asn, "import", k, 0, peer, n, lo, hi))
                own |= {(n, i) for i in range(lo, hi)}
            if own <= held.get(peer, set()):
                want.add((asn, k))
            held.setdefault(peer, set()).update(own)
    spaces = spark.createDataFrame(rows, "asn long, attr string, ord int, term int, peer long, plen int, lo long, hi long")
    assert {(r["asn"], r["ord"]) for r in tables.shadowed(None, spaces).collect()} == want and len(want) > 3
