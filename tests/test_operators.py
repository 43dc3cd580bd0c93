"""Generators, spaces, operator stacks, closures and validation on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from routeloom.functions import prefix as px
from routeloom.operators import cover, expand, generate, registry, space
from routeloom.plans.scratch import written

ENTRIES = "name string, addr long, plen int, lo int, hi int"
TEN = 10 << 24


def test_prefix_lists(spark):
    rows = spark.createDataFrame([("X", TEN, 8, 8, 8), ("X", TEN + (1 << 16), 16, 20, 24), ("X", TEN + (2 << 16), 16, 16, 24)], ENTRIES)
    names = spark.createDataFrame([("X",), ("E",)], "name string")
    text = lambda v: {r["name"]: r["text"] for r in generate.prefix_lists(rows, v, names).collect()}
    ios = text("ios")
    assert ios["X"] == "no ip prefix-list X\nip prefix-list X permit 10.0.0.0/8\nip prefix-list X permit 10.1.0.0/16 ge 20 le 24\nip prefix-list X permit 10.2.0.0/16 le 24\n"
    assert ios["E"] == "no ip prefix-list E\n! generated prefix-list E is empty\nip prefix-list E deny 0.0.0.0/0\n"
    assert text("bird")["X"] == "X = [\n    10.0.0.0/8,\n    10.1.0.0/16{20,24},\n    10.2.0.0/16{16,24}\n];\n"
    assert "seq 2 permit 10.1.0.0/16 ge 20 le 24" in text("arista")["X"]
    for vendor in generate.PREFIX_LISTS:
        if vendor == "junos":
            with pytest.raises(ValueError):
                text(vendor)
        else:
            assert "10.2.0.0" in text(vendor)["X"] and "{" + "p}" not in text(vendor)["X"]
    with pytest.raises(ValueError):
        text("nothing")
    got = generate.user_format(rows.where("plen = 8"), "%N %n/%l %a-%A %m %i %%\\n").first()["text"]
    assert got == "X 10.0.0.0/8 8-8 255.0.0.0 0.255.255.255 %\n"


def test_as_paths(spark):
    asns = spark.createDataFrame([("L", n) for n in (65000, 1, 2, 3, 4, 5)], "name string, asn long")
    near = spark.createDataFrame([("L", 65000), ("M", 7)], "name string, me long")
    got = {r["name"]: r["text"] for r in generate.as_paths(asns, near, "ios").collect()}
    assert got["L"] == "no ip as-path access-list L\nip as-path access-list L permit ^65000(_65000)*$\nip as-path access-list L permit ^65000(_[0-9]+)*_(1|2|3|4)$\nip as-path access-list L permit ^65000(_[0-9]+)*_(5)$\n"
    assert got["M"] == "no ip as-path access-list M\nip as-path access-list M deny .*\n"


def test_aggregate_and_refine(spark):
    rows = spark.createDataFrame([("X", TEN, 24, 24, 24), ("X", TEN + 256, 24, 24, 24), ("X", TEN, 23, 23, 23), ("X", TEN + 512, 24, 24, 24)], ENTRIES)
    assert {tuple(r) for r in generate.aggregate(rows).collect()} == {("X", TEN, 23, 23, 24), ("X", TEN + 512, 24, 24, 24)}
    assert {tuple(r)[2:] for r in generate.refine(rows, most=26, least=25, max_length=23).collect()} == {(23, 25, 26)}


def listed(ranges):
    return {(n, (a >> (32 - n)) + i) for a, p, lo, hi in ranges for n in range(lo, hi + 1) for i in range(1 << (n - p))}


def test_spaces_equal_sets(spark):
    rng = random.Random(1)
    sides = {}
    for side in "ab":
        rows = []
        for s in range(6):
            for _ in range(rng.randrange(1, 6)):
                p = rng.randrange(0, 6)
                lo = rng.randrange(p, 7)
                rows.append((f"s{s}", rng.randrange(1 << p) << (32 - p), p, lo, rng.randrange(lo, 7)))
        sides[side] = rows
    frame = lambda rows: space.intervals(spark.createDataFrame(rows, ENTRIES.replace("name", "space")))
    a, b = frame(sides["a"]), frame(sides["b"])
    for op, fold in ((space.union, set.union), (space.minus, set.difference), (space.intersection, set.intersection)):
        done = op(a, b).cache()
        canonical = space.ranges(done).collect()
        for s in {r[0] for side in sides.values() for r in side}:
            of = {k: listed([r[1:] for r in rows if r[0] == s]) for k, rows in sides.items()}
            want = fold(of["a"], of["b"])
            assert {(r["plen"], i) for r in done.where(F.col("space") == s).collect() for i in range(r["lo"], r["hi"])} == want
            held = [(r["addr"], r["plen"], r["lo"], r["hi"]) for r in canonical if r["space"] == s]
            assert listed(held) == want and sum(len(listed([h])) for h in held) == len(want)


def test_everything_but_one_prefix(spark):
    """All of IPv4 without 10.1.0.0/16 is eighteen ranges."""
    one = lambda *r: space.intervals(spark.createDataFrame([("x", *r)], ENTRIES.replace("name", "space")))
    got = space.ranges(space.minus(one(0, 0, 0, 32), one(TEN + (1 << 16), 16, 16, 16))).orderBy("addr", "plen", "lo").collect()
    told = [(px_text(r["addr"], r["plen"]), r["lo"], r["hi"]) for r in got]
    assert len(told) == 18 and told[:3] == [("0.0.0.0/0", 0, 15), ("0.0.0.0/0", 17, 32), ("0.0.0.0/5", 16, 16)]


def px_text(a, n):
    return ".".join(str(a >> k & 255) for k in (24, 16, 8, 0)) + f"/{n}"


def one_operator(op, lo, hi):
    n, m = {"^+": (0, 32), "^-": (0, 32)}.get(op) or tuple(map(int, (op[1:].split("-") * 2)[:2]))
    low = max(n, lo + (op == "^-"))
    return (low, m) if low <= m else None


def test_operator_stacks_equal_one_by_one(spark):
    rng = random.Random(2)
    ops = ["^+", "^-", "^24", "^26", "^25-27", "^20-30"]
    rows = []
    for _ in range(400):
        path = [rng.choice([*ops, ""]) for _ in range(rng.randrange(0, 5))]  # outermost first
        lo = rng.randrange(20, 33)
        hi = rng.randrange(lo, 33)
        window = (lo, hi)
        for op in reversed(path):
            window = window if not op or window is None else one_operator(op, *window)
        rows.append((path, lo, hi, *(window or (None, None))))
    df = spark.createDataFrame(rows, "path array<string>, lo int, hi int, want_lo int, want_hi int")
    stack = {x: F.lit(None if x == "h" else 0).cast("int") for x in "ackh"}
    for k in range(4):
        stack = px.push_operator(stack, F.coalesce(F.try_element_at("path", F.lit(k + 1)), F.lit("")))
        df = written(df.withColumns({f"{x}{k}": v for x, v in stack.items()}), "stacks")
        stack = {x: F.col(f"{x}{k}") for x in "ackh"}
    low, high = px.apply_stack(F.col("lo"), F.col("hi"), stack)
    assert df.where(~low.eqNullSafe(F.col("want_lo")) | ~high.eqNullSafe(F.col("want_hi"))).count() == 0


def test_cycle_of_lengthening_operators_ends(spark):
    rows = [("RS-A", "RS-B", None, None, "^-"), ("RS-B", "RS-A", None, None, ""), ("RS-A", None, TEN, 28, "")]
    members = spark.createDataFrame(rows, "set_name string, child string, addr long, plen int, op string")
    got = expand.expand_ranges(spark.createDataFrame([("RS-A",)], "top string"), members)
    assert {(r["lo"], r["hi"]) for r in got.collect()} == {(28, 28), *((n, 32) for n in range(29, 33))}


def test_sets_of_a_small_registry(spark):
    """A cycle of three, claims with and without a right to it, two registries with one name, reserved and missing names."""
    named = [("AS-OAK", "WOOD", ""), ("AS-ELM", "WOOD", ""), ("AS-ASH", "WOOD", ""), ("AS-GUILD", "WOOD", "SAW-MNT,axe-mnt"), ("AS-OPEN", "WOOD", "ANY"), ("AS-TWIN", "WOOD", ""), ("AS-TWIN", "IRON", ""), ("AS-HOLE", "IRON", "")]
    sets = spark.createDataFrame(named, "set_name string, source string, mbrs_by_ref string")
    listed = {"AS-OAK": [11, "AS-ELM"], "AS-ELM": [12, 13, "AS-ASH"], "AS-ASH": ["AS-OAK", 14], "AS-GUILD": [20], "AS-OPEN": [], "AS-HOLE": [30, "AS-VOID", "AS-ANY", "RS-OTHER"]}
    rows = [(s, "IRON" if s == "AS-HOLE" else "WOOD", m if isinstance(m, int) else None, m if isinstance(m, str) else None) for s, ms in listed.items() for m in ms] + [("AS-TWIN", "IRON", 41, None), ("AS-TWIN", "WOOD", 42, None)]
    members = spark.createDataFrame(rows, "set_name string, source string, asn long, child string")
    claims = spark.createDataFrame([(21, "AS-GUILD", "AXE-mnt", "wood"), (22, "AS-GUILD", "NAIL-MNT", "WOOD"), (23, "AS-GUILD", "SAW-MNT", "IRON"), (51, "AS-OPEN", "NAIL-MNT", "WOOD")], "asn long, member_of string, mnt string, source string")
    tops = sets.select(F.col("set_name").alias("top")).distinct()
    order = ("IRON", "WOOD")
    own = expand.chosen_members(sets, members, order)
    nodes = expand.expand_sets(tops, sets, members, order)
    got = {}
    for r in expand.expand_as(nodes, own, expand.allowed_claims(sets, claims)).collect():
        got.setdefault(r["top"], set()).add(r["asn"])
    ring = {11, 12, 13, 14}
    assert got == {"AS-OAK": ring, "AS-ELM": ring, "AS-ASH": ring, "AS-GUILD": {20, 21}, "AS-OPEN": {51}, "AS-TWIN": {41}, "AS-HOLE": {30}}
    assert {r["missing"] for r in expand.missing(nodes, own, sets).collect()} >= {"AS-VOID"}
    with pytest.raises(expand.SetTooLarge):
        expand.expand_sets(tops, sets, members, order, max_depth=0)


def test_aggregate_equals_plain_joining(spark):
    rng = random.Random(5)
    rows = [(f"L{k % 3}", (TEN + (rng.randrange(64) << 8)) >> (32 - n) << (32 - n), n) for k in range(120) for n in [rng.randrange(20, 27)]]
    got = {}
    for r in registry.aggregate(spark.createDataFrame(rows, "name string, addr long, plen int")).collect():
        got.setdefault(r["name"], set()).add((r["addr"], r["plen"]))
    for name in got:
        held = {(a, n) for x, a, n in rows if x == name}
        while True:
            held = {(a, n) for a, n in held if not any(m < n and b <= a < b + (1 << 32 - m) for b, m in held)}
            pair = next(((a, n) for a, n in sorted(held) if a % (1 << 33 - n) == 0 and (a + (1 << 32 - n), n) in held), None)
            if pair is None:
                break
            held = held - {pair, (pair[0] + (1 << 32 - pair[1]), pair[1])} | {(pair[0], pair[1] - 1)}
        assert got[name] == held


def test_inside_one_space(spark):
    rng = random.Random(6)
    make = lambda s, n: [(s, rng.randrange(1 << p) << (32 - p), p, p, min(p + 2, 8)) for _ in range(n) for p in [rng.randrange(1, 7)]]
    whole = make("w", 8)
    rows = [r for k in range(12) for r in make(f"s{k}", 1 + k % 3)] + [("part", *whole[0][1:]), ("part", *whole[3][1:])] + whole
    held = space.sweep({"a": space.intervals(spark.createDataFrame(rows, ENTRIES.replace("name", "space")))}, F.col("a") > 0)
    written_whole = held.where("space = 'w'").drop("space")
    got = {r["space"]: r["inside"] for r in space.inside(held, written_whole).collect()}
    want = {s: listed([r[1:] for r in rows if r[0] == s]) <= listed([r[1:] for r in whole]) for s in {r[0] for r in rows}}
    assert got == want and want["part"] and want["w"] and not all(want.values())


def test_origin_validation(spark):
    key = lambda a, n: f"{a:032b}"[:n]
    routes = spark.createDataFrame([(key(TEN, n), n, o) for n, o in ((8, 1), (16, 1), (16, 2), (24, 1), (24, 0))] + [(key(TEN << 1, 8), 8, 1)], "key string, plen int, origin long")
    vrps = spark.createDataFrame([(key(TEN, 8), 8, 16, 1), (key(TEN, 16), 16, 24, 0)], "key string, plen int, max_length int, asn long")
    got = {(r["plen"], r["origin"], r["key"][:5]): r["state"] for r in cover.validate(routes, vrps, ["key", "plen", "origin"]).collect()}
    assert list(got.values()).count("not_found") == 1
    assert [got[n, o, key(TEN, 5)] for n, o in ((8, 1), (16, 1), (16, 2), (24, 1), (24, 0))] == ["valid", "valid", "invalid", "invalid", "invalid"]


def test_addresses(spark):
    rows = spark.createDataFrame([("10.0.0.1",), ("064.006.160.000",), ("1.2.3",), ("256.1.1.1",), ("x",), (None,)], "t string")
    assert [r[0] for r in rows.select(px.address(F.col("t"))).collect()] == [TEN + 1, (64 << 24) + (6 << 16) + (160 << 8), None, None, None, None]


def test_lists_over_cells(spark):
    asns = sorted(random.Random(3).sample(range(1, 400_000), 100))
    got = registry.as_list_lines(spark.createDataFrame([(a,) for a in asns], "asn long"), "x", 7).orderBy("line_no").collect()
    assert [r["line"] for r in got] == ["x: " + " ".join(map(str, asns[k : k + 7])) for k in range(0, 100, 7)]
