"""Policies as tables: terms, their prefix spaces, evaluation for sessions, checks of neighbours against each other, and lint.

Parsing is Python in Arrow batches, for each policy once; what follows is joins and sweeps. A filter is a set of alternatives (conjuncts)
over prefix literals. Literals are resolved once for the whole corpus, and a conjunct's space is one sweep that keeps what all of its
positive and none of its negative literals hold.
"""

from __future__ import annotations

import heapq
import ipaddress
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy as lang
from ..functions.prefix import V4_BITS, apply_operator, prefix_text
from ..plans.scratch import written
from . import space
from .expand import closure

CONJUNCT = "struct<positive:array<string>,negative:array<string>,tests:array<string>>"
TERMS = f"asn long, attr string, ord int, term int, peer long, peering string, sets array<string>, actions array<struct<attribute:string,op:string,value:string>>, filter string, conjuncts array<{CONJUNCT}>, rule string, message string"
ARROW_TERMS = pa.schema(
    [("asn", pa.int64()), ("attr", pa.string()), ("ord", pa.int32()), ("term", pa.int32()), ("peer", pa.int64()), ("peering", pa.string()), ("sets", pa.list_(pa.string()))]
    + [("actions", pa.list_(pa.struct([("attribute", pa.string()), ("op", pa.string()), ("value", pa.string())])))]
    + [("filter", pa.string()), ("conjuncts", pa.list_(pa.struct([(n, pa.list_(pa.string())) for n in ("positive", "negative", "tests")]))), ("rule", pa.string()), ("message", pa.string())]
)


def set_names(expression: tuple) -> set[str]:
    if expression[0] == "set":
        return {expression[1]}
    return set().union(*(set_names(x) for x in expression[1:] if isinstance(x, tuple))) if expression[0] in ("and", "or", "except") else set()


def terms_of(asn: int, attr: str, ord_: int, text: str | None, family: str, filter_sets: dict[str, tuple]) -> Iterator[dict]:
    empty = {"asn": asn, "attr": attr, "ord": ord_, "term": 0, "peer": None, "peering": None, "sets": [], "actions": [], "filter": None, "conjuncts": [], "rule": None, "message": None}
    expression, errors = lang.parse(attr, text or "")
    if expression is None:
        yield empty | {"rule": errors[0][0], "message": errors[0][1]}
        return
    for k, t in enumerate(lang.flatten(expression, attr, family)):
        peer = t.peering[0][1] if t.peering[0][0] == "as" else None
        row = empty | {"term": k, "peer": peer, "peering": json.dumps(t.peering), "sets": sorted(set_names(t.peering[0])), "actions": [dict(zip(("attribute", "op", "value"), a, strict=True)) for a in t.actions], "filter": lang.text_of(t.filter)}
        try:
            conjuncts = lang.normalize(lang.inlined(t.filter, filter_sets), peer)
            row["conjuncts"] = [{"positive": sorted(c.positive), "negative": sorted(c.negative), "tests": sorted(("NOT " if no else "") + x for x, no in c.tests)} for c in conjuncts]
        except ValueError as e:
            row |= {"rule": "policy/limit" if isinstance(e, lang.TooLarge) else "policy/filter-set-cycle" if isinstance(e, lang.Cycle) else "policy/peeras", "message": str(e)}
        yield row


MAX_FILTER_SETS = 200_000


def filter_sets_of(rows: DataFrame) -> dict[str, tuple]:
    """Readable filters by name, of filter-sets (set_name, filter); registries hold few of them, and more than MAX_FILTER_SETS are refused."""
    held = rows.select("set_name", "filter").limit(MAX_FILTER_SETS + 1).collect()
    if len(held) > MAX_FILTER_SETS:
        raise ValueError(f"more than {MAX_FILTER_SETS} filter-sets")
    return {r["set_name"].upper(): f for r in held for f, errors in [lang.parse_filter(r["filter"] or "")] if not errors}


def terms(policies: DataFrame, family: str = "ipv4.unicast", filter_sets: dict[str, tuple] | None = None) -> DataFrame:
    """The ordered terms of policies (asn, attr, ord, text) for a family; a policy that can't be read is one row with a rule and a message.

    Filter-sets that are given are put in place of their names; others stay names and hold nothing.
    """
    filter_sets = filter_sets or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([t for r in batch.to_pylist() for t in terms_of(r["asn"], r["attr"], r["ord"], r["text"], family, filter_sets)], ARROW_TERMS)

    return policies.select(F.col("asn").cast("long"), "attr", F.col("ord").cast("int"), "text").mapInArrow(run, TERMS)


def literal_rows(literal: str) -> Iterator[dict]:
    f, errors = lang.parse_filter(literal)
    base = {"literal": literal, "kind": "unknown", "name": None, "asn": None, "op": "", "addr": None, "plen": None}
    if errors or f is None:
        yield base
    elif f[0] == "as":
        yield base | {"kind": "as", "asn": f[1], "op": f[2]}
    elif f[0] == "set":
        yield base | {"kind": "set", "name": f[1], "op": f[2]}
    elif f[0] == "prefixes":
        for text, op in f[1]:
            try:
                net = ipaddress.ip_network(text, strict=False)
            except ValueError:
                continue
            if net.version == 4:
                yield base | {"kind": "prefix", "op": op, "addr": int(net.network_address), "plen": net.prefixlen}


LITERAL = pa.schema([("literal", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("asn", pa.int64()), ("op", pa.string()), ("addr", pa.int64()), ("plen", pa.int32())])


def resolved(literals: DataFrame, set_ranges: DataFrame, routes: DataFrame) -> DataFrame:
    """(space, plen, lo, hi) of each literal, the space being its text.

    set_ranges (top, addr, plen, lo, hi) are expanded sets; a set that isn't there resolves to nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([r for x in batch.column(0).to_pylist() for r in literal_rows(x)], LITERAL)

    rows = written(literals.select("literal").distinct().mapInArrow(run, "literal string, kind string, name string, asn long, op string, addr long, plen int"), "literals")
    columns = ["literal", "op", "addr", "plen", "lo", "hi"]
    listed = rows.where("kind = 'prefix'").withColumns({"lo": F.col("plen"), "hi": F.col("plen")}).select(*columns)
    own = rows.where("kind = 'as'").drop("addr", "plen").join(routes.select("origin", "addr", F.col("plen").cast("int").alias("plen")), F.col("asn") == F.col("origin")).withColumns({"lo": F.col("plen"), "hi": F.col("plen")}).select(*columns)
    held = rows.where("kind = 'set'").drop("addr", "plen").join(set_ranges.select("top", "addr", *[F.col(c).cast("int").alias(c) for c in ("plen", "lo", "hi")]), F.col("name") == F.col("top")).select(*columns)
    low, high = apply_operator(F.col("lo"), F.col("hi"), F.col("op"))
    all_ranges = listed.unionByName(own).unionByName(held).select(F.col("literal").alias("space"), "addr", "plen", low.alias("lo"), high.alias("hi")).where(F.col("lo").isNotNull())
    return written(space.sweep({"a": space.intervals(all_ranges)}, F.col("a") > 0), "resolved")


def literals_of(found: DataFrame) -> DataFrame:
    """(literal): the distinct prefix literals of all terms."""
    return found.select(F.explode("conjuncts").alias("c")).select(F.explode(F.concat("c.positive", "c.negative")).alias("literal")).distinct()


def sets_of(literals: DataFrame) -> DataFrame:
    """(top): the sets that literals name, whatever operators stand behind them."""
    name = F.regexp_replace("literal", r"\^.*$", "")
    return literals.where(~F.col("literal").startswith("{")).select(name.alias("top")).where(F.col("top").rlike(r"(^|:)(AS|RS)-")).distinct()


def conjunct_spaces(conjuncts: DataFrame, literals: DataFrame) -> DataFrame:
    """(space, plen, lo, hi) of conjuncts (space, positive, negative): what all positive and no negative literals hold.

    A conjunct without a positive literal starts from every prefix.
    """
    key = F.concat(F.col("space"), F.lit("|"), F.greatest(F.size("positive"), F.lit(1)).cast("string"))
    named = conjuncts.select(key.alias("__key"), "positive", "negative")
    spaces = literals.withColumnRenamed("space", "literal")
    layer = lambda c: named.select(F.col("__key").alias("space"), F.explode(c).alias("literal")).distinct().join(spaces, "literal").select("space", "plen", "lo", "hi")
    bare = named.where(F.size("positive") == 0).select(F.col("__key").alias("space"), F.explode(F.sequence(F.lit(0), F.lit(V4_BITS))).alias("plen"))
    full = bare.select("space", "plen", F.lit(0).cast("long").alias("lo"), space.power(F.col("plen")).alias("hi"))
    needed = F.substring_index("space", "|", -1).cast("int")
    swept = space.sweep({"yes": layer("positive").unionByName(full), "no": layer("negative")}, (F.col("yes") == needed) & (F.col("no") == 0))
    return swept.withColumn("space", F.expr("substring(space, 1, length(space) - length(substring_index(space, '|', -1)) - 1)"))


def term_spaces(found: DataFrame, literals: DataFrame, tested: bool = False) -> DataFrame:
    """(asn, attr, ord, term, peer, plen, lo, hi): the prefixes of each term's alternatives without tests of paths and communities, or of those with tests."""
    rows = found.where("rule IS NULL").select("asn", "attr", "ord", "term", "peer", F.posexplode("conjuncts").alias("c", "conjunct")).where((F.size("conjunct.tests") > 0) == tested)
    term = F.concat_ws("/", "asn", "attr", "ord", "term")
    spaces = conjunct_spaces(rows.select(F.concat_ws("/", term, F.col("c")).alias("space"), "conjunct.positive", "conjunct.negative"), literals)
    joined = space.sweep({"a": spaces.withColumn("space", F.expr("substring(space, 1, length(space) - length(substring_index(space, '/', -1)) - 1)"))}, F.col("a") > 0)
    keys = rows.select("asn", "attr", "ord", "term", "peer", term.alias("space")).distinct()
    return keys.join(joined, "space").drop("space")


def not_imported(spaces: DataFrame) -> DataFrame:
    """(from_as, to_as, plen, lo, hi): what an AS announces to another that also has a policy for it, and that one doesn't accept."""
    exports = spaces.where("attr IN ('export', 'mp-export')").select(F.concat_ws(">", "asn", "peer").alias("space"), "plen", "lo", "hi")
    imports = spaces.where("attr IN ('import', 'mp-import')").select(F.concat_ws(">", "peer", "asn").alias("space"), "plen", "lo", "hi")
    known = imports.select("space").distinct()
    rest = space.minus(exports.join(known, "space", "left_semi"), imports)
    parts = F.split("space", ">")
    return rest.select(parts[0].cast("long").alias("from_as"), parts[1].cast("long").alias("to_as"), "plen", "lo", "hi")


MAX_RANGES = 64
# The kinds of findings and how grave they are.
SEVERITY = {"not-imported": "warning", "not-exported": "info", "no-import": "warning", "no-export": "info", "no-aut-num": "warning", "undecided": "info"}


def findings(found: DataFrame, literals: DataFrame, aut_nums: DataFrame) -> DataFrame:
    """(from_as, to_as, kind, of_kind, severity, example, ranges, truncated) of all neighbours that policies name.

    What one side announces for certain and the other doesn't accept even with tests is not imported, and the other way round not exported;
    what depends on a test of paths or communities is undecided, with the kind that it might be. A report holds the first MAX_RANGES canonical
    ranges and says if there are more.
    """
    pair = {"export": F.concat_ws(">", "asn", "peer"), "import": F.concat_ws(">", "peer", "asn")}
    both = {tested: written(term_spaces(found, literals, tested), "spaces") for tested in (False, True)}

    def side(kind: str, tested: bool) -> DataFrame:
        return both[tested].where(F.col("attr").isin(kind, f"mp-{kind}") & F.col("peer").isNotNull()).select(pair[kind].alias("space"), "plen", "lo", "hi")

    named = found.where("rule IS NULL AND peer IS NOT NULL AND attr NOT IN ('default', 'mp-default')")
    pairs = {k: written(named.where(F.col("attr").isin(k, f"mp-{k}")).select(pair[k].alias("space")).distinct(), "pairs") for k in pair}
    met = pairs["export"].join(pairs["import"], "space")
    # Each side as certain (s) and depending (m) layers; "0 <" is in, "= 0" is out.
    layers = {f"{k[0]}{t}": side(k, tested).join(met, "space", "left_semi") for k in pair for t, tested in (("s", False), ("m", True))}
    es, em, im, mm = (F.col(c) > 0 for c in ("es", "em", "is", "im"))
    kinds = {
        ("not-imported", ""): es & ~im & ~mm,
        ("not-exported", ""): im & ~es & ~em,
        ("undecided", "not-imported"): (es | em) & ~im & ~(es & ~mm),
        ("undecided", "not-exported"): (im | mm) & ~es & ~(im & ~em),
    }
    number = {f"{kind}/{of}": keep for (kind, of), keep in kinds.items()}
    key = F.concat_ws("|", "space", "kind")
    held = written(space.sweeps(layers, number).select(key.alias("space"), "plen", "lo", "hi"), "findings")
    listed = space.ranges(held).groupBy("space").agg(F.sort_array(F.collect_list(F.struct("addr", "plen", "lo", "hi"))).alias("r"))
    first = space.example(held).select("space", prefix_text(F.col("addr"), F.col("plen")).alias("example"))
    text = F.transform(F.slice("r", 1, MAX_RANGES), lambda r: F.concat(prefix_text(r["addr"], r["plen"]), F.lit("^"), r["lo"].cast("string"), F.lit("-"), r["hi"].cast("string")))
    parts = F.split(F.substring_index("space", "|", -1), "/")
    out = listed.join(first, "space").select(F.substring_index("space", "|", 1).alias("space"), parts[0].alias("kind"), parts[1].alias("of_kind"), "example", text.alias("ranges"), (F.size("r") > MAX_RANGES).alias("truncated"))
    nothing = [F.lit("").alias("of_kind"), F.lit(None).cast("string").alias("example"), F.array().cast("array<string>").alias("ranges"), F.lit(False).alias("truncated")]
    known = aut_nums.select(F.col("asn").cast("long").alias("asn")).distinct()
    ends = lambda c: F.split(c, ">")
    for kind, mine, other, end in (("no-import", "export", "import", 1), ("no-export", "import", "export", 0)):
        # The other side is there but says nothing of this one.
        alone = pairs[mine].join(pairs[other], "space", "left_anti").withColumn("asn", ends("space")[end].cast("long")).join(known, "asn", "left_semi")
        out = out.unionByName(alone.select("space", F.lit(kind).alias("kind"), *nothing))
    unknown = without_aut_num(named, known)
    out = out.unionByName(unknown.select(F.concat_ws(">", "asn", "peer").alias("space"), F.lit("no-aut-num").alias("kind"), *nothing))
    severity = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in SEVERITY.items()])
    return out.select(ends("space")[0].cast("long").alias("from_as"), ends("space")[1].cast("long").alias("to_as"), "kind", "of_kind", severity.alias("severity"), "example", "ranges", "truncated")


def missing_sets(found: DataFrame, sets: DataFrame) -> DataFrame:
    """(asn, missing): sets that filters or peerings name and no registry has."""
    literals = found.where("rule IS NULL").select("asn", F.explode(F.flatten(F.concat(F.transform("conjuncts", lambda c: F.concat(c["positive"], c["negative"])), F.array("sets")))).alias("name"))
    named = literals.select("asn", F.regexp_replace("name", r"\^.*$", "").alias("missing")).where(F.col("missing").rlike("^[^{<]*(AS|RS|FLTR|PRNG|RTRS)-"))
    return named.join(sets.select(F.upper("set_name").alias("missing")), "missing", "left_anti").select("asn", "missing").distinct()


def shadowed(found: DataFrame, spaces: DataFrame) -> DataFrame:
    """(asn, attr, ord, term, peer) of terms that earlier terms for the same peer cover wholly; empty terms aren't told here.

    Of the terms of one AS for one peer, those that are the first to hold some prefix are found by one pass over the ends of their
    intervals of each length, with the terms that hold the place in a heap; the others are shadowed. One AS's policy for one peer and
    length is the largest group.
    """
    keys = ["asn", "attr", "peer"]
    held = spaces.where("peer IS NOT NULL").select(*keys, "ord", "term", "plen", "lo", "hi")

    def visible(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lo")
        place = list(zip(rows["ord"].tolist(), rows["term"].tolist(), strict=True))
        lo, hi = rows["lo"].tolist(), rows["hi"].tolist()
        heap, seen, k = [], set(), 0
        for at in sorted({*lo, *hi}):
            while k < len(lo) and lo[k] <= at:
                heapq.heappush(heap, (place[k], hi[k]))
                k += 1
            while heap and heap[0][1] <= at:
                heapq.heappop(heap)
            if heap:
                seen.add(heap[0][0])
        first = rows.iloc[0]
        return pd.DataFrame([(first["asn"], first["attr"], first["peer"], o, t) for o, t in sorted(seen)], columns=[*keys, "ord", "term"])

    told = held.groupBy(*keys, "plen").applyInPandas(visible, "asn long, attr string, peer long, ord int, term int").distinct()
    terms = held.select(*keys, "ord", "term").distinct()
    return terms.join(told, [*keys, "ord", "term"], "left_anti").select("asn", "attr", "ord", "term", "peer")


def empty(found: DataFrame, spaces: DataFrame) -> DataFrame:
    """Terms without tests whose filter holds no prefix."""
    keys = ["asn", "attr", "ord", "term"]
    testless = found.where("rule IS NULL").where(F.forall("conjuncts", lambda c: F.size(c["tests"]) == 0))
    return testless.select(*keys, "peer").join(spaces.select(*keys).distinct(), keys, "left_anti")


def without_aut_num(found: DataFrame, aut_nums: DataFrame) -> DataFrame:
    """(asn, peer): peers that a policy names and no registry has."""
    named = found.where("peer IS NOT NULL").select("asn", "peer").distinct()
    return named.join(aut_nums.select(F.col("asn").alias("peer")).distinct(), "peer", "left_anti").select("asn", "peer")


# Why a term can't be told.
WHY_PEER_ROUTER, WHY_LOCAL_ROUTER, WHY_REGEXP, WHY_SET = "peer router not given", "local router not given", "peering regexp", "unknown set"


def why_routers(peer_router: Column, local_router: Column) -> Column:
    return F.when(peer_router.isNotNull(), WHY_PEER_ROUTER).when(local_router.isNotNull(), WHY_LOCAL_ROUTER)


def undecided(told: DataFrame) -> DataFrame:
    """(asn, attr, ord, term, why, peers): the terms that can't be told for some sessions, merged over these; told is what `evaluate` gives."""
    some = told.where("verdict = 'undecided'").groupBy(F.col("local").alias("asn"), "attr", "ord", "term", "why")
    return some.agg(F.sort_array(F.collect_set("peer")).alias("peers"))


def limits(found: DataFrame) -> DataFrame:
    """(asn, attr, ord, term, rule, message): policies whose normal form hits a limit or a cycle of filter-sets."""
    return found.where(F.col("rule").isin("policy/limit", "policy/filter-set-cycle", "policy/peeras")).select("asn", "attr", "ord", "term", "rule", "message")


def any_sets(found: DataFrame, members: DataFrame) -> DataFrame:
    """(asn, attr, ord, term, name): sets that a path expression names and that reach AS-ANY, so that it takes any AS; members has (set_name, child)."""
    tests = found.where("rule IS NULL").select("asn", "attr", "ord", "term", F.explode(F.flatten(F.transform("conjuncts", lambda c: c["tests"]))).alias("test")).where(F.col("test").contains("<"))
    named = tests.select("asn", "attr", "ord", "term", F.explode(F.regexp_extract_all("test", F.lit(r"\b((?:AS\d+:)*AS-[A-Za-z0-9_:-]+)"), 1)).alias("name")).withColumn("name", F.upper("name")).distinct()
    nested = members.where("child IS NOT NULL").select(F.upper("set_name").alias("parent"), F.upper("child").alias("child")).distinct()
    tops = named.select(F.col("name").alias("top"), F.col("name").alias("node")).distinct()
    reaching = closure(tops, nested, ["node"]).where("node = 'AS-ANY'").select(F.col("top").alias("name")).distinct()
    return named.join(reaching, "name", "left_semi").select("asn", "attr", "ord", "term", "name")


def evaluate(sessions: DataFrame, found: DataFrame, membership: DataFrame, sets: DataFrame) -> DataFrame:
    """(local, peer, attr, ord, term, verdict, why, actions, filter): terms of a session's policy in order, those that match and those that can't be told, with the reason.

    sessions has (local, peer); membership (top, asn) the expanded as-sets and sets (top) those that exist at all. Only the peer's own
    membership in the sets that a peering names goes along with a term.
    """
    joined = sessions.join(found.where("rule IS NULL").withColumnRenamed("peer", "named"), F.col("local") == F.col("asn"))
    routers = F.from_json("peering", "array<string>")
    asks = why_routers(routers[1], routers[2])
    plain = joined.where("named IS NOT NULL").where(F.col("named") == F.col("peer")).withColumn("verdict", F.when(asks.isNull(), "match").otherwise("undecided")).withColumn("why", asks)
    mixed = joined.where("named IS NULL")
    asked = mixed.select("peer", F.explode("sets").alias("top")).distinct()
    known = asked.join(sets.select("top").distinct(), "top").join(membership.select("top", F.col("asn").alias("peer"), F.lit(True).alias("in")), ["top", "peer"], "left")
    told = known.groupBy("peer").agg(F.collect_set("top").alias("known"), F.collect_set(F.when(F.col("in"), F.col("top"))).alias("inside"))

    @F.udf("string", useArrow=True)
    def verdict(peering, peer, known, inside):
        expression, peer_router, local_router = json.loads(peering)
        as_tuple = lambda x: tuple(as_tuple(y) if isinstance(y, list) else y for y in x)
        answer = lang.matches_peer(as_tuple(expression), peer, {n: {peer} if n in set(inside or ()) else set() for n in (known or ())})
        return "undecided" if answer is None or answer and (peer_router or local_router) else "match" if answer else "no"

    rest = mixed.join(told, "peer", "left").withColumn("verdict", verdict("peering", "peer", "known", "inside")).where("verdict <> 'no'")
    reason = F.coalesce(F.when(F.col("peering").contains('["regexp"'), WHY_REGEXP), asks, F.lit(WHY_SET))
    rest = rest.withColumn("why", F.when(F.col("verdict") == "undecided", reason))
    columns = ["local", "peer", "attr", "ord", "term", "verdict", "why", "actions", "filter"]
    return plain.select(*columns).unionByName(rest.select(*columns))
