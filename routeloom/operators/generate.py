"""Filter lists for routers: prefix lists, route filters and AS-path lists, as text for each list.

Lists are rows (name, addr, plen, lo, hi): a prefix with the lengths that it lets through. Aggregation is exact: the canonical ranges of
the prefix space that the entries hold, so a pair of siblings is one entry of their parent that lets their length through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import V4_BITS, dotted, materialized, prefix_text, range_size
from . import space


@dataclass(frozen=True)
class Format:
    """Texts with {name}, {p} (prefix), {a} (address), {n} (length), {lo}, {hi} and {seq}; `between` stands between entries."""

    head: str
    exact: str
    ranged: str
    upto: str
    tail: str = ""
    between: str = ""
    empty: str = ""
    #: A list without entries is `empty` alone, without head and tail.
    empty_alone: bool = False
    step: int = 5


# What the routers' languages ask for.
PREFIX_LISTS = {
    "ios": Format("no ip prefix-list {name}\n", "ip prefix-list {name} permit {p}\n", "ip prefix-list {name} permit {p} ge {lo} le {hi}\n", "ip prefix-list {name} permit {p} le {hi}\n", empty="! generated prefix-list {name} is empty\nip prefix-list {name} deny 0.0.0.0/0\n"),
    "iosxr": Format("no prefix-set {name}\nprefix-set {name}\n", " {p}", " {p} ge {lo} le {hi}", " {p} le {hi}", "\nend-set\n", ",\n"),
    "json": Format('{ "{name}": [', '\n    { "prefix": "{p}", "exact": true }', '\n    { "prefix": "{p}", "exact": false,\n      "greater-equal": {lo}, "less-equal": {hi} }', '\n    { "prefix": "{p}", "exact": false, "less-equal": {hi} }', "\n] }\n", ","),
    "bird": Format("{name} = [", "\n    {p}", "\n    {p}{{lo},{hi}}", "\n    {p}{{n},{hi}}", "\n];\n", ","),
    "junos": Format("policy-options {\nreplace:\n prefix-list {name} {\n", "    {p};\n", "", "", " }\n}\n"),
    "junos-route-filter": Format("policy-options {\n policy-statement {name} { \nreplace:\n  from {\n", "    route-filter {p} exact;\n", "    route-filter {p} prefix-length-range /{lo}-/{hi};\n", "    route-filter {p} upto /{hi};\n", "  }\n }\n}\n", empty="    route-filter 0.0.0.0/0 orlonger reject;\n"),
    "junos-route-filter-list": Format("policy-options {\nreplace:\n  route-filter-list {name} {\n", "    {p} exact;\n", "    {p} prefix-length-range /{lo}-/{hi};\n", "    {p} upto /{hi};\n", "  }\n}\n", empty="    0.0.0.0/0 orlonger reject;\n"),
    "openbgpd": Format('{name}="prefix { ', "\n\t{p}", "\n\t{p} prefixlen {lo} - {hi}", "\n\t{p} prefixlen {n} - {hi}", '\n\t}"\n'),
    "arista": Format("no ip prefix-list {name}\nip prefix-list {name}\n", "   seq {seq} permit {p}\n", "   seq {seq} permit {p} ge {lo} le {hi}\n", "   seq {seq} permit {p} le {hi}\n", empty="no ip prefix-list {name}\n! generated prefix-list {name} is empty\nip prefix-list {name}\n   seq {seq} deny 0.0.0.0/0\n", empty_alone=True, step=1),
    "nokia": Format('configure router policy-options\nbegin\nno prefix-list "{name}"\nprefix-list "{name}"\n', "    prefix {p} exact\n", "    prefix {p} prefix-length-range {lo}-{hi}\n", "    prefix {p} prefix-length-range {n}-{hi}\n", "exit\ncommit\n"),
    "nokia-md": Format('/configure policy-options\ndelete prefix-list "{name}"\nprefix-list "{name}" {\n', "    prefix {p} type exact {\n    }\n", "    prefix {p} type range {\n        start-length {lo}\n        end-length {hi}\n    }\n", "    prefix {p} type through {\n        through-length {hi}\n    }\n", "}\n"),
    "nokia-srl": Format('/routing-policy\ndelete prefix-set "{name}"\nprefix-set "{name}" {\n', "    prefix {p} mask-length-range exact { }\n", "    prefix {p} mask-length-range {lo}..{hi} { }\n", "    prefix {p} mask-length-range {n}..{hi} { }\n", "}\n"),
    "mikrotik6": Format("", '/routing filter add action=accept chain="{name}-V4" prefix={p}\n', '/routing filter add action=accept chain="{name}-V4" prefix={p} prefix-length={lo}-{hi}\n', '/routing filter add action=accept chain="{name}-V4" prefix={p} prefix-length={n}-{hi}\n', empty="# generated prefix-list {name} is empty\n"),
    "mikrotik7": Format("", '/routing filter rule add chain="{name}-V4" rule="if (dst=={p}) {accept}"\n', '/routing filter rule add chain="{name}-V4" rule="if (dst in {p} && dst-len in {lo}-{hi}) {accept}"\n', '/routing filter rule add chain="{name}-V4" rule="if (dst in {p} && dst-len in {n}-{hi}) {accept}"\n', empty="# generated prefix-list {name} is empty\n"),
    "huawei": Format("undo ip ip-prefix {name}\n", "ip ip-prefix {name} permit {a} {n}\n", "ip ip-prefix {name} permit {a} {n} greater-equal {lo} less-equal {hi}\n", "ip ip-prefix {name} permit {a} {n} less-equal {hi}\n", empty="ip ip-prefix {name} deny 0.0.0.0/0\n"),
    "huawei-xpl": Format("no xpl ip-prefix-list {name}\nxpl ip-prefix-list {name}\n", " {a} {n}", " {a} {n} ge {lo} le {hi}", " {a} {n} le {hi}", "\nend-list\n", ",\n"),
    "plain": Format("", "{p}\n", "{p}^{lo}-{hi}\n", "{p}^{n}-{hi}\n"),
}

PLACE = re.compile(r"\{(name|p|a|n|lo|hi|seq)\}")


def filled(template: str, **columns: Column) -> Column:
    parts = PLACE.split(template)
    out = [F.lit(x) if k % 2 == 0 else columns[x].cast("string") for k, x in enumerate(parts) if k % 2 or x]
    return F.concat(*out) if out else F.lit("")


def aggregate(entries: DataFrame) -> DataFrame:
    """The fewest disjoint entries that let the same prefixes through, each prefix length of a base as one run."""
    held = entries.select(F.col("name").alias("space"), "addr", "plen", "lo", "hi")
    whole = space.ranges(space.sweep({"a": space.intervals(held)}, F.col("a") > 0))
    return whole.select(F.col("space").alias("name"), "addr", "plen", "lo", "hi")


def refine(entries: DataFrame, most: int | None = None, least: int | None = None, max_length: int | None = None) -> DataFrame:
    """Let more specific prefixes through up to a length (most), only those from a length on (least), and drop entries longer than max_length."""
    if max_length is not None:
        entries = entries.where(F.col("plen") <= max_length)
    if most is not None:
        entries = entries.withColumn("hi", F.greatest("hi", F.lit(min(most, V4_BITS))))
    if least is not None:
        entries = entries.withColumn("lo", F.greatest("lo", F.least(F.lit(least), F.col("hi"))))
    return entries


def prefix_lists(entries: DataFrame, vendor: str, names: DataFrame | None = None) -> DataFrame:
    """(name, text) of each list for a vendor; names adds lists that have no entry. Entries come by address, then length."""
    if vendor not in PREFIX_LISTS:
        raise ValueError(f"no format for {vendor}: {', '.join(PREFIX_LISTS)}")
    form = PREFIX_LISTS[vendor]
    if not form.ranged and not entries.where((F.col("lo") != F.col("plen")) | (F.col("hi") != F.col("plen"))).isEmpty():
        raise ValueError(f"{vendor} has no ranges")
    listed = entries.select("name", "addr", "plen", "lo", "hi").distinct().groupBy("name").agg(F.sort_array(F.collect_list(F.struct("addr", "plen", "lo", "hi"))).alias("rows"))
    if names is not None:
        listed = names.select("name").distinct().join(listed, "name", "left")
    name = F.col("name")

    def line(e: Column, i: Column) -> Column:
        told = {"name": name, "p": prefix_text(e["addr"], e["plen"]), "a": dotted(e["addr"]), "n": e["plen"], "lo": e["lo"], "hi": e["hi"], "seq": (i + 1) * form.step}
        exact = (e["lo"] == e["plen"]) & (e["hi"] == e["plen"])
        return F.when(exact, filled(form.exact, **told)).when(e["lo"] > e["plen"], filled(form.ranged, **told)).otherwise(filled(form.upto, **told))

    body = F.array_join(F.transform("rows", line), form.between)
    bare = F.coalesce(F.size("rows"), F.lit(0)) <= 0
    head, tail, none = (filled(x, name=name, seq=F.lit(form.step)) for x in (form.head, form.tail, form.empty))
    empty = none if form.empty_alone else F.concat(head, none, tail)
    return listed.select("name", F.when(bare, empty).otherwise(F.concat(head, body, tail)).alias("text"))


def user_format(entries: DataFrame, template: str) -> DataFrame:
    """(name, text) by a template with %n address, %l length, %a lowest and %A highest length, %m mask, %i inverse mask, %N name, and \\n, \\t."""
    size = F.pow(F.lit(2.0), F.lit(V4_BITS) - F.col("plen")).cast("long")
    told = {"n": dotted(F.col("addr")), "l": F.col("plen").cast("string"), "a": F.col("lo").cast("string"), "A": F.col("hi").cast("string"), "m": dotted(F.lit(2**V4_BITS) - size), "i": dotted(size - 1), "N": F.col("name"), "%": F.lit("%")}
    parts = re.split(r"%([nlaAmiN%])", template.replace("\\n", "\n").replace("\\t", "\t"))
    text = F.concat(*[told[x] if k % 2 else F.lit(x) for k, x in enumerate(parts)])
    rows = entries.select("name", F.struct("addr", "plen", "lo", "hi", text.alias("text")).alias("r")).distinct()
    return rows.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("r"))["text"], "").alias("text"))


def print_ranges(entries: DataFrame, template: str, each: bool = False, most: int = 1 << 20) -> DataFrame:
    """(name, text) of ranges by a template with %p address, %l length, %L bits behind it, %n and %m lowest and highest length, %k mask, %K its inverse, %% and \\n, \\t, \\\\.

    With each, every prefix that a list's ranges hold is printed by itself, by address and length; a list of more than `most` is an error.
    """
    parts = re.split(r"(%[plLnmkK%]|\\[nt\\])", template)
    if any(x in "".join(parts[::2]) for x in "%\\"):
        raise ValueError(f"unknown escape in the format {template!r}")
    rows = entries.select("name", "addr", *[F.col(c).cast("int").alias(c) for c in ("plen", "lo", "hi")]).distinct()
    if each:
        size = rows.groupBy("name").agg(F.sum(range_size(F.col("plen"), F.col("lo"), F.col("hi"))).alias("n")).where(F.col("n") > most)
        if not size.isEmpty():
            raise ValueError(f"more than {most} prefixes; print them as ranges")
        made = rows.select("name", F.explode(materialized(F.col("addr"), F.col("plen"), F.col("lo"), F.col("hi"))).alias("p")).select("name", "p.addr", F.col("p.plen").cast("int").alias("plen")).distinct()
        rows = made.withColumns({"lo": F.col("plen"), "hi": F.col("plen")})
    block = F.pow(F.lit(2.0), F.lit(V4_BITS) - F.col("plen")).cast("long")
    text = lambda c: F.col(c).cast("string")
    told = {"%p": dotted(F.col("addr")), "%l": text("plen"), "%L": (F.lit(V4_BITS) - F.col("plen")).cast("string"), "%n": text("lo"), "%m": text("hi"), "%k": dotted(F.lit(2**V4_BITS) - block), "%K": dotted(block - 1), "%%": F.lit("%"), "\\n": F.lit("\n"), "\\t": F.lit("\t"), "\\\\": F.lit("\\")}
    line = F.concat(*[told[x] if k % 2 else F.lit(x) for k, x in enumerate(parts) if k % 2 or x])
    printed = rows.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("addr", "plen", "lo", "hi", line.alias("text")))).alias("rows"))
    return printed.select("name", F.array_join("rows.text", "").alias("text"))


# The kinds of list that each family of routers has a form for, and the kinds made of AS numbers.
AS_KINDS = ("as-set", "as-path", "origin-as-path", "as-list")
WRITES = {
    "prefix-list": "junos ios arista iosxr json bird openbgpd nokia nokia-md nokia-srl mikrotik6 mikrotik7 huawei huawei-xpl user plain",
    "as-set": "json openbgpd bird plain",
    "as-path": "junos ios arista iosxr json bird openbgpd nokia nokia-md huawei huawei-xpl",
    "origin-as-path": "junos ios arista iosxr openbgpd nokia nokia-md huawei huawei-xpl",
    "as-list": "junos",
    "route-filter-list": "junos",
    "route-filter": "junos ios arista openbgpd nokia nokia-md nokia-srl",
}


def refused(vendor: str, kind: str, aggregate: bool = False, refine: bool = False, sequence: bool = False, ipv6: bool = False, match: str = "") -> str | None:
    """Why a vendor's list can't be written with these options; None if it can."""
    if kind not in WRITES or vendor not in WRITES[kind].split():
        return f"{vendor} has no {kind}"
    from_numbers, plain_list = kind in AS_KINDS, kind == "prefix-list"
    limited = (vendor == "junos" and plain_list) or (vendor.startswith("nokia") and not plain_list) or from_numbers
    rules = [
        (aggregate and limited, "aggregation"),
        (refine and limited, "more specific prefixes"),
        (ipv6 and kind == "route-filter" and vendor in ("ios", "arista"), "IPv6"),
        (sequence and (from_numbers or vendor not in ("ios", "arista")), "sequence numbers"),
        (bool(match) and (vendor, kind) != ("junos", "route-filter"), "further conditions"),
    ]
    return next((f"{what} can't go with {vendor} {kind}" for broken, what in rules if broken), None)


# Head, the AS alone, a line of others ({list} joined by the last), tail, and what stands for none; {me} is the neighbour.
AS_PATHS = {
    "ios": ("no ip as-path access-list {name}\n", "ip as-path access-list {name} permit ^{me}(_{me})*$\n", "ip as-path access-list {name} permit ^{me}(_[0-9]+)*_({list})$\n", "", "ip as-path access-list {name} deny .*\n", "|", 4),
    "junos": ("policy-options {\nreplace:\n as-path-group {name} {\n", '  as-path a0 "^{me}({me})*$";\n', '  as-path a{k} "^{me}(.)*({list})$";\n', " }\n}\n", '  as-path aNone "!.*";\n', "|", 8),
    "openbgpd": ("", "allow from AS {me} AS {me}\n", "allow from AS {me} AS {list}\n", "", "deny from AS {me}\n", " ", 1),
    "huawei": ("undo ip as-path-filter {name}\n", "ip as-path-filter {name} permit ^{me}(_{me})*$\n", "ip as-path-filter {name} permit ^{me}(_[0-9]+)*_({list})$\n", "", "ip as-path-filter {name} deny .*\n", "|", 4),
}


def as_paths(asns: DataFrame, neighbours: DataFrame, vendor: str, width: int | None = None) -> DataFrame:
    """(name, text): filters for paths from a neighbour (name, me) that end at the list's AS numbers (name, asn), `width` of them a line."""
    head, alone, line, tail, none, joint, default = AS_PATHS[vendor]
    width = width or default
    numbered = asns.select("name", "asn").distinct().join(neighbours, "name").withColumn("__own", F.col("asn") == F.col("me"))
    others = numbered.where("NOT __own").withColumn("__n", F.row_number().over(Window.partitionBy("name").orderBy("asn")) - 1)
    lines = others.groupBy("name", F.floor(F.col("__n") / width).alias("line")).agg(F.sort_array(F.collect_list("asn")).alias("asns"))
    rows = lines.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("line", "asns"))).alias("lines"))
    own = numbered.groupBy("name").agg(F.max("__own").alias("own"))
    told = neighbours.join(own, "name", "left").join(rows, "name", "left")

    def put(template: str, **columns: Column) -> Column:
        parts = re.split(r"\{(name|me|list|k)\}", template)
        return F.concat(*[columns[x].cast("string") if k % 2 else F.lit(x) for k, x in enumerate(parts)])

    same = {"name": F.col("name"), "me": F.col("me")}
    body = F.array_join(F.transform("lines", lambda r: put(line, **same, k=r["line"] + 1, list=F.array_join(F.transform(r["asns"], lambda x: x.cast("string")), joint))), "")
    mine = F.when(F.col("own"), put(alone, **same)).otherwise("")
    return told.select("name", F.concat(put(head, **same), F.when(F.col("own").isNull(), put(none, **same)).otherwise(F.concat(mine, F.coalesce(body, F.lit("")))), put(tail, **same)).alias("text"))
