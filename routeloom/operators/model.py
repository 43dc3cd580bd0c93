"""From scanned objects to the engine's tables: sets, members, routes, claims, policies; typed rows; reports.

All parsing here is columns. What can't be read is missing from a table and stands in `diagnostics` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import address, bits, masked, parsed
from ..sources.rpsl import as_number, items, values

SET_CLASSES = ("as-set", "route-set", "rtr-set", "filter-set", "peering-set")
OPERATOR = r"(\^(?:\+|-|\d+(?:-\d+)?))?$"
#: Attributes that list members, with the class of set that has them.
MEMBER_ATTRIBUTES = ("members", "mp-members", "src-members")
POLICY_ATTRIBUTES = ("import", "mp-import", "export", "mp-export", "default", "mp-default")

# Attributes of the classes that a profile knows, as name, ! (required), * (may repeat).
COMMON = "descr* admin-c* tech-c* remarks* notify* mnt-by!* created last-modified source! changed* org*"
CLASSES = {
    "aut-num": f"aut-num! as-name! member-of* import* mp-import* export* mp-export* default* mp-default* status import-via* export-via* sponsoring-org mnt-lower* mnt-routes* {COMMON}",
    "as-set": f"as-set! members* src-members* mbrs-by-ref* mnt-lower* {COMMON}",
    "route-set": f"route-set! members* mp-members* src-members* mbrs-by-ref* mnt-lower* {COMMON}",
    "rtr-set": f"rtr-set! members* mp-members* mbrs-by-ref* mnt-lower* {COMMON}",
    "filter-set": f"filter-set! filter mp-filter mnt-lower* {COMMON}",
    "peering-set": f"peering-set! peering* mp-peering* mnt-lower* {COMMON}",
    "route": f"route! origin! member-of* holes* inject* aggr-mtd aggr-bndry export-comps components pingable* ping-hdl* mnt-lower* mnt-routes* {COMMON}",
    "route6": f"route6! origin! member-of* holes* inject* aggr-mtd aggr-bndry export-comps components pingable* ping-hdl* mnt-lower* mnt-routes* {COMMON}",
    "inetnum": f"inetnum! netname! country!* status! mnt-lower* mnt-routes* mnt-domains* mnt-irt* abuse-c geoloc language* sponsoring-org {COMMON}",
    "inet6num": f"inet6num! netname! country!* status! mnt-lower* mnt-routes* mnt-domains* mnt-irt* abuse-c geoloc language* sponsoring-org {COMMON}",
    "mntner": f"mntner! auth!* upd-to!* mnt-nfy* referral-by {COMMON}",
    "person": f"person! address!* phone!* fax-no* e-mail* nic-hdl! {COMMON}",
    "role": f"role! address!* phone* fax-no* e-mail!* nic-hdl! abuse-mailbox {COMMON}",
    "organisation": f"organisation! org-name! org-type! address!* phone* fax-no* e-mail!* abuse-c ref-nfy* mnt-ref!* country {COMMON}",
    "as-block": f"as-block! mnt-lower* {COMMON}",
    "inet-rtr": f"inet-rtr! alias* local-as! ifaddr* interface* peer* mp-peer* member-of* {COMMON}",
}


# The routing classes as registries of the IRR software take them; what a class says of itself holds before the common part.
IRR_COMMON = "descr* admin-c* tech-c* remarks* notify* mnt-by!* changed* source! last-modified*"
IRR_ROUTE = "origin! holes* member-of* inject* aggr-bndry aggr-mtd export-comps components geoidx* roa-uri"
IRR = {
    "as-set": f"{IRR_COMMON} as-set! members* mbrs-by-ref*",
    "route-set": f"{IRR_COMMON} route-set! members* mp-members* mbrs-by-ref*",
    "route": f"{IRR_COMMON} route! {IRR_ROUTE}",
    "route6": f"{IRR_COMMON} route6! {IRR_ROUTE}",
    "aut-num": f"{IRR_COMMON} aut-num! as-name! member-of* import* mp-import* import-via* export* mp-export* export-via* default* mp-default* admin-c!* tech-c!* mnt-by*",
}
#: Profiles by name: all classes merged, the IRR software's, and ARIN's, which adds when an object was made and changed.
PROFILES = {"merged": CLASSES, "irr": IRR, "arin": {c: f"{line} created last-modified" for c, line in IRR.items()}}


def profile(classes: dict[str, str] = CLASSES) -> list[tuple[str, str, bool, bool]]:
    """(class, attribute, required, single) of each class; of an attribute that is named twice the later holds."""
    told = {(c, a.rstrip("!*")): ("!" in a, not a.endswith("*")) for c, line in classes.items() for a in line.split()}
    return [(c, name, *how) for (c, name), how in told.items()]


def with_src_members(classes: dict[str, str]) -> dict[str, str]:
    """A profile whose as-sets and route-sets may have members of a named registry."""
    return {c: f"{line} src-members*" if c in ("as-set", "route-set") else line for c, line in classes.items()}


def source_of(objects: DataFrame) -> Column:
    return F.upper(F.trim(F.coalesce("source", F.lit(""))))


def set_name(text: Column) -> Column:
    """Canonical set name: upper case, AS numbers without leading zeros; null if a component is neither an AS number nor a set name, or the classes differ."""
    parts = F.split(F.upper(F.trim(text)), ":")
    good = F.forall(parts, lambda p: p.rlike(r"^(AS\d+|(AS|RS|RTRS|FLTR|PRNG)-([A-Z0-9_-]*[A-Z0-9])?)$"))
    kinds = F.array_distinct(F.filter(F.transform(parts, lambda p: F.regexp_extract(p, "^(AS|RS|RTRS|FLTR|PRNG)-", 1)), lambda k: k != ""))
    plain = F.transform(parts, lambda p: F.when(p.rlike(r"^AS\d+$"), F.concat(F.lit("AS"), as_number(p).cast("string"))).otherwise(p))
    return F.when(good & (F.size(kinds) == 1) & (F.octet_length(text) <= 1024), F.array_join(plain, ":"))


def prefix_columns(text: Column) -> dict[str, Column]:
    """Address, length and bits of an IPv4 prefix, short forms such as 10/8 filled with zeros; nulls if it isn't one."""
    head, length = F.substring_index(text, "/", 1), F.regexp_extract(text, r"/(\d{1,2})$", 1).try_cast("int")
    octets = F.size(F.split(head, r"\."))
    whole = F.when(octets < 4, F.concat(head, F.repeat(F.lit(".0"), 4 - octets))).otherwise(head)
    plen = F.when(length <= 32, length)
    addr = F.when(plen.isNotNull(), masked(address(whole), plen))
    return {"addr": addr, "plen": F.when(addr.isNotNull(), plen), "key": bits(addr, plen)}


def sets(objects: DataFrame) -> DataFrame:
    """(set_name, class, source, mbrs_by_ref): sets whose name fits their class."""
    prefix = {"as-set": "AS", "route-set": "RS", "rtr-set": "RTRS", "filter-set": "FLTR", "peering-set": "PRNG"}
    named = objects.where(F.col("class").isin(*SET_CLASSES)).withColumn("set_name", set_name(F.col("key")))
    fits = F.coalesce(*[F.when(F.col("class") == c, F.col("set_name").rlike(f"(^|:){p}-")) for c, p in prefix.items()])
    return named.where(fits).select("set_name", "class", source_of(objects).alias("source"), F.upper(F.array_join(items("mbrs-by-ref"), ",")).alias("mbrs_by_ref"))


def member_columns(item: Column) -> dict[str, Column]:
    """AS number, set with its registry, or IPv4 prefix of a member, with its operator."""
    op = F.regexp_extract(item, OPERATOR, 1)
    base = F.when(op == "", item).otherwise(F.expr("substring(item, 1, length(item) - length(regexp_extract(item, '(\\\\^(\\\\+|-|[0-9]+(-[0-9]+)?))$', 1)))"))
    scoped = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9_-]*)::(.+)$", 1)
    name = F.when(scoped == "", base).otherwise(F.regexp_extract(base, r"^[^:]*::(.+)$", 1))
    child = F.when(as_number(name).isNull(), set_name(name))
    return {"asn": as_number(base), "child": child, "child_source": F.when((scoped != "") & child.isNotNull(), F.upper(scoped)), **prefix_columns(base), "op": op}


def members(objects: DataFrame) -> DataFrame:
    """(set_name, source, asn, child, child_source, addr, plen, key, op, item) of as-sets and route-sets.

    Items of src-members come before those of members with the same key; one name under two registries is left out.
    """
    held = objects.where(F.col("class").isin("as-set", "route-set")).withColumn("set_name", set_name(F.col("key"))).where("set_name IS NOT NULL")
    marked = lambda scoped: lambda x: F.struct(F.lit(scoped).alias("scoped"), x.alias("item"))
    listed = F.concat(*[F.transform(items(a), marked(a == "src-members")) for a in MEMBER_ATTRIBUTES])
    rows = held.select("set_name", source_of(objects).alias("source"), F.explode(listed).alias("m")).select("set_name", "source", "m.*")
    told = rows.withColumns(member_columns(F.col("item"))).where("asn IS NOT NULL OR child IS NOT NULL OR addr IS NOT NULL")
    identity = F.concat_ws("|", F.coalesce("child", F.col("asn").cast("string"), F.concat("key", F.lit("/"))), "op")
    # One name under two registries says nothing certain; a scoped name replaces the plain one.
    known = told.groupBy("set_name", "source", identity.alias("__id")).agg(F.max("scoped").alias("__scoped"), F.count_distinct(F.when(F.col("scoped"), F.col("child_source"))).alias("__registries"))
    joined = told.withColumn("__id", identity).join(known, ["set_name", "source", "__id"])
    return joined.where((F.col("scoped") == F.col("__scoped")) & (F.col("__registries") <= 1)).select("set_name", "source", "asn", "child", "child_source", "addr", "plen", "key", "op", "item").distinct()


def routes(objects: DataFrame) -> DataFrame:
    """(addr, plen, key, origin, source) of route objects."""
    rows = objects.where("class = 'route'").select(F.trim("key").alias("prefix"), as_number(F.try_element_at(values("origin"), F.lit(1))).alias("origin"), source_of(objects).alias("source"))
    return rows.select(*[v.alias(k) for k, v in prefix_columns(F.col("prefix")).items()], "origin", "source").where("addr IS NOT NULL AND origin IS NOT NULL")


def all_routes(objects: DataFrame) -> DataFrame:
    """(af, prefix, plen, key, origin, source) of route and route6 objects whose prefix is of their family."""
    rows = objects.where("class IN ('route', 'route6')").select("class", parsed("key").alias("p"), as_number(F.try_element_at(values("origin"), F.lit(1))).alias("origin"), source_of(objects).alias("source"))
    family = F.when(F.col("class") == "route", 4).otherwise(6)
    return rows.where((F.col("p.af") == family) & F.col("origin").isNotNull()).select("p.af", F.col("p.text").alias("prefix"), "p.plen", "p.key", "origin", "source")


def claims(objects: DataFrame) -> DataFrame:
    """(class, asn, addr, plen, member_of, mnt, source): who claims to be in which set; aut-nums must be written with AS."""
    rows = objects.where("class IN ('aut-num', 'route')").withColumn("__of", F.explode(items("member-of")))
    named = rows.select("class", F.when(F.col("class") == "aut-num", as_number(F.col("key"))).otherwise(as_number(F.try_element_at(values("origin"), F.lit(1)))).alias("asn"), F.when(F.col("class") == "route", F.trim("key")).alias("prefix"), set_name(F.col("__of")).alias("member_of"), F.array_join(items("mnt-by"), ",").alias("mnt"), source_of(objects).alias("source"))
    fits = F.when(F.col("class") == "aut-num", F.col("member_of").rlike("(^|:)AS-")).otherwise(F.col("member_of").rlike("(^|:)RS-"))
    return named.withColumns(prefix_columns(F.col("prefix"))).where(fits & F.col("asn").isNotNull()).select("class", "asn", "addr", "plen", "member_of", "mnt", "source")


def policies(objects: DataFrame) -> DataFrame:
    """(asn, attr, ord, text) of aut-nums, in the order written."""
    rows = objects.where("class = 'aut-num'").select(as_number(F.col("key")).alias("asn"), F.explode(F.filter("attrs", lambda a: a["name"].isin(*POLICY_ATTRIBUTES))).alias("a"))
    return rows.where("asn IS NOT NULL").select("asn", F.col("a.name").alias("attr"), F.col("a.ord").alias("ord"), F.regexp_replace("a.value", "\n", " ").alias("text"))


def typed(objects: DataFrame, kind: str, classes: dict[str, str] = CLASSES) -> DataFrame:
    """Objects of one class with a column for each attribute: text for single ones (the first), arrays for others."""
    columns = []
    for _, name, _, single in (p for p in profile(classes) if p[0] == kind):
        every = values(name)
        columns.append((F.try_element_at(every, F.lit(1)) if single else every).alias(name.replace("-", "_")))
    return objects.where(F.col("class") == kind).select("file", "block", "seq", *columns)


def diagnostics(objects: DataFrame) -> DataFrame:
    """Rows of a scan's errors and of keys that can't be read."""
    scanned = objects.select("file", "block", "seq", "class", F.explode("diags").alias("d")).select("file", "block", "seq", "class", "d.rule", "d.severity", "d.message", "d.line")
    bad = (
        F.when(F.trim("key") == "", "object/empty-key")
        .when((F.col("class") == "route") & F.col("addr").isNull(), "object/route-prefix")
        .when((F.col("class") == "aut-num") & F.col("asn").isNull(), F.when(F.trim("key").rlike(r"^\d+$"), "object/aut-num-bare-number").otherwise("object/aut-num-as"))
        .when(F.col("class").isin(*SET_CLASSES) & F.col("name").isNull(), F.concat(F.lit("object/"), "class", F.lit("-name")))
    )
    keyed = objects.where("class IS NOT NULL").withColumns({"addr": prefix_columns(F.trim("key"))["addr"], "asn": as_number(F.col("key")), "name": set_name(F.col("key"))}).withColumn("rule", bad).where("rule IS NOT NULL")
    severity = F.when(F.col("rule") == "object/aut-num-bare-number", "warning").otherwise("error")
    return scanned.unionByName(keyed.select("file", "block", "seq", "class", "rule", severity.alias("severity"), F.col("key").alias("message"), F.lit(1).alias("line")))


def report(objects: DataFrame) -> DataFrame:
    """One JSON row: objects, their classes, and diagnostics by severity and rule, sorted."""
    classes = objects.where("class IS NOT NULL").groupBy("class").count()
    told = diagnostics(objects).groupBy("rule", "severity").agg(F.count("*").alias("count"), F.min(F.struct("file", "block", "seq", "line")).alias("first"))
    ordered = lambda df, *by: df.agg(F.sort_array(F.collect_list(F.struct(*by))).alias("rows"))
    a, b = ordered(classes, "class", "count"), ordered(told, "rule", "severity", "count", "first")
    joined = a.select(F.lit(1).alias("one"), F.col("rows").alias("classes")).join(b.select(F.lit(1).alias("one"), F.col("rows").alias("by_rule")), "one")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, r: s + r["count"])
    fields = F.struct(F.lit(1).alias("schema_version"), total("classes").alias("objects"), F.map_from_arrays("classes.class", "classes.count").alias("class_counts"), total("by_rule").alias("diagnostics_total"), F.col("by_rule"))
    return joined.select(F.to_json(fields).alias("report"))


def object_text(objects: DataFrame) -> DataFrame:
    """Objects as they were written, byte by byte, with the comments before them."""
    return objects.select("file", "block", "seq", F.concat("trivia", F.array_join(F.transform("attrs", lambda a: a["raw"]), "")).alias("text"))


def formatted(objects: DataFrame, width: int = 16) -> DataFrame:
    """Objects with names and values aligned, continuations under the values."""
    margin = " " * width
    line = lambda a: F.concat(F.rpad(F.concat(a["name"], F.lit(":")), F.greatest(F.lit(width), F.length(a["name"]) + 2), " "), F.regexp_replace(a["value"], "\n", "\n" + margin), F.lit("\n"))
    return objects.select("file", "block", "seq", F.array_join(F.transform("attrs", line), "").alias("text"))
