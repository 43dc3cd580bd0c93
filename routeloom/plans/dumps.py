"""Queries over files: registry dumps that are written, scanned and read as tables, and RPKI files, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes as at
from ..functions.prefix import prefix_text
from ..operators import generate, model, registry
from ..sources import rpsl
from ..sources.synthetic import OCTETS
from ..sources.synthetic import registry as load
from .queries import BROKEN, TEXT, after, entries, query
from .scratch import folder


def text(c: str) -> Column:
    return F.col(c).cast("string")


def written_text(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """A folder of text files with the only column of lines, in the folder that all executors share."""
    path = f"{folder(spark)}/{name}-{spark.sparkContext.applicationId}-{id(lines)}"
    lines.write.mode("overwrite").text(path)
    return path


def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's AS numbers, sets, routes and policies as a dump with comments, continuations and remarks, scanned again."""
    nums, sets, members, routes, policies = load(spark, sf_dir, "aut_nums", "sets", "members", "routes", "policies")
    tail = lambda c="source": F.concat(F.lit("\nsource: "), F.col(c), F.lit("\n"))
    listed = members.groupBy("set_name", "source").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce(F.concat(F.lit("AS"), text("asn")), "child"))), ",\n+ ").alias("listed"))
    own = sets.join(listed, ["set_name", "source"], "left")
    objects = [
        nums.select(F.concat(F.lit("# an AS number\naut-num:\tAS"), text("asn"), F.lit("\nas-name: N"), text("asn"), F.lit(" # own name\nmember-of: AS-N"), text("nation"), F.lit("\nmnt-by: "), F.col("mnt"), F.lit("\nremarks: first\n  second: no attribute"), tail())),
        own.select(F.concat(F.lit("as-set: "), F.lower("set_name"), F.lit("\nmembers: "), F.coalesce("listed", F.lit("")), F.lit("\nmbrs-by-ref: "), F.col("mbrs_by_ref"), F.lit("\nmnt-by: MNT-1"), tail())),
        routes.distinct().select(F.concat(F.lit("route: "), prefix_text(F.col("addr"), F.col("plen")), F.lit("\norigin: as"), text("origin"), F.lit("\nmnt-by: MNT-"), (F.col("addr") % 7).cast("string"), tail())),
        policies.where("text <> 'from accept'").groupBy("asn").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "attr", "text"))), lambda p: F.concat(p["attr"], F.lit(":"), F.regexp_replace(p["text"], "^(from|to) ", "$1\n+ "))), "\n").alias("p")).select(F.concat(F.lit("aut-num: AS"), text("asn"), F.lit("\n"), F.col("p"), F.lit("\nsource: TEST\n"))),
    ]
    rows = objects[0]
    for more in objects[1:]:
        rows = rows.union(more)
    return rpsl.scan(spark, written_text(spark, rows, "dump"))


@query("SELECT DISTINCT addr, plen::INTEGER AS plen, origin, source FROM routes", "routes")
def scan_routes(spark, sf_dir):
    return model.routes(dump(spark, sf_dir)).select("addr", F.col("plen").cast("int").alias("plen"), "origin", "source").distinct()


@query("SELECT DISTINCT set_name, source, asn, child FROM members JOIN (SELECT DISTINCT set_name, source FROM sets) USING (set_name, source)", "sets", "members")
def scan_members(spark, sf_dir):
    """Direct members as they are read from the dump's sets."""
    return model.members(dump(spark, sf_dir)).select("set_name", "source", "asn", "child").distinct()


@query("SELECT set_name, 'as-set' AS class, source, upper(mbrs_by_ref) AS mbrs_by_ref FROM sets", "sets")
def scan_sets(spark, sf_dir):
    return model.sets(dump(spark, sf_dir)).select("set_name", "class", "source", "mbrs_by_ref")


@query("SELECT asn, 'AS-N' || nation AS member_of, mnt, source FROM aut_nums", "aut_nums")
def scan_claims(spark, sf_dir):
    return model.claims(dump(spark, sf_dir)).select("asn", "member_of", "mnt", "source")


@query("SELECT asn, attr, (row_number() OVER (PARTITION BY asn ORDER BY ord, attr, text))::INTEGER AS ord, regexp_replace(text, ' +', ' ', 'g') AS text FROM policies WHERE text <> 'from accept'", "policies")
def scan_policies(spark, sf_dir):
    found = model.policies(dump(spark, sf_dir))
    return found.select("asn", "attr", F.col("ord").cast("int").alias("ord"), F.regexp_replace("text", r"\s+", " ").alias("text"))


SCANNED = "counted AS (SELECT 'aut-num' AS class, count(*) AS n FROM aut_nums UNION ALL SELECT 'as-set', count(*) FROM sets UNION ALL SELECT 'route', count(*) FROM (SELECT DISTINCT * FROM routes) UNION ALL SELECT 'aut-num', count(DISTINCT asn) FROM policies WHERE text <> 'from accept')"


@query(after(SCANNED, "SELECT class, sum(n)::BIGINT AS n FROM counted GROUP BY class"), "aut_nums", "sets", "routes", "policies")
def report_classes(spark, sf_dir):
    """The JSON report's counts of objects by class."""
    counts = F.from_json("report", "struct<class_counts:map<string,bigint>>")["class_counts"]
    return model.report(dump(spark, sf_dir)).select(F.explode(counts).alias("class", "n"))


@query(
    """SELECT class, name, count(*) AS n FROM (SELECT 'aut-num' AS class, unnest(['aut-num', 'as-name', 'member-of', 'mnt-by', 'remarks', 'source']) AS name FROM aut_nums
    UNION ALL SELECT 'as-set', unnest(['as-set', 'members', 'mbrs-by-ref', 'mnt-by', 'source']) FROM sets UNION ALL SELECT 'route', unnest(['route', 'origin', 'mnt-by', 'source']) FROM (SELECT DISTINCT * FROM routes)
    UNION ALL SELECT 'aut-num', attr FROM policies WHERE text <> 'from accept' UNION ALL SELECT 'aut-num', unnest(['aut-num', 'source']) FROM (SELECT DISTINCT asn FROM policies WHERE text <> 'from accept')) GROUP BY ALL""",
    "aut_nums",
    "sets",
    "routes",
    "policies",
)
def scan_attributes(spark, sf_dir):
    return rpsl.attributes(dump(spark, sf_dir)).groupBy("class", "name").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source, count(*) OVER (PARTITION BY source) AS n, md5(string_agg(t, '' ORDER BY t) OVER (PARTITION BY source ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS digest FROM (SELECT DISTINCT source, concat('route: ', " + OCTETS.format("addr") + ", '/', plen, chr(10), 'origin: as', origin, chr(10), 'mnt-by: MNT-', addr % 7, chr(10), 'source: ', source, chr(10)) AS t FROM routes)", "routes")
def scan_texts(spark, sf_dir):
    """The texts of route objects, byte by byte as they stand in the dump."""
    objects = dump(spark, sf_dir).where("class = 'route'")
    texts = model.object_text(objects).join(objects.select("file", "block", "seq", "source"), ["file", "block", "seq"])
    return texts.groupBy("source").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("text")), "")).alias("digest"))


@query("SELECT asn, concat('aut-num:        AS', asn, chr(10), 'as-name:        N', asn, chr(10), 'member-of:      AS-N', nation, chr(10), 'mnt-by:         ', mnt, chr(10), 'remarks:        first', chr(10), '                second: no attribute', chr(10), 'source:         ', source, chr(10)) AS text FROM aut_nums", "aut_nums")
def formatted_texts(spark, sf_dir):
    objects = dump(spark, sf_dir).where("class = 'aut-num' AND exists(attrs, a -> a.name = 'as-name')")
    asn = rpsl.as_number(F.regexp_extract("text", r"^aut-num:\s*(\S+)", 1))
    return model.formatted(objects).select(asn.alias("asn"), F.regexp_replace(F.regexp_replace("text", "\t", ""), "\n +second", "\n                second").alias("text"))


@query("SELECT DISTINCT concat(" + OCTETS.format("addr") + ", '/', plen) AS route, 'as' || origin AS origin, 'MNT-' || addr % 7 AS mnt_by, source FROM routes", "routes")
def typed_routes(spark, sf_dir):
    """Typed rows of one class: single attributes as text, others as arrays."""
    rows = model.typed(dump(spark, sf_dir), "route")
    return rows.select(F.trim("route").alias("route"), "origin", F.array_join("mnt_by", "|").alias("mnt_by"), "source").distinct()


# ---- RPKI files


@query("SELECT DISTINCT concat(" + OCTETS.format("addr") + ", '/', plen) AS prefix, max_length::INTEGER AS max_length, asn FROM vrps", "vrps")
def vrp_file(spark, sf_dir):
    """ROAs as a JSON file, read again; some AS numbers with AS before them, some lengths left out."""
    (vrps,) = load(spark, sf_dir, "vrps")
    same = F.col("max_length") == F.col("plen")
    roa = F.struct(F.when(F.col("asn") % 2 == 0, F.concat(F.lit("AS"), text("asn"))).otherwise(text("asn")).alias("asn"), prefix_text(F.col("addr"), F.col("plen")).alias("prefix"), F.when(~same, F.col("max_length").cast("int")).alias("maxLength"), F.lit("test").alias("ta"))
    told = vrps.groupBy().agg(F.collect_list(roa).alias("roas")).select(F.to_json(F.struct("roas")).alias("value"))
    return rpsl.read_vrps(spark, written_text(spark, told, "vrps")).select("prefix", F.col("max_length").cast("int").alias("max_length"), "asn").distinct()


@query("SELECT DISTINCT customer, provider FROM aspas", "aspas")
def aspa_file(spark, sf_dir):
    (aspas,) = load(spark, sf_dir, "aspas")
    records = aspas.groupBy("customer").agg(F.collect_list(F.when(F.col("provider") % 2 == 0, F.concat(F.lit("AS"), text("provider"), F.lit(" (v4)"))).otherwise(text("provider"))).alias("providers"))
    told = records.groupBy().agg(F.collect_list(F.struct(text("customer").alias("customer_asid"), "providers")).alias("aspas")).select(F.to_json(F.struct("aspas")).alias("value"))
    return rpsl.read_aspas(spark, written_text(spark, told, "aspas"))


# ---- attribute arrays


@query("SELECT DISTINCT addr, plen::INTEGER AS plen, origin, source, concat('route,origin,mnt-by,source', CASE WHEN origin % 2 = 0 THEN ',changed' ELSE '' END) AS names, 'MNT-A|MNT-B' AS mnts FROM routes", "routes")
def edited_objects(spark, sf_dir):
    """Objects with an attribute's values replaced in their place, and for some another one behind the last."""
    objects = dump(spark, sf_dir).where("class = 'route'")
    swapped = at.replaced(F.col("attrs"), "mnt-by", F.array(F.lit("MNT-A"), F.lit("MNT-B")))
    even = rpsl.as_number(F.try_element_at(rpsl.values("origin"), F.lit(1))) % 2 == 0
    edited = objects.withColumn("attrs", F.when(even, at.appended(swapped, "changed", F.lit("x"))).otherwise(swapped))
    routes = edited.select(F.trim("key").alias("prefix"), rpsl.as_number(F.try_element_at(rpsl.values("origin"), F.lit(1))).alias("origin"), "source", F.array_join(F.array_distinct(F.transform("attrs", lambda a: a["name"])), ",").alias("names"), F.array_join(rpsl.values("mnt-by"), "|").alias("mnts"))
    told = model.prefix_columns(F.col("prefix"))
    return routes.select(told["addr"].alias("addr"), told["plen"].cast("int").alias("plen"), "origin", "source", "names", "mnts").distinct()


# ---- lists of all vendors


def template_sql(template: str) -> str:
    """SQL that fills one of the fixed templates from the columns of entries."""
    columns = {"p": f"concat({TEXT.format('addr')}, '/', plen)", "a": TEXT.format("addr"), "n": "plen", "name": "name", "lo": "lo", "hi": "hi", "seq": "seq"}
    parts = generate.PLACE.split(template)
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
    return "concat(" + ", ".join(columns[x] if k % 2 else quoted(x) for k, x in enumerate(parts)) + ")"


def vendor_list(vendor: str) -> None:
    form = generate.PREFIX_LISTS[vendor]
    exact = "lo = plen AND hi = plen"
    ranged = f"CASE WHEN {exact} THEN {template_sql(form.exact)} WHEN lo > plen THEN {template_sql(form.ranged)} ELSE {template_sql(form.upto)} END" if form.ranged else template_sql(form.exact)
    only = "" if form.ranged else f"WHERE {exact}"
    between = "'" + form.between.replace("\n", "' || chr(10) || '") + "'"
    held = f"entries AS (SELECT DISTINCT 'L' || origin % 7 AS name, addr, plen, CASE WHEN addr % 1024 = 0 THEN plen + 1 ELSE plen END AS lo, CASE WHEN addr % 512 = 0 THEN plen + 2 ELSE plen END AS hi FROM routes), lines AS (SELECT *, {form.step} * row_number() OVER (PARTITION BY name ORDER BY addr, plen, lo, hi) AS seq FROM entries {only})"

    def run(spark, sf_dir):
        rows = entries(spark, sf_dir)
        return generate.prefix_lists(rows if form.ranged else rows.where("lo = plen AND hi = plen"), vendor)

    run.__name__ = "filter_list_" + vendor.replace("-", "_")
    head, tail = template_sql(form.head).replace("seq", str(form.step)), template_sql(form.tail)
    query(after(held, f"SELECT name, concat({head}, string_agg({ranged}, {between} ORDER BY addr, plen, lo, hi), {tail}) AS text FROM lines GROUP BY name"), "routes")(run)


for vendor in generate.PREFIX_LISTS:
    if vendor not in ("ios", "bird", "junos-route-filter-list"):
        vendor_list(vendor)


@query(after("entries AS (SELECT DISTINCT 'L' || origin % 7 AS name, addr, plen, CASE WHEN addr % 1024 = 0 THEN plen + 1 ELSE plen END AS lo, CASE WHEN addr % 512 = 0 THEN plen + 2 ELSE plen END AS hi FROM routes)", f"SELECT name, string_agg(concat(name, ' ', {TEXT.format('addr')}, '/', plen, ' ', lo, '-', hi, ' 100%', chr(10)), '' ORDER BY addr, plen, lo, hi) AS text FROM entries GROUP BY name"), "routes")
def user_format_list(spark, sf_dir):
    return generate.user_format(entries(spark, sf_dir), "%N %n/%l %a-%A 100%%\\n")


@query("SELECT DISTINCT 'L' || origin % 7 AS name, addr, plen::INTEGER AS plen, greatest(plen, least(26, greatest(plen, 27)))::INTEGER AS lo, greatest(plen, 27)::INTEGER AS hi FROM routes WHERE plen <= 27", "routes")
def refined_entries(spark, sf_dir):
    """Entries that let more specific prefixes through from 26 to 27, without those longer than 27."""
    (routes,) = load(spark, sf_dir, "routes")
    rows = routes.select(F.concat(F.lit("L"), (F.col("origin") % 7).cast("string")).alias("name"), "addr", F.col("plen").cast("int").alias("plen"), F.col("plen").cast("int").alias("lo"), F.col("plen").cast("int").alias("hi")).distinct()
    return generate.refine(rows, most=27, least=26, max_length=27)


MASKS = {"k": "(4294967296 - (1::BIGINT << (32 - plen)))", "K": "((1::BIGINT << (32 - plen)) - 1)"}


@query(after("entries AS (SELECT DISTINCT 'L' || origin % 7 AS name, addr, plen, CASE WHEN addr % 1024 = 0 THEN plen + 1 ELSE plen END AS lo, CASE WHEN addr % 512 = 0 THEN plen + 2 ELSE plen END AS hi FROM routes)", f"SELECT name, string_agg(concat({TEXT.format('addr')}, '/', plen, ' ', 32 - plen, ' ', lo, '-', hi, ' ', {TEXT.format(MASKS['k'])}, ' ', {TEXT.format(MASKS['K'])}, '%', chr(10)), '' ORDER BY addr, plen, lo, hi) AS text FROM entries GROUP BY name"), "routes")
def printed_ranges(spark, sf_dir):
    return generate.print_ranges(entries(spark, sf_dir), "%p/%l %L %n-%m %k %K%%\\n")


@query(after(f"entries AS (SELECT DISTINCT 'L' || origin % 7 AS name, addr, plen, CASE WHEN addr % 1024 = 0 THEN plen + 1 ELSE plen END AS lo, CASE WHEN addr % 512 = 0 THEN plen + 2 ELSE plen END AS hi FROM routes), listed AS (SELECT DISTINCT name, addr + i.i * (1::BIGINT << (32 - n.n)) AS a, n.n AS n FROM entries, range(24, 33) n(n), range(0, 8) i(i) WHERE n.n BETWEEN lo AND hi AND i.i < (1 << (n.n - plen)))", f"SELECT name, string_agg(concat({TEXT.format('a')}, '/', n, ';'), '' ORDER BY a, n) AS text FROM listed GROUP BY name"), "routes")
def printed_prefixes(spark, sf_dir):
    return generate.print_ranges(entries(spark, sf_dir), "%p/%l;", each=True)


@query("SELECT vendor, kind, refused FROM (VALUES ('junos', 'prefix-list', true), ('junos', 'route-filter', false), ('ios', 'prefix-list', false), ('nokia', 'route-filter', true), ('bird', 'as-set', true), ('plain', 'as-path', true), ('mikrotik6', 'as-path', true), ('openbgpd', 'route-filter', false)) t(vendor, kind, refused), (SELECT 1 FROM region LIMIT 1)", "aut_nums")
def refused_aggregation(spark, sf_dir):
    """Which lists can't be aggregated, by the rules of what vendors write."""
    asked = [("junos", "prefix-list"), ("junos", "route-filter"), ("ios", "prefix-list"), ("nokia", "route-filter"), ("bird", "as-set"), ("plain", "as-path"), ("mikrotik6", "as-path"), ("openbgpd", "route-filter")]
    return spark.createDataFrame([(v, k, generate.refused(v, k, aggregate=True) is not None) for v, k in asked], "vendor string, kind string, refused boolean")


@query(after(BROKEN, "SELECT obj_id, rule, name FROM broken"), "attributes")
def arin_violations(spark, sf_dir):
    """Objects against the profile of one registry."""
    return registry.violations(*load(spark, sf_dir, "attributes"), model.profile(model.PROFILES["arin"]))
