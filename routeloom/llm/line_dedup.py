"""Line dedup by site-relative frequency.

Pages are grouped by host. The pages of a host that contain a line are divided by the host's pages, and a line whose share exceeds
`ratio` is boilerplate there, if `min_pages` of the host's pages have it; every such line is dropped from the host's pages, whatever it
leaves of them. Pages of a host with equal texts are one page in both counts: copies of a page don't show that its lines are furniture
of the site, and are another operator's job. Lines are compared without blanks at either end; blank lines are never dropped.

DataFrame functions only. Lines are counted by two independent 64-bit hashes, once for each page, with partial sums before each
shuffle, so that neither a host nor a line with most of the rows meets in one task. A host can't have more than
lines-for-each-page / ratio boilerplate lines, so its list is short; the lists are broadcast if they hold at most `broadcast_lines`
lines, and otherwise joined by host with hot hosts salted.

Null text stays null, empty text empty; null hosts are one host of their own, apart from the empty name; repeated rows are kept, as
copies. Texts and lines of any length are taken whole. Other columns are carried along whatever their names, but for two that
are called n_lines and n_removed as the results are (see `dedup_lines`), which are replaced. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, named, salted_join, table, unused

RATIO, MIN_PAGES = 0.05, 2


def line_key(line: Column) -> Column:
    text = F.trim(line)
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("line"), text).alias("b"))


def host_key(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), named(host).cast("string")), F.lit("-"))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): keys of each host's boilerplate lines."""
    keyed = pages.select(host_key(host).alias("host"), named(text).alias("text")).withColumn("page", line_key(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("-"))))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    found = keyed.select("host", "page", F.explode(F.array_distinct(F.transform(lines, line_key))).alias("line"))
    often = found.distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = keyed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    common = often.join(totals, "host").where(F.col("n") / F.col("pages") > ratio)
    return common.groupBy("host").agg(F.collect_set("line").alias("lines"))


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = 100_000, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """pages with the text changed, and the counts of lines before and of lines removed under the names n_lines and n_removed."""
    key, lines, whole, kept = unused(pages, "host", "lines", "whole", "kept")
    common = materialize(boilerplate(pages, host, text, ratio, min_pages).toDF(key, lines), "boilerplate")
    size = common.agg(F.coalesce(F.sum(F.size(lines)), F.lit(0))).first()[0]
    hosted = pages.withColumn(key, host_key(host))
    # Lines of a host that has none need no look at the list.
    split = (hosted.join(F.broadcast(common), key, "left") if size <= broadcast_lines else salted_join(hosted, common, [key], "left")).withColumn(whole, F.split(named(text), "\n", -1))
    left = F.when(F.col(lines).isNull(), F.col(whole)).otherwise(F.filter(whole, lambda x: ~F.array_contains(F.col(lines), line_key(x)) | (F.trim(x) == "")))
    cut = split.withColumn(kept, left)
    out = [F.array_join(kept, "\n").alias(c) if c == text else named(c) for c in pages.columns if c not in (n_lines, n_removed)]
    counts = [F.when(named(text).isNull(), 0).otherwise(n).alias(c) for n, c in ((F.size(whole), n_lines), (F.size(whole) - F.size(kept), n_removed))]
    return cut.select(*out, *counts)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, their source as host."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def sql() -> str:
    """The same by the lines themselves instead of their hashes."""
    return f"""WITH
    paged AS (SELECT *, row_number() OVER () AS rid, coalesce('h' || source, '-') AS host FROM documents),
    lined AS (SELECT text, host, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT host, text FROM paged WHERE text IS NOT NULL)),
    often AS (SELECT host, trim(line) AS line, count(DISTINCT text) AS n FROM lined WHERE trim(line) <> '' GROUP BY ALL HAVING count(DISTINCT text) >= {MIN_PAGES}),
    pages AS (SELECT host, count(DISTINCT text) + max((text IS NULL)::INTEGER) AS pages FROM paged GROUP BY host),
    common AS (SELECT host, list(line) AS lines FROM often JOIN pages USING (host) WHERE n::DOUBLE / pages > {RATIO} GROUP BY host),
    parted AS (SELECT paged.*, string_split(text, chr(10)) AS whole, coalesce(lines, []) AS lines FROM paged LEFT JOIN common USING (host)),
    cut AS (SELECT *, list_filter(whole, lambda x: trim(x) = '' OR NOT list_contains(lines, trim(x))) AS kept FROM parted)
    SELECT doc_id, coalesce(len(whole), 0)::INTEGER AS n_lines, coalesce(len(whole) - len(kept), 0)::INTEGER AS n_removed,
        length(array_to_string(kept, chr(10)))::INTEGER AS kept_chars, md5(array_to_string(kept, chr(10))) AS kept_md5 FROM cut"""
