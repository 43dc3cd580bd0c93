"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over host, path and the rest of a url, with the literal tokens that any url it fits must have. One
pass counts how many urls have each of the rules' tokens, and a rule is filed under its rarest. The tokens of a url then fetch its
candidates, and only those run their expression. A site rule (host and path) beats the pattern rules, the longest site rule beats the
others; where no site rule fits, a url that a pattern rule fits is blocked and all others are allowed.

DataFrame functions only. Up to INLINE_RULES rules the index is part of the expression and nothing is shuffled; beyond, it is a table,
joined to the distinct urls' tokens. Null urls and those without :// have empty host and path and are allowed. Repeated rows are
judged each; columns of the input besides id and url aren't used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

INLINE_RULES = 200

# The site rules that contracts name.
SITE_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

# Labels of hosts, path segments and query names that are blocked where no site rule fits.
BLOCKED_LABELS = ("ads", "ad", "adserver", "adservice", "doubleclick", "tracker", "tracking", "pixel", "casino", "poker", "porn", "xxx", "warez", "torrent")
BLOCKED_SEGMENTS = ("ads", "advert", "adclick", "banner", "popunder", "casino", "porn", "xxx", "warez", "torrent", "phishing")
BLOCKED_QUERIES = ("phpsessid", "jsessionid", "affid", "clickid")


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    #: Length of a site rule; 0 for pattern rules, which any site rule beats.
    rank: int


def tokens_in(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with its subdomains and a prefix of the path; a last token that the path leaves open isn't literal."""
    closed = tokens_in(host) + tokens_in(path)[: None if not path[-1:].isalnum() else -1]
    return Rule(host + path, rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}", tuple(closed), verdict, len(host + path))


def default_rules(sites=SITE_RULES) -> list[Rule]:
    labels = [Rule(f"label {x}", rf"(?i)^(?:[^/?#]*\.)?{x}\.[^/?#]", (x,), "block", 0) for x in BLOCKED_LABELS]
    segments = [Rule(f"segment {x}", rf"(?i)^[^/?#]*/(?:[^?#]*/)?{x}(?:[/?#]|$)", (x,), "block", 0) for x in BLOCKED_SEGMENTS]
    queries = [Rule(f"query {x}", rf"(?i)^[^?#]*\?(?:[^#]*&)?{x}=", (x,), "block", 0) for x in BLOCKED_QUERIES]
    return [site_rule(*s) for s in sites] + labels + segments + queries


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and host with all that follows it."""
    text = F.coalesce(url, F.lit(""))
    host = ascii_lower(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path, F.concat(host, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*(.*)$", 1))


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(target), "[^a-z0-9]+"))


def rarest(pages: DataFrame, rules: list[Rule]) -> dict[str, list[int]]:
    """token -> numbers of the rules filed under it. One row for each of the rules' tokens at most comes back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counted = pages.select(F.explode(url_tokens(F.col("__target"))).alias("token")).where(F.col("token").isin(wanted)).groupBy("token").count()
    often = {r["token"]: r["count"] for r in counted.collect()}
    index: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (often.get(t, 0), t)), []).append(k)
    return index


def judge(pages: DataFrame, rules: list[Rule] | None = None, inline_rules: int = INLINE_RULES) -> DataFrame:
    """pages(page_id, url) with host, path, the site rule that decides (or null) and the verdict."""
    rules = default_rules() if rules is None else rules
    if not all(r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    host, path, target = parts(F.col("url"))
    seen = pages.select("page_id", "url", host.alias("host"), path.alias("path"), target.alias("__target"))
    index = rarest(seen, rules)
    if len(rules) <= inline_rules:
        judged = seen.withColumn("__best", inline(rules, index)) if rules else seen.withColumn("__best", F.lit(None).cast("struct<rank:int,block:boolean,name:string>"))
    else:
        urls = seen.select("__target").distinct()
        judged = seen.join(joined(urls, rules, index), "__target", "left")
    rule = F.when(F.col("__best.rank") > 0, F.col("__best.name"))
    verdict = F.when(F.coalesce(F.col("__best.block"), F.lit(False)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def row_of(r: Rule) -> tuple:
    return r.rank, r.verdict == "block", r.name


def inline(rules: list[Rule], index: dict[str, list[int]]) -> Column:
    """The best rule of a row: candidates from a literal map of the index, then their expressions."""
    filed = F.create_map(*[x for t, ks in index.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))])
    told = F.array(*[F.struct(F.lit(r.rank).alias("rank"), F.lit(r.verdict == "block").alias("block"), F.lit(r.name).alias("name")) for r in rules])
    patterns = F.array(*[F.lit(r.pattern) for r in rules])
    known = F.array(*map(F.lit, index))
    fetched = F.flatten(F.transform(F.array_intersect(url_tokens(F.col("__target")), known), lambda t: F.element_at(filed, t)))
    hits = F.filter(fetched, lambda k: F.regexp_like(F.col("__target"), F.element_at(patterns, k + 1)))
    return F.array_max(F.transform(hits, lambda k: F.element_at(told, k + 1)))


def joined(urls: DataFrame, rules: list[Rule], index: dict[str, list[int]]) -> DataFrame:
    """The best rule of each distinct url, through a table of the index."""
    rows = [(t, rules[k].pattern, *row_of(rules[k])) for t, ks in index.items() for k in ks]
    filed = urls.sparkSession.createDataFrame(rows, "token string, pattern string, rank int, block boolean, name string")
    fetched = urls.select("__target", F.explode(url_tokens(F.col("__target"))).alias("token")).join(filed, "token")
    hits = fetched.where(F.regexp_like("__target", F.col("pattern")))
    return hits.groupBy("__target").agg(F.max(F.struct("rank", "block", "name")).alias("__best"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def sql() -> str:
    """The same judgement without an index: every rule is tried on every url."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in SITE_RULES]
    case = lambda value: "CASE " + " ".join(f"WHEN {c} THEN '{value(n, v)}'" for c, n, v in sorted(fits, key=lambda x: -len(x[1])))
    blocked = " OR ".join(f"regexp_matches(target, '{r.pattern}')" for r in default_rules() if not r.rank)
    split = r"""SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(.*)$', 1) AS rest FROM pages"""
    return f"WITH p AS (SELECT *, host || rest AS target FROM ({split})) SELECT page_id, host, path, {case(lambda n, v: n)} END AS rule, {case(lambda n, v: v)} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM p"
