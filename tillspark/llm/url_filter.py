"""URL rules, and redirect equivalence for the urls that no rule fits.

A rule fits its host and all subdomains where the path starts with its path; the longest rule wins and settles the page. Aliases
of a page are found in two ways. Urls that servers redirect to each other by custom have one key: the scheme, the fragment, default
ports, a slash at the end and tracking parameters make no difference. Keys are linked where a page names another url as its
canonical one, or sends its reader there by a refresh. Connected components over these links are the classes of equivalent urls.

A page without a rule is blocked if its class has a page that a rule blocks, and none that a rule allows: an explicit
allow comes before any block handed on. Otherwise it is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.shared import components
from tillspark.runtime import heavy_keys, materialize, salted_join, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that say where a reader came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: Comments and scripts are passed over; what is left are link and meta tags.
TAGS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|(<(?:link|meta)\b[^>]*>)"
CANONICAL, REFRESH = r"(?i)\brel\s*=\s*[\"']?\s*canonical\b", r"(?i)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
HREF, TARGET = r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or NULL. ``rules`` become part of the plan: some hundreds at most."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def key_of(url: Column) -> Column:
    """The same text for urls that are aliases by custom; NULL for what has no ``://``."""
    rest = _rest(url)
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, query))


def resolve(url: Column, link: Column) -> Column:
    """The url that ``link`` means on the page ``url``; NULL for the page itself and for what is no page. Dots in paths stay."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(url), "(?s)^(.*/)", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), link))
        .when(link.rlike("^/"), F.concat(site, link))
        .when(link.rlike("^#") | link.rlike(SCHEME), F.lit(None).cast("string"))
        .when(link.rlike(r"^\?"), F.concat(site, path_of(url), link))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def links_of(url: Column, html: Column) -> Column:
    """Urls that the page names as its canonical one or sends its reader to."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(TAGS), F.lit(1)), lambda t: t != "")
    named = F.transform(tags, lambda t: F.when(t.rlike(CANONICAL), F.regexp_extract(t, HREF, 1)).when(t.rlike(REFRESH), F.regexp_extract(t, TARGET, 1)))
    return F.filter(F.transform(F.filter(named, lambda n: n != ""), lambda n: resolve(url, n)), lambda u: u.isNotNull())


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict.

    A NULL url, and one without ``://``, has no key, hence no aliases, and is allowed; NULL html has no links. Rows with equal ids or
    urls are all judged. Keys are compared by 128-bit hashes. No rows give no rows.
    """
    def digest(key: Column) -> Column:
        return F.unhex(F.md5(key))

    url = F.col("url")
    with scratch(pages.sparkSession) as job:
        found = pages.select("page_id", "url", "html").withColumns({"host": F.coalesce(host_of(url), F.lit("")), "path": F.coalesce(path_of(url), F.lit(""))})
        found = materialize(found.select(
            "page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("fit"), digest(key_of(url)).alias("key"),
            F.transform(links_of(url, F.col("html")), lambda u: digest(key_of(u))).alias("links"),
        ).select("page_id", "host", "path", "fit.*", "key", "links"))
        edges = found.filter(F.col("key").isNotNull() & (F.size("links") > 0)).select(F.col("key").alias("a"), F.explode("links").alias("b"))
        classes = components(edges.filter("a <> b")).withColumnsRenamed({"id": "key", "component": "class"})
        keys = found.filter(F.col("key").isNotNull()).groupBy("key").agg(
            F.max(F.col("verdict").eqNullSafe("allow")).alias("allow"), F.max(F.col("verdict").eqNullSafe("block")).alias("block"),
            F.max(F.col("verdict").isNull()).alias("open"))
        # One row per key; the members of a class may be many, so the classes are aggregated and joined back spread out.
        keys = materialize(keys.join(classes, "key", "left").withColumn("class", F.coalesce("class", "key")))
        bad = keys.groupBy("class").agg(F.max("allow").alias("allow"), F.max("block").alias("block"), F.max("open").alias("open"))
        bad = materialize(bad.filter("block AND open AND NOT allow").select("class"))
        blocked = materialize(salted_join(keys.filter("open"), bad, ["class"], ["key"], "left_semi").select("key"))
        # Pages settled by a rule need no join; a key may stand on many of the others, above all none.
        open_pages = found.filter(F.col("verdict").isNull())
        heavy = heavy_keys(open_pages.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n")), ["key"], "n")
        named = salted_join(open_pages.filter(F.col("key").isNotNull()), blocked.withColumn("hit", F.lit(True)), ["key"], ["page_id"], "left", heavy=heavy)
        columns = ["page_id", "host", "path", "rule"]
        told = named.select(*columns, F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"))
        plain = found.filter(F.col("verdict").isNotNull() | F.col("key").isNull())
        return job.keep(told.unionByName(plain.select(*columns, F.coalesce("verdict", F.lit("allow")).alias("verdict"))))
