"""URL block and allow rules, spread over redirect and canonical-link equivalence.

A rule is a host and a path prefix (``com/en/``); it fits the host and all its
subdomains, and the longest rule that fits a URL decides it.  URLs that lead to
one another are aliases: a page and its canonical link, a page and the target of
its refresh, and URLs that only differ in what servers redirect away (scheme, a
leading ``www.``, fragment, tracking parameters, an empty query, a last slash).
Links are resolved against the page's URL (RFC 3986); of several canonical links
or refreshes of a page the first counts.  Classes are connected components over
these edges, found on the cluster.  A URL that no rule fits is decided by its class:
allowed if any URL of the class is allowed by a rule, else blocked if any is
blocked, else allowed.

Rules may be a list or a table of any length: a long one is joined by the suffixes
of each distinct host.  A URL or class with very many rows is cut where it is joined
(``spread``).

Defined cases: a null URL or one without ``://`` has an empty host and path, has
no aliases and is allowed; a null html has no links; repeated rows are judged
each, whatever their page_id; an empty table gives no rows; other columns, whatever
their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstat.sources.scratch import stash

from . import spread
from .components import components

Rule = tuple[str, str]  # "allow" or "block", host and path prefix
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longer lists of rules are joined as a table instead of being written out in the plan; both give the same.
INLINE_RULES = 100


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match(h: Column, p: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null; at equal length allow wins, then the greatest rule in byte order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):
        rh, slash, rp = rule.partition("/")
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(slash + rp)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def match_table(rows: DataFrame, rules: DataFrame, h: str = "host", p: str = "path", name: str = "m") -> DataFrame:
    """rows with column ``name``: as ``match`` for a table (verdict, rule) of any length.

    Every distinct host gets the rules of all its suffixes by an equi-join, the longest first; a row takes the first that its path begins with.
    """
    hosts = stash(rows.groupBy(F.col(h).alias("_host")).agg(F.count("*").alias("n")), "hosts")
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cut = F.instr("rule", "/")
    parts = rules.select("verdict", "rule", F.when(cut > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")).alias("suffix"), F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("prefix"))
    fits = hosts.select("_host", F.explode(suffixes).alias("suffix")).join(parts, "suffix")
    best = F.struct(F.length("rule").alias("a"), (F.col("verdict") == "allow").alias("b"), "rule", "verdict", "prefix")
    listed = fits.groupBy("_host").agg(F.sort_array(F.collect_list(best), asc=False).alias("_rules"))
    out = spread.join(rows, listed, spread.hot_keys(hosts, ["_host"]).withColumnRenamed("_host", h), [h], F.xxhash64(*rows.columns), "left", ["_host"])
    first = F.filter("_rules", lambda r: F.col(p).startswith(r["prefix"]))
    first = F.when(F.size(first) > 0, first[0])
    return out.withColumn(name, F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))).drop("_rules")


def matched(rows: DataFrame, rules: list[Rule] | DataFrame, name: str = "m") -> DataFrame:
    """rows (with host and path) and ``name``: the rule that decides them, or null."""
    if isinstance(rules, DataFrame):
        return match_table(rows, rules, name=name)
    if len(rules) > INLINE_RULES:
        return match_table(rows, rows.sparkSession.createDataFrame(rules, "verdict string, rule string"), name=name)
    return rows.withColumn(name, match(F.col("host"), F.col("path"), rules))


def alias(url: Column) -> Column:
    """What a URL is after the redirects that need no table; null for what is no URL."""
    u = F.regexp_replace(url, r"(?s)#.*$", "")
    h = F.regexp_replace(host(u), r"^www\.", "")
    query = F.regexp_extract(u, r"(?s)^.*?://[^?]*\?(.*)$", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)")), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(h, F.regexp_replace(path(u), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _without_dots(path_: Column) -> Column:
    """A path without its segments ``.`` and ``..``."""
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(path_, "/"), F.array().cast("array<string>"), step), "/")


def _resolved(base: Column, link: Column) -> Column:
    """The URL that a page's link leads to; null for none, for a place in the page itself and for what is no web address."""
    link = F.trim(F.regexp_replace(link, "&amp;", "&"))
    root, own = F.concat(F.lit("http://"), host(base)), path(base)
    to, tail = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(F.when(own == "", "/").otherwise(own), r"(?s)[^/]*$", "")
    return (
        F.when(F.instr(base, "://") == 0, F.when(F.instr(link, "://") > 0, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("?"), F.concat(root, own, link))
        .when(link.startswith("/"), F.concat(root, _without_dots(to), tail))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, to)), tail))
    )


def canonical_link(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    return F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)


def refresh_target(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)", 1)
    return F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)


def edges(pages: DataFrame) -> DataFrame:
    """(a, b) aliases of a page and of what it links to as itself."""
    u = F.col("url")
    links = F.array(_resolved(u, canonical_link(F.col("html"))), _resolved(u, refresh_target(F.col("html"))))
    marked = pages.filter(F.col("html").rlike(r"(?i)canonical|refresh"))
    out = marked.select(u.alias("url"), F.explode(links).alias("link")).select("url", "link", alias(F.col("url")).alias("a"), alias(F.col("link")).alias("b"))
    return out.filter("a is not null and b is not null and a != b").select("a", "b", "link").distinct()


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, extra_edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; ``extra_edges`` (a, b: URLs) are redirects known otherwise."""
    u = F.col("url")
    found = edges(pages)
    if extra_edges is not None:
        more = extra_edges.select(alias(F.col("a")).alias("a"), alias(F.col("b")).alias("b"), F.col("b").alias("link"))
        back = extra_edges.select(alias(F.col("b")).alias("a"), alias(F.col("a")).alias("b"), F.col("a").alias("link"))
        found = found.unionByName(more).unionByName(back).filter("a is not null and b is not null")
    found = stash(found, "aliases")
    root = stash(components(found), "components")
    judged = matched(pages.select("page_id", host(u).alias("host"), path(u).alias("path"), alias(u).alias("alias")), rules)
    # rule decisions of pages and of linked URLs that are no pages, by URL and then by class
    linked = matched(found.select(F.col("b").alias("alias"), host(F.col("link")).alias("host"), path(F.col("link")).alias("path")), rules)
    said = judged.select("alias", F.lit(1).alias("n"), F.col("m.verdict").alias("v")).unionByName(linked.select("alias", F.lit(0).alias("n"), F.col("m.verdict").alias("v")))
    urls = said.filter("alias is not null").groupBy("alias").agg(F.sum("n").alias("n"), F.min("v").alias("v"))  # allow before block
    urls = urls.join(root.withColumnRenamed("node", "alias"), "alias", "left").withColumn("class", F.coalesce("root", "alias")).drop("root")
    urls = stash(urls, "urls")
    classes = stash(urls.groupBy("class").agg(F.count("*").alias("n"), F.min("v").alias("v")).filter("v is not null"), "classes")
    decided = spread.join(urls.select("alias", "class", "n"), classes.select("class", "v"), spread.hot_keys(classes, ["class"]), ["class"], F.col("alias"))
    # only pages without a rule of their own ask their class
    asks = F.col("m").isNull() & F.col("alias").isNotNull()
    by_class = spread.join(judged.filter(asks), decided.select("alias", "v"), spread.hot_keys(decided, ["alias"]), ["alias"], F.xxhash64("page_id", "host", "path"), "left")
    out = by_class.unionByName(judged.filter(~asks).withColumn("v", F.lit(None).cast("string")))
    return out.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce(F.col("m.verdict"), F.col("v"), F.lit("allow")).alias("verdict"))
