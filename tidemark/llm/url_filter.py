"""URL rules with redirect equivalence.

A rule (host, path, action) fits its host and all subdomains if the url's path starts with the
rule's path; the longest fitting rule (host and path together; of equally long ones the first in the
list) decides. Where no rule fits, the url takes part in redirect equivalence: redirects and canonical
links found in pages join urls into components; if any url of a component is blocked by a rule, and none
is allowed by one, its members without a rule are blocked too. An explicit allow therefore wins twice:
over shorter block rules of its own url, and over decisions that would arrive through aliases.

Links are ``<link>`` tags with the word canonical in ``rel`` and ``<meta>`` tags with ``http-equiv``
refresh, anywhere in a page but in comments and in elements whose content is text (``TEXT``: scripts, styles,
titles and the like, open ones up to the page's end). A tag ends at the first ``>`` outside a quoted value, so what
looks like a tag or an attribute inside a quoted value is part of that value. Targets are resolved as RFC 3986
says (scheme at the start, ``//``, ``/``, ``?``, relative paths with ``.`` and ``..``) against the first ``<base>`` with
an ``href``, itself resolved against the page's url, or else against the page's url.

Up to ``COMPILED`` rules are part of the plan. More are a table: a url's host gives all its suffixes, and
those are joined with the rules' hosts.

Odd cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed
unless an alias is blocked; its relative links can't be resolved and are none; a null page body has no
links; repeated rows are judged alike, each on its own row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_LOWER, ASCII_UPPER, durable, unused_name
from .components import components

Rule = tuple[str, str, str]
#: (host, path, action)
RULES: tuple[Rule, ...] = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
COMPILED = 200
#: Elements whose content holds no tags.
TEXT = ("script", "style", "title", "textarea", "template", "iframe", "noembed", "noframes", "xmp")
_WS = r"\x20\t\n\r\f"
_HIDDEN = "|".join(["(?is)<!--.*?(?:-->|\\z)", *(rf"<{t}[{_WS}/>].*?(?:</{t}[{_WS}/>]|\z)" for t in TEXT)])
#: A tag; after an equals sign a quoted value is taken whole. Possessive, as long tags must not cost a stack.
_TAG = rf"""<[A-Za-z][^>=]*+(?:=[{_WS}]*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>"""
_ATTRIBUTES = rf"""([^{_WS}"'<>/=]+)[{_WS}]*=[{_WS}]*("[^"]*"|'[^']*'|[^{_WS}"'>]+)"""
_TARGET = rf"""(?i)\burl[{_WS}]*=[{_WS}]*['"]?([^"'>{_WS}]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.substring_index(url, "://", 1)
    tail = F.when(F.instr(url, "://") > 0, url.substr(F.length(rest) + 4, F.length(url)))
    host = F.translate(F.regexp_extract(tail, r"^([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)
    path = F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct (rule, action), or null; ties go to the first in the list."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    # The last one wrapped is tested first: the longest, and of those the first.
    for _, (rule_host, rule_path, action) in sorted(enumerate(rules), key=lambda r: (len(r[1][0] + r[1][1]), -r[0])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def with_rule(rows: DataFrame, rules: Sequence[Rule], compiled: int = COMPILED) -> DataFrame:
    """``rows`` (with host and path) and its ``rule`` and what that ``said``."""
    if len(rules) <= compiled:
        found = unused_name(rows, "found")
        both = rows.withColumn(found, matched_rule(F.col("host"), F.col("path"), rules))
        return both.withColumns({"rule": F.col(found)["rule"], "said": F.col(found)["action"]}).drop(found)
    listed = rows.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rules)], "number long, rule_host string, rule_path string, action string")
    places = rows.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = places.withColumn("suffix", F.explode(suffixes))
    met = each.join(listed, F.col("suffix") == F.col("rule_host")).filter(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(name.alias("rule"), "action"), F.struct(F.length(name), -F.col("number"))).alias("best"))
    best = best.select(F.col("host").alias("best_host"), F.col("path").alias("best_path"), F.col("best")["rule"].alias("rule"), F.col("best")["action"].alias("said"))
    return rows.join(best, (F.col("host") == F.col("best_host")) & (F.col("path") == F.col("best_path")), "left").drop("best_host", "best_path")


def _attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of that name, without its quotes; null where there is none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTES), F.lit(1)), F.lower)
    value = F.try_element_at(F.regexp_extract_all(tag, F.lit(_ATTRIBUTES), F.lit(2)), F.nullif(F.array_position(names, name), F.lit(0)).cast("int"))
    return F.when(value.startswith('"') | value.startswith("'"), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, without the segments ``.`` and ``..``."""
    parts = F.split(path, "/")
    grown = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.lit(""),
        lambda held, x: F.when(x == ".", held).when(x == "..", F.regexp_replace(held, "/[^/]*$", "")).otherwise(F.concat(held, F.lit("/"), x)),
    )
    return F.concat(grown, F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")))


def resolved(base: Column, target: Column) -> Column:
    """``target`` as an absolute url; null if ``base`` has no ``://`` and the target needs it."""
    scheme = F.regexp_extract(base, r"^([^/?#]*:)//", 1)
    root = F.regexp_extract(base, r"^([^/?#]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^/?#]*://[^/?#]*([^?#]*)", 1)
    own, tail = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(root == "", F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(root, _without_dots(own), tail))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when(target.startswith("#") | (target == ""), base)
        .otherwise(F.concat(root, _without_dots(F.concat(folder, own)), tail))
    )


def _address(value: Column) -> Column:
    return F.trim(F.replace(value, F.lit("&amp;"), F.lit("&")))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's url and each url its canonical links and refreshes name."""
    called = lambda tag, *names: tag.rlike(f"(?i)^<(?:{'|'.join(names)})[{_WS}/]")
    shown = F.regexp_replace(F.col(html), _HIDDEN, " ")
    tags = F.filter(F.regexp_extract_all(shown, F.lit(_TAG), F.lit(0)), lambda t: called(t, "link", "meta", "base"))
    # A page without either word can't name another one; most pages' tags are then not listed.
    may = F.col(url).isNotNull() & F.col(html).rlike("(?i)canonical|refresh")
    found = pages.filter(may).select(F.col(url).alias("a"), tags.alias("tags")).filter(F.size("tags") > 0)
    bases = F.filter(F.transform(F.filter("tags", lambda t: called(t, "base")), lambda t: _address(_attribute(t, "href"))), lambda h: h.isNotNull())
    based = found.withColumn("first", F.try_element_at(bases, F.lit(1)))
    base = F.when(F.coalesce(F.col("first"), F.lit("")) == "", F.col("a")).otherwise(F.coalesce(resolved(F.col("a"), F.col("first")), F.col("a")))
    each = based.select("a", base.alias("base"), F.explode("tags").alias("tag"))
    words = F.split(F.lower(_attribute(F.col("tag"), "rel")), rf"[{_WS}]+")
    canonical = called(F.col("tag"), "link") & F.array_contains(words, "canonical")
    refresh = called(F.col("tag"), "meta") & (F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh")
    named = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, F.regexp_extract(_attribute(F.col("tag"), "content"), _TARGET, 1))
    return each.select("a", "base", _address(named).alias("t")).filter("t <> ''").select("a", resolved(F.col("base"), F.col("t")).alias("b")).filter("b is not null")


def url_key(url: Column) -> Column:
    """Urls that differ only in the fragment or the case of the host are one node."""
    host, _ = host_and_path(url)
    start = F.regexp_extract(url, r"^([^/?#]*://)", 1)
    tail = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*([^#]*)", 1)
    return F.when(start == "", url).otherwise(F.concat(start, host, tail))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str | None = "html", compiled: int = COMPILED) -> DataFrame:
    """(page_id, host, path, rule, verdict, component): a row for each page.

    ``redirects`` (a, b) adds known redirects to the links found in the pages.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumn("host", host).withColumn("path", path)
    own = with_rule(own, rules, compiled)

    edges = link_edges(pages, url, html) if html is not None else None
    if redirects is not None:
        extra = redirects.select(F.col("a"), F.col("b"))
        edges = extra if edges is None else edges.unionByName(extra)
    if edges is None:
        return own.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    edges = durable(edges.select(url_key(F.col("a")).alias("a"), url_key(F.col("b")).alias("b")).distinct(), "links")
    member = components(edges)
    # The decisions of a component come from every url in it, also from those that are not pages.
    host, path = host_and_path(F.col("node"))
    ruled = with_rule(member.withColumn("host", host).withColumn("path", path), rules, compiled)
    decided = ruled.groupBy("component").agg(F.max((F.col("said") == "block").cast("int")).alias("blocked"), F.max((F.col("said") == "allow").cast("int")).alias("allowed"))
    spread = member.join(decided, "component").select(F.col("node").alias("key"), "component", ((F.coalesce("blocked", F.lit(0)) == 1) & (F.coalesce("allowed", F.lit(0)) == 0)).alias("by_alias"))
    joined = own.withColumn("key", url_key(F.col("url"))).join(spread, "key", "left")
    final = F.coalesce("said", F.when(F.col("by_alias"), F.lit("block")), F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", final.alias("verdict"), "component")
