"""URL filters: rules on hosts and paths, carried over to aliases of a URL.

A rule (host, path) fits a URL whose host is the rule's or a subdomain of it and
whose path starts with the rule's; of those that fit, the longest written one
wins.  URLs that no rule fits take the verdict of their aliases: redirect and
canonical-link edges are joined into connected components, and a component with
an allowed member is allowed (explicit allow has precedence), one with a blocked
member and no allowed one is blocked, any other is allowed.

Hosts: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased;
paths: from there up to "?", "#" or the end.

Edges are read from the markup: every link tag with canonical among its rel values
and every meta refresh, their targets in any form (absolute, protocol-relative, from
the root, relative, query only, with entities) resolved against the page's URL; and
with forms each URL is also linked to its canonical form (canonical_form), its query
included; that is a guess, which the query doesn't make.

Edge cases: null markup has no links; other schemes (mailto and so on) make no edge; a URL of null or without "://" has an empty host and path, fits no
rule, has no aliases and is allowed; repeated rows are judged each; of two rules
with equal writing and different actions allow wins; no edges or an empty table
work as usual; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.scratch import Cuts

#: (host, path, action)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: how the signs of a URL may be written in markup; the ampersand's comes last
ENTITIES = (("&(quot|#34|#x22);", '"'), ("&(#47|#x2f);", "/"), ("&(#58|#x3a);", ":"), ("&(#63|#x3f);", "?"), ("&(#61|#x3d);", "="), ("&(amp|#38|#x26);", "&"))
LINK_TAG, META_TAG = r"(?i)<link\s[^>]*>", r"(?i)<meta\s[^>]*>"
ATTRIBUTE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"""(?i)\burl\s*=\s*["']?([^"'\s]+)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _tail(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_tail(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_tail(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_form(url: Column) -> Column:
    """host/path?query under which usual variants of one page meet: no scheme, www. or m., fragment, last slash or .html."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/|/index\.html?|\.html?)$", "")
    return F.when(host_of(url) != "", F.concat(host, path, F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)))


def decoded(c: Column) -> Column:
    for written, sign in ENTITIES:
        c = F.regexp_replace(c, f"(?i){written}", sign)
    return c


def without_dots(path: Column) -> Column:
    """A path with its . and .. segments carried out."""
    parts = F.split(path, "/", -1)
    inner, end = F.slice(parts, F.lit(2), F.size(parts) - 1), F.element_at(parts, -1)
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(inner, F.array().cast("array<string>"), step)
    open_end = F.when(end.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), open_end)


def resolved(base: Column, target: Column) -> Column:
    """What a link on the page base leads to: an http(s) URL, or null for other schemes and places on the same page."""
    t = F.trim(decoded(F.regexp_replace(target, r"^[\s]+|[\s]+$", "")))
    origin, here = F.regexp_extract(base, r"^([^:]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([^?#]*)", 1)
    path = path_of(base)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    own, rest = F.regexp_extract(t, r"^([^?#]*)", 1), F.regexp_extract(t, r"^[^?#]*(.*)$", 1)
    there, beyond = F.regexp_extract(t, r"^([^:]*://[^/?#]*)", 1), F.regexp_extract(t, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    flat = lambda p: F.when(p == "", "").otherwise(without_dots(p))
    return (
        F.when((t == "") | t.startswith("#"), None)
        .when(t.rlike("(?i)^https?://"), F.concat(there, flat(beyond), rest))
        .when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(t.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), F.regexp_extract(t, "^(//[^/?#]*)", 1), flat(F.regexp_extract(t, "^//[^/?#]*([^?#]*)", 1)), rest))
        .when(t.startswith("/"), F.concat(origin, without_dots(own), rest))
        .when(t.startswith("?"), F.concat(here, t))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, own)), rest))
    )


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty if the tag has none."""
    return F.concat(*[F.regexp_extract(tag, rf"(?i)[\s\"'/]{name}\s*=\s*{ATTRIBUTE}", g) for g in (1, 2, 3)])


def page_edges(pages: DataFrame, url: str = "url", html: str = "html", forms: bool = False) -> DataFrame:
    """Edges (a, b) between URLs: canonical links and meta refreshes in the markup; with forms also each URL's canonical form, a guess."""
    u, h = F.col(url), F.coalesce(F.col(html), F.lit(""))
    links = F.filter(F.regexp_extract_all(h, F.lit(LINK_TAG), F.lit(0)), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical"))
    metas = F.filter(F.regexp_extract_all(h, F.lit(META_TAG), F.lit(0)), lambda t: F.lower(attribute(t, "http-equiv")) == "refresh")
    to = F.concat(F.transform(links, lambda t: attribute(t, "href")), F.transform(metas, lambda t: F.regexp_extract(attribute(t, "content"), REFRESH, 1)))
    told = F.transform(to, lambda t: resolved(u, t))
    targets = F.array_compact(F.concat(F.array(F.concat(F.lit("canonical:"), canonical_form(u))), told) if forms else told)
    return pages.where(F.instr(u, "://") > 0).select(u.alias("a"), F.explode(targets).alias("b"))


def match_rules(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the rule that wins, or null.  The rules are a short list that goes into the plan."""
    best = F.lit(None).cast("struct<rule:string,action:string>")
    for h, p, action in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(best)
    return best


def filter_urls(pages: DataFrame, edges: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, forms: bool = False) -> DataFrame:
    """(key, host, path, rule, verdict, aliased) of every page; aliased: the verdict came from an alias.

    edges: (a, b) pairs of URLs; without them those of page_edges are taken (forms: see there).
    """
    cuts = Cuts(pages.sparkSession)
    judged = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = judged.withColumn("m", match_rules(F.col("host"), F.col("path"), rules)).select("k", "u", "host", "path", "m.rule", "m.action")
    found = connected_components(page_edges(pages, url, html, forms) if edges is None else edges, cuts)
    # what each component holds: first by URL (an alias outside the table is judged by its own rule too)
    action = match_rules(host_of(F.col("node")), path_of(F.col("node")), rules)["action"]
    held = found.groupBy("component").agg(F.max((action == "allow").cast("int")).alias("allow"), F.max((action == "block").cast("int")).alias("block"))
    held = cuts.cut(held.where("allow = 1 or block = 1"))  # written, so that a large component's rows can be split in the join
    passed = found.join(held, "component").select(F.col("node").alias("u"), F.when(F.col("allow") == 1, "allow").otherwise("block").alias("alias"))
    open_urls = judged.where(F.col("action").isNull())
    verdicts = judged.where(F.col("action").isNotNull()).withColumn("alias", F.lit(None).cast("string")).unionByName(open_urls.join(passed, "u", "left"))
    verdict = F.coalesce("action", "alias", F.lit("allow"))
    return verdicts.select(F.col("k").alias(key), "host", "path", "rule", verdict.alias("verdict"), (F.col("action").isNull() & F.col("alias").isNotNull()).alias("aliased"))
