"""URL allow and block rules with redirect equivalence, in DataFrame operations only.

A page's own verdict is the longest rule that fits its host (or a parent domain) and path. Pages without a rule take
the verdict of their aliases: addresses joined by redirects (a refresh in the page) and canonical links form connected
components, and a component that holds an explicitly allowed page is allowed, else one that holds a blocked page is
blocked, else the default holds.

Rules are matched once for each distinct host and path, by an equality join on the host's parent domains, so a host with
a third of all pages costs what its distinct paths cost. The rule table is broadcast only while its counted rows stay
under BROADCAST_RULES; beyond that the join is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import ascii_lower, materialize
from strideline.llm.components import connected_components

#: Rules (hosts and paths of at most a few KB) that may be broadcast.
BROADCAST_RULES = 10_000
_AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _AFTER_SCHEME, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, _AFTER_SCHEME, 2), F.lit(""))


def address(url: Column) -> Column:
    """What two spellings of one address share: scheme and host in lower case, no fragment."""
    plain = F.regexp_replace(url, "(?s)#.*$", "")
    return F.concat(ascii_lower(F.regexp_extract(plain, "(?s)^(.*?://[^/?]*)", 1)), F.regexp_replace(plain, "(?s)^.*?://[^/?]*", ""))


def resolve(base: Column, link: Column) -> Column:
    """A link of a page as an address: absolute, scheme-relative, host-relative or beside the page."""
    root = F.regexp_extract(base, "(?s)^(.*?://[^/?]*)", 1)
    scheme = F.regexp_extract(base, "(?s)^(.*?:)//", 1)
    folder = F.concat(root, F.when(F.regexp_extract(base, "(?s)^.*?://[^/?]*([^?]*/)", 1) == "", F.lit("/")).otherwise(F.regexp_extract(base, "(?s)^.*?://[^/?]*([^?]*/)", 1)))
    whole = F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))
    return address(whole)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """a, b: addresses that redirects (meta refresh) and canonical links of the pages declare to be one."""
    body = F.col(html)
    some = pages.where(F.col(url).contains("://") & (ascii_lower(body).contains("canonical") | ascii_lower(body).contains("refresh")))
    tags = F.regexp_extract_all(body, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    tag = F.col("tag")
    quoted = lambda name: F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']?([^"'>\s]+)""", 1)
    canonical = F.when(tag.rlike(r"""(?is)\brel\s*=\s*["']?canonical\b"""), quoted("href"))
    refresh = F.when(tag.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract(tag, r"""(?is)\burl\s*=\s*["']?([^"'>\s]+)""", 1))
    found = some.select(address(F.col(url)).alias("a"), F.explode(tags).alias("tag")).select("a", F.coalesce(canonical, refresh).alias("link"))
    return found.where("link <> ''").select("a", resolve(F.col("a"), F.regexp_replace("link", "&amp;", "&")).alias("b"))


def match(places: DataFrame, rules: DataFrame) -> DataFrame:
    """places (host, path, each pair once) with rule and own, the longest fitting rule and its verdict; pairs that none fits are left out.

    rules has host, path and verdict. Of two rules of one length for one place, the allowing one holds, then the one
    that sorts first.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    named = rules.select(F.col("host").alias("domain"), F.col("path").alias("prefix"), F.col("verdict").alias("own"), F.concat("host", "path").alias("rule")).distinct()
    if named.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        named = F.broadcast(named)
    fits = places.where("host <> ''").select("host", "path", F.explode(parents).alias("domain")).join(named, "domain").where(F.col("path").startswith(F.col("prefix")))
    best = F.min(F.struct((-F.length("rule")).alias("size"), F.col("own").alias("own"), F.col("rule").alias("rule")))  # 'allow' sorts before 'block'
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.own").alias("own"))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", *, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and cause (rule, alias or default) for every page.

    A null url, or one without ://, has an empty host and path, fits no rule and has no aliases. Null html has no
    links. Repeated rows and null ids are judged row by row; extra columns are ignored; no pages give no rows, no rules
    the default throughout.
    """
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    placed = named.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.when(F.col("url").contains("://"), address(F.col("url"))).alias("address"))
    own, _ = materialize(match(placed.select("host", "path").distinct(), rules), "rules")
    judged = placed.join(own.hint("merge"), ["host", "path"], "left")  # grows with the pages

    found = connected_components(links(named))
    nodes, _ = materialize(found.select(F.col("node").alias("address"), "component"), "aliases")
    if nodes.isEmpty():  # then only equal addresses are aliases, and those have equal hosts and paths
        alias = F.lit(None).cast("string")
        out = judged
    else:
        known = judged.where("own is not null and address is not null").select("address", "own").distinct()
        votes = known.join(nodes.hint("merge"), "address").groupBy("component").agg(F.min("own").alias("alias"))  # an explicit allow comes first
        votes, _ = materialize(nodes.join(votes.hint("merge"), "component").select("address", "alias"), "votes")
        out, alias = judged.join(votes.hint("merge"), "address", "left"), F.col("alias")
    verdict = F.coalesce("own", alias, F.lit(default))
    cause = F.when(F.col("own").isNotNull(), "rule").when(alias.isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), cause.alias("cause"))
