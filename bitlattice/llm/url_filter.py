"""URL filter with redirect equivalence, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut
from .components import connected_components

#: Rules of the query: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host_of(url: Column) -> Column:
    """What follows the first '://' up to / ? # or the end, A-Z lower-cased; '' without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _SPLIT, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; '' without '://'."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def address(url: Column) -> Column:
    """The url as a node of the redirect graph: no fragment, host in lower case; null without host."""
    scheme = ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), path_of(url), F.regexp_extract(url, _SPLIT, 3)))


def without_dots(path: Column) -> Column:
    """A path from / without its . and .. steps."""
    steps = F.split(path, "/")
    steps = F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0)))
    step = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), step)
    folder = F.when(path.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(F.concat(kept, folder), "/"))).otherwise(path)


def resolve(url: Column, to: Column) -> Column:
    """A target as found on the page of a url: absolute, or relative to its scheme, host, folder or path."""
    root, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    own, tail = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"(?s)^/(.*/)", 1))
    full = F.when(own == "", path).when(own.startswith("/"), without_dots(own)).otherwise(without_dots(F.concat(folder, own)))
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    return F.when(to.startswith("//"), F.concat(scheme, to)).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), to).otherwise(F.concat(root, full, tail))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): each page's address and that of its canonical link or its meta-refresh target, which
    may be relative."""
    html = F.col("html")
    canonical = F.regexp_extract(html, r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(html, r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*[\"'][^\"'>]*?\burl\s*=\s*([^\"'\s>]+)", 1)
    # A cheap test before each expression keeps most pages from being scanned by it.
    canonical = F.when(F.lower(html).contains("canonical"), canonical)
    refresh = F.when(F.lower(html).contains("http-equiv"), refresh)
    found = pages.select("url", F.explode(F.filter(F.array(canonical, refresh), lambda x: x.isNotNull() & (x != ""))).alias("to"))
    to = resolve(F.col("url"), F.replace("to", F.lit("&amp;"), F.lit("&")))
    return found.select(address(F.col("url")).alias("a"), address(to).alias("b")).where("a <> b")


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """df (with host and path) plus rule and rule_verdict of the longest rule that fits, else null.
    The rules are a list that the caller holds, so they stand in the expression: nothing is joined,
    and the pages of a common host don't meet."""
    table = F.array(*(F.struct(F.lit(-len(h + p)).alias("n"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"), F.lit(h).alias("domain"), F.lit(p).alias("path")) for h, p, v in rules))
    host, path = F.col("host"), F.col("path")
    fits = lambda r: ((host == r["domain"]) | F.endswith(host, F.concat(F.lit("."), r["domain"]))) & F.startswith(path, r["path"])
    fit = F.array_min(F.filter(table, fits)) if rules else F.lit(None).cast("struct<verdict:string,rule:string>")
    return df.withColumn("_fit", fit).withColumn("rule", F.col("_fit.rule")).withColumn("rule_verdict", F.col("_fit.verdict")).drop("_fit")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict ('allow' or 'block'), component.

    A page with a rule of its own has that rule's verdict. Any other page has that of the urls it
    is equivalent to by redirects and canonical links (edges a, b of addresses; by default those
    found in the html): allow if one of them is explicitly allowed, else block if one is blocked,
    else allow. Targets that are no pages count too. Rules are a list given by the caller; of rules
    of equal length on one url, allow wins.

    Null urls or urls without '://' have empty host and path, no rule and are allowed; null html
    has no links; repeated rows are judged alike; an empty table gives no rows; other columns are
    ignored.
    """
    edges = cut(link_edges(pages) if edges is None else edges.select("a", "b"), "links")
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("node"))
    base = with_rule(base, rules)
    if edges.isEmpty():
        out = base.withColumn("component", F.col("node")).withColumn("spread", F.lit(None).cast("string"))
    else:
        member = connected_components(edges)
        judged = with_rule(member.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules)
        spread = F.when(F.max(F.col("rule_verdict") == "allow"), "allow").when(F.max(F.col("rule_verdict") == "block"), "block")
        spread = judged.groupBy("component").agg(spread.alias("spread"))
        out = base.join(member.join(spread, "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    verdict = F.coalesce("rule_verdict", "spread", F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")
