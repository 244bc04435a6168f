"""URL filters with redirect equivalence: host and path rules decide, and pages that no rule decides
take the decision of the pages that redirect or canonical links tie them to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.components import components

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(url: Column) -> Column:
    """The address that copies of a page share: no scheme, query, fragment, 'www.' or 'm.', no
    closing slash and no '.html'."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    return F.concat(F.lit("//"), host, F.regexp_replace(path_of(url), r"(?:\.html?)?/*$", ""))


def _absolute(link: Column, url: Column) -> Column:
    """A link of a page as a whole url; links relative to the folder count from the host."""
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    return (F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(F.lit("http:"), link))
            .otherwise(F.concat(site, F.when(link.startswith("/"), link).otherwise(F.concat(F.lit("/"), link)))))


def link_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between the addresses of pages(url, html) and the canonical links and redirects they
    declare, plus redirects(from_url, to_url) if given, plus each url to its canonical form."""
    url = F.col("url")
    html = F.coalesce("html", F.lit("")) if "html" in pages.columns else F.lit("")
    link = F.when(html.contains("canonical"), F.regexp_extract(html, _CANONICAL, 1)).otherwise("")
    jump = F.when(F.lower(html).contains("refresh"), F.regexp_extract(html, _REFRESH, 1)).otherwise("")
    whole = pages.where(url.contains("://")).select("url", F.filter(F.array(link, jump), lambda x: x != "").alias("links"))
    edges = whole.select(F.col("url").alias("a"), canonical(url).alias("b")).unionByName(
        whole.select("url", F.explode("links").alias("link"))
        .select(F.col("url").alias("a"), canonical(_absolute(F.col("link"), url)).alias("b")))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("from_url").alias("a"), canonical(F.col("to_url")).alias("b")))
        edges = edges.unionByName(redirects.select(canonical(F.col("from_url")).alias("a"), canonical(F.col("to_url")).alias("b")))
    return edges.distinct()


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """A row for each row of pages(page_id, url[, html]): host, path, rule, verdict.

    A page that no rule fits is blocked if a rule blocks another address of its component and none
    allows one; else it is allowed. A null url, or one without '://', has an empty host and path, no
    rule and no edges, and is allowed. Repeated rows get the same verdict; other columns are ignored."""
    url = F.coalesce("url", F.lit(""))
    base = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    member = components(link_edges(pages, redirects))
    node_rule = rule_of(host_of(F.concat(F.lit("http:"), F.regexp_replace("node", r"(?s)^[^/]*//", "//"))),
                        path_of(F.concat(F.lit("http:"), F.regexp_replace("node", r"(?s)^[^/]*//", "//"))), rules)
    ruled = member.withColumn("v", node_rule["verdict"])
    decided = ruled.groupBy("component").agg(F.max((F.col("v") == "block").cast("int")).alias("blocks"),
                                             F.max((F.col("v") == "allow").cast("int")).alias("allows"))
    blocked = decided.where((F.col("blocks") == 1) & F.coalesce(F.col("allows") == 0, F.lit(True)))
    blocked = member.join(blocked, "component").select(F.col("node").alias("_url")).distinct()
    joined = base.join(blocked, base["url"] == blocked["_url"], "left")
    own = F.when(F.col("_url").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("_r.rule").alias("rule"),
                         F.coalesce(F.col("_r.verdict"), own).alias("verdict"))
