"""URL filters with redirect equivalence, with DataFrame operations only.

Rules allow or block a host with its subdomains, from a path prefix on; the longest rule that fits decides a URL.
A URL that no rule fits takes the decision of its aliases: redirects (meta refresh) and canonical links are the edges,
connected components the classes of equivalent URLs. A class with an allowed member is allowed, else one with a blocked
member is blocked, else it is allowed by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm._common import Workspace, small_side, table
from grainmill.llm.graph import connected_components

#: Up to so many rules stand in the plan as one array; more are joined on the host's suffixes.
INLINE_RULES = 256

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL as a node: scheme and host in lower case, an empty path as `/`, no fragment. Null without a host."""
    place = r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)/?([^#]*).*$"
    return F.when(url.rlike(place), F.concat(F.lower(F.regexp_replace(url, place, "$1://$2")), F.lit("/"), F.regexp_extract(url, place, 3)))


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, without its quotes; empty if it has none."""
    return F.regexp_replace(F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), "^[\"']|[\"']$", "")


def _absolute(links: DataFrame) -> DataFrame:
    """links(url, target) with target as an absolute URL, seen from url; targets that are empty go."""
    links = links.withColumn("target", F.replace(F.trim("target"), F.lit("&amp;"), F.lit("&"))).where("target <> ''")
    links = links.withColumn("scheme", F.regexp_extract("url", r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1)).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    root = F.concat("scheme", F.lit("://"), "host")
    target = (
        F.when(F.col("target").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("target"))
        .when(F.startswith("target", F.lit("//")), F.concat("scheme", F.lit(":"), "target"))
        .when(F.startswith("target", F.lit("/")), F.concat(root, "target"))
        .when(F.col("target").rlike("^[?#]"), F.concat(root, "path", "target"))
        .otherwise(F.concat(root, F.regexp_replace("path", r"[^/]*$", ""), F.when(F.col("path") == "", "/").otherwise(""), "target"))
    )
    return links.select("url", target.alias("target"))


def alias_edges(pages: DataFrame, work: Workspace) -> DataFrame:
    """Edges (a, b) of equivalent URLs: from each page to the targets of its canonical links and meta refreshes.

    The links are written before they are resolved: as one expression, the two would be too long to compile.
    """
    marked = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.regexp_replace("html", r"(?s)<!--.*?-->", "").alias("html"))
    tags = marked.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    tags = tags.select("url", "tag", F.lower(_attribute(F.col("tag"), "rel")).alias("rel"), F.lower(_attribute(F.col("tag"), "http-equiv")).alias("equiv"))
    links = tags.where(F.col("rel").rlike(r"(^|\s)canonical(\s|$)")).select("url", _attribute(F.col("tag"), "href").alias("target"))
    metas = tags.where("equiv = 'refresh'").select("url", _attribute(F.col("tag"), "content").alias("content"))
    metas = metas.select("url", F.regexp_extract("content", r"""(?is)url\s*=\s*['"]?([^'"]+)""", 1).alias("target"))
    both = work.stored(_absolute(work.stored(links.union(metas), "links")), "targets")
    return both.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def _rank(rule: Column) -> Column:
    return F.struct(F.char_length(F.concat(rule["host"], rule["path"])).alias("n"), (rule["verdict"] == "allow").alias("allows"), F.concat(rule["host"], rule["path"]).alias("rule"), rule["verdict"].alias("verdict"))


def rule_of(urls: DataFrame, rules: DataFrame | list[tuple[str, str, str]]) -> DataFrame:
    """urls(host, path, ...) with best: the struct (n, allows, rule, verdict) of the longest rule that fits, or null.

    Of equally long rules one that allows wins. A list of up to INLINE_RULES rules is one expression, without a join;
    other rules are a table (host, path, verdict), joined on the suffixes of the distinct (host, path).
    """
    if isinstance(rules, list) and len(rules) <= INLINE_RULES:
        if not rules:
            return urls.withColumn("best", F.lit(None).cast("struct<n:int,allows:boolean,rule:string,verdict:string>"))
        stated = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
        fitting = F.filter(stated, lambda r: _fits(F.col("host"), F.col("path"), r["host"], r["path"]))
        return urls.withColumn("best", F.array_max(F.transform(fitting, _rank)))
    if isinstance(rules, list):
        rules = urls.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    rules = rules.select(F.col("host").alias("_h"), F.struct("host", "path", "verdict").alias("_r"))
    places = urls.select("host", "path").distinct()
    labels = F.split(F.col("host"), r"\.")
    ends = places.withColumn("_h", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))))
    found = ends.join(rules, "_h").where(F.startswith(F.col("path"), F.col("_r.path"))).groupBy("host", "path").agg(F.max(_rank(F.col("_r"))).alias("best"))
    found = found.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best")
    return urls.join(found, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").drop("_host", "_path")


def filter_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, reason, one row for each row of pages(page_id, url, html).

    reason: rule, alias or default. edges(a, b) adds known redirects between URLs to those that the pages state.
    A null url, or one without `://`, has empty host and path, no rule and no alias. Null html states no edge.
    """
    work = Workspace(pages.sparkSession)
    stated = alias_edges(pages, work)
    if edges is not None:
        stated = stated.union(edges.select(node_of(F.col("a")), node_of(F.col("b"))))
    stated = work.stored(stated.where("a is not null and b is not null and a <> b").distinct(), "edges")
    judged = rule_of(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    rule, explicit = F.col("best.rule").alias("rule"), F.col("best.verdict")
    if stated.isEmpty():
        alias = F.lit(None).cast("string")
    else:
        groups = work.stored(connected_components(stated, work), "classes")
        members = rule_of(groups.select("node", "root", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules)
        # Each alias weighs as often as any: least of "allow" < "block", null without a rule.
        decided = members.groupBy("root").agg(F.min("best.verdict").alias("decision")).where("decision is not null")
        classes = groups.join(decided, "root").select(F.col("node").alias("_node"), "decision")
        n = classes.count()
        judged = judged.join(small_side(classes, n, 200), node_of(F.col("url")) == F.col("_node"), "left")
        alias = F.col("decision")
    verdict = F.coalesce(explicit, alias, F.lit("allow")).alias("verdict")
    reason = F.when(explicit.isNotNull(), "rule").when(alias.isNotNull(), "alias").otherwise("default").alias("reason")
    return judged.select("page_id", "url", "host", "path", rule, verdict, reason)


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


#: Without aliases, which no page of the tables has, the verdict is the rule's or allow.
OP4_SQL = r"""
with rules(rh, rp, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
      coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path from pages),
j as (select u.*, (select max({'n': length(rh || rp), 'rule': rh || rp, 'v': v}) from rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) best from u)
select page_id, host, path, best.rule as rule, coalesce(best.v, 'allow') verdict from j
"""
