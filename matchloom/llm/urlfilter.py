"""URL filters with redirect equivalence.

Every url gets its host and path and the longest rule that fits it. Redirect (meta refresh) and canonical links of the
pages are edges between urls; connected components of these edges are sets of aliases. A url without a rule of its own
takes the decision of its component: allow if any alias is allowed by a rule, else block if any is blocked, else allow.

A node is a whole url without its scheme and fragment: host, path with its dot segments folded ('/' if empty), and query string. Rules look at host and path
alone. Relative targets are taken against the url of their page, '&amp;' in a tag is '&', and every tag of a page counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components

#: Verdict, host and path of the rules that the query judges by.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
MOST_INLINE_RULES = 500


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty if null or without '://'."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end; empty if null or without '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """From the first '?' after the path up to '#' or the end; empty if null, without '://' or without one."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def _parts(url: Column, prefix: str = "") -> list[Column]:
    return [host_of(url).alias(f"{prefix}host"), path_of(url).alias(f"{prefix}path"), query_of(url).alias(f"{prefix}query")]


def _best(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(len, rule, verdict) of the longest rule that fits, or null."""
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("len"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls (columns host, path) with rule and verdict of the longest fitting rule, null if none fits.

    A short sequence of rules becomes one expression. More rules, or a DataFrame of (verdict, host, path), are joined on every
    suffix of the host at label bounds, and only distinct urls with hits are grouped.
    """
    if not isinstance(rules, DataFrame):
        if not rules:
            return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
        if len(rules) <= MOST_INLINE_RULES:
            best = urls.withColumn("best__", _best(F.col("host"), F.col("path"), rules))
            return best.withColumns({"rule": F.col("best__.rule"), "verdict": F.col("best__.verdict")}).drop("best__")
        rules = urls.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    keyed = rules.select(F.col("verdict").alias("v__"), F.col("host").alias("suffix__"), F.col("path").alias("p__"))
    labels = F.size(F.split("host", r"\."))
    tried = urls.select("host", "path").distinct().withColumn("suffix__", F.explode(F.transform(F.sequence(F.lit(1), labels), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))))
    hits = tried.join(keyed, "suffix__").where("startswith(path, p__)").groupBy("host", "path").agg(F.max(F.struct((F.length("suffix__") + F.length("p__")).alias("len"), F.concat("suffix__", "p__").alias("rule"), F.col("v__").alias("verdict"))).alias("best__"))
    return urls.join(hits, ["host", "path"], "left").withColumns({"rule": F.col("best__.rule"), "verdict": F.col("best__.verdict")}).drop("best__")


_REF = r"""["']?\s*([^"'\s>]+)"""
#: Tags that name another url of a page, which is the group.
TAGS = [
    r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*\bhref\s*=\s*" + _REF,
    r"(?is)<link\b[^>]*\bhref\s*=\s*" + _REF + r"[^>]*\brel\s*=\s*[\"']?canonical\b",
    r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*\burl\s*=\s*" + _REF,
    r"(?is)<meta\b[^>]*\burl\s*=\s*" + _REF + r"[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b",
]


def _targets(html: Column) -> Column:
    """Canonical and refresh targets in a page as they are written."""
    return F.transform(F.array_distinct(F.concat(*(F.regexp_extract_all(html, F.lit(t), F.lit(1)) for t in TAGS))), lambda t: F.replace(t, F.lit("&amp;"), F.lit("&")))


def _absolute(target: Column, host: Column, path: Column, query: Column) -> Column:
    """The target as a whole url, against a page's host, path and query; null for other schemes, such as mailto."""
    at = lambda rest: F.concat(F.lit("http://"), host, rest)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(target.rlike("(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("/")), at(target))
        .when(F.startswith(target, F.lit("?")), at(F.concat(path, target)))
        .when(F.startswith(target, F.lit("#")), at(F.concat(path, query)))
        .when(target.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(at(F.concat(folder, target)))
    )


def _folded(path: Column) -> Column:
    """A path whose '.' segments are left out and whose '..' take the segment before with them."""
    steps = F.slice(F.split(path, "/"), 2, 1 << 30)
    none = F.array().cast("array<string>")
    kept = F.aggregate(steps, none, lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s))))
    last = F.element_at(steps, -1)
    out = F.concat(F.lit("/"), F.array_join(F.concat(kept, F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(none)), "/"))
    return F.when(path.contains("/."), out).otherwise(path)


def _node(host: Column, path: Column, query: Column) -> Column:
    return F.concat(host, F.when(path == "", "/").otherwise(_folded(path)), query)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (host, path, query, to_host, to_path, to_query) that the pages state; pages without such tags cost one scan for two substrings."""
    may = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    own = pages.where(may).select(*_parts(F.col(url)), F.col(html).alias("html")).where("host != ''")
    told = own.select("host", "path", "query", F.explode(_targets(F.col("html"))).alias("to"))
    whole = told.select("host", "path", "query", _absolute(F.col("to"), F.col("host"), F.col("path"), F.col("query")).alias("to"))
    out = whole.select("host", "path", "query", *_parts(F.col("to"), "to_")).where("to_host != ''")
    # a target's dot segments are folded before rules look at it
    return out.withColumn("to_path", _folded(F.col("to_path")))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None, id_column: str = "page_id") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, and via ('rule', 'alias' or 'default').

    pages: id, url and html; redirects: further edges (from_url, to_url), such as a crawler's redirect log. Null urls and urls without '://'
    have an empty host and path, take no part in links, and are allowed by default. Repeated rows give repeated results;
    a page that links to itself or to the same url twice changes nothing; other columns play no part.
    """
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(*_parts(F.col("from_url")), *_parts(F.col("to_url"), "to_")).where("host != '' and to_host != ''"))
    own = pages.select(F.col(id_column), *_parts(F.col("url")))
    judged = ruled(own, rules)
    node = _node(F.col("host"), F.col("path"), F.col("query")).alias("node")
    ends = edges.select("host", "path", "query").union(edges.select("to_host", "to_path", "to_query")).distinct()
    joined = components(edges.select(_node(F.col("host"), F.col("path"), F.col("query")).alias("u"), _node(F.col("to_host"), F.col("to_path"), F.col("to_query")).alias("v")))
    marks = ruled(ends, rules).select(node, "verdict").where("verdict is not null").join(joined, "node")
    verdicts = marks.groupBy("root").agg(F.when(F.max(F.col("verdict") == "allow"), "allow").otherwise("block").alias("alias_verdict"))
    aliases = joined.join(verdicts, "root").select("node", "alias_verdict").distinct()
    out = judged.withColumn("node", node).join(aliases, "node", "left")
    return out.select(
        id_column, "host", "path", "rule", F.coalesce("verdict", "alias_verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("verdict").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default").alias("via"),
    )


def oracle(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """SQL for tables whose pages link by canonical or refresh tags; dot segments are folded on strings."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    tags = " || ".join("regexp_extract_all(html, '{}', 1)".format(t.replace("'", "''")) for t in TAGS)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda u: "coalesce(" + lower.format(f"regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1)") + ", '')"
    path = lambda u: f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    query = lambda u: f"coalesce(regexp_extract({u}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1), '')"
    folded = lambda p: (
        f"CASE WHEN contains({p}, '/.') THEN coalesce(nullif(list_reduce(string_split({p}, '/')[2:], lambda a, s: CASE WHEN s = '.' THEN a WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') "
        f"ELSE a || '/' || s END, ''), '') || CASE WHEN regexp_matches({p}, '/[.]{{1,2}}$') THEN '/' ELSE '' END, '/') ELSE {p} END"
    )
    node = lambda h, p, q: f"{h} || coalesce(nullif({folded(p)}, ''), '/') || {q}"
    return f"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {values}),
own AS (SELECT page_id, {host("url")} AS host, {path("url")} AS path, {query("url")} AS query, html FROM pages),
targets AS (SELECT host, path, query, replace(unnest({tags}), '&amp;', '&') AS t FROM own WHERE host <> ''),
whole AS (SELECT host, path, query, CASE WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') THEN t WHEN t LIKE '//%' THEN 'http:' || t WHEN t LIKE '/%' THEN 'http://' || host || t
  WHEN t LIKE '?%' THEN 'http://' || host || path || t WHEN t LIKE '#%' THEN 'http://' || host || path || query WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL
  ELSE 'http://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || t END AS t FROM targets),
cut AS (SELECT host, path, query, {host("t")} AS to_host, {path("t")} AS raw_path, {query("t")} AS to_query FROM whole WHERE t IS NOT NULL),
edges AS (SELECT host, path, query, to_host, {folded("raw_path")} AS to_path, to_query FROM cut WHERE to_host <> ''),
ends AS (SELECT host, path, query FROM edges UNION SELECT to_host, to_path, to_query FROM edges),
urls AS (SELECT host, path FROM own UNION SELECT host, path FROM ends),
best AS (SELECT u.host, u.path, arg_max(r.verdict, length(r.host || r.path)) AS verdict, arg_max(r.host || r.path, length(r.host || r.path)) AS rule
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.host, u.path),
node_edges AS (SELECT {node("host", "path", "query")} AS u, {node("to_host", "to_path", "to_query")} AS v FROM edges),
both_ways AS (SELECT u, v FROM node_edges UNION SELECT v, u FROM node_edges),
reach(u, v) AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u),
ruled AS (SELECT {node("e.host", "e.path", "e.query")} AS node, b.verdict FROM ends e JOIN best b ON e.host = b.host AND e.path = b.path),
marks AS (SELECT r.u AS node, bool_or(b.verdict = 'allow') AS allowed FROM (SELECT u, v FROM reach UNION SELECT u, u FROM reach) r JOIN ruled b ON b.node = r.v GROUP BY r.u)
SELECT o.page_id, o.host, o.path, b.rule,
  coalesce(b.verdict, CASE WHEN m.allowed THEN 'allow' WHEN NOT m.allowed THEN 'block' END, 'allow') AS verdict,
  CASE WHEN b.verdict IS NOT NULL THEN 'rule' WHEN m.allowed IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM own o LEFT JOIN best b ON o.host = b.host AND o.path = b.path LEFT JOIN marks m ON m.node = {node("o.host", "o.path", "o.query")}"""
