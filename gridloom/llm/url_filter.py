"""URL block and allow rules, propagated over redirects and canonical links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, release, staged, table
from .graph import connected_components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: Tags in which a page names its canonical address or redirects; what marks them, and where they hold the address. Quotes may be double, single or absent.
TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)^<link\b[^>]*\srel\s*=\s*(?:\x22[^\x22]*\bcanonical\b|\x27[^\x27]*\bcanonical\b|canonical[\s/>])"
REFRESH = r"(?is)^<meta\b[^>]*\shttp-equiv\s*=\s*[\x22\x27]?refresh[\x22\x27\s/>]"
HREF, CONTENT = (rf"(?is)\s{name}\s*=\s*(?:\x22([^\x22]*)\x22|\x27([^\x27]*)\x27|([^\s\x22\x27>]+))" for name in ("href", "content"))
WAIT = r"(?is)^\s*[\d.]+\s*[;,]\s*url\s*=\s*[\x22\x27]?([^\x22\x27>\s]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule whose host is the url's or above it and whose path starts the url's; null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow", r.name)):
        # Later, longer rules override; of equal ones, allow does.
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: r.verdict == "allow"):
        out = F.when(rule == r.name, F.lit(r.verdict)).otherwise(out)
    return out


def resolved(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    whole = F.aggregate(F.slice(segments, 2, F.size(segments)), F.lit(""), lambda a, s: F.when(s == ".", a).when(s == "..", F.regexp_replace(a, "/[^/]*$", "")).otherwise(F.concat(a, F.lit("/"), s)))
    return F.when(path.contains("/."), F.concat(whole, F.when(last.isin(".", ".."), "/").otherwise(""))).otherwise(path)


def node_of(url: Column) -> Column:
    """What an address is known by in the graph: host, path (``/`` if empty, dot segments resolved) and query; null without ``://``.

    Scheme and fragment are left out, as they don't tell pages apart.
    """
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    path = resolved(path_of(url))
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def absolute(target: Column, base: Column) -> Column:
    """``target`` as seen from ``base``: whole, without scheme, from the root, or beside the page."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), target))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``(a, b)``: each page's node and every node that it redirects to or names as canonical."""
    html, url = F.col("html"), F.col("url")
    groups = lambda tag, pattern: F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    address = lambda tag: F.when(tag.rlike(CANONICAL), groups(tag, HREF)).when(tag.rlike(REFRESH), F.regexp_extract(groups(tag, CONTENT), WAIT, 1)).otherwise("")
    marked = pages.where(html.rlike(r"(?i)canonical|refresh"))
    found = marked.select("url", F.explode(F.transform(F.regexp_extract_all(html, F.lit(TAGS), F.lit(0)), address)).alias("target")).where("target <> ''")
    target = F.replace(F.trim(F.col("target")), F.lit("&amp;"), F.lit("&"))
    return found.select(node_of(url).alias("a"), node_of(absolute(target, url)).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def filtered(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, component)``, a row for each row of ``pages``.

    A page with a rule has the rule's verdict. Other pages take that of their
    aliases: addresses connected by canonical links and redirects, those in the
    pages' HTML and those of ``redirects (source, target)``. If any alias has
    an explicit allow, they are allowed; else if any is blocked, blocked; else
    allowed. Aliases need not be pages themselves to carry a rule.

    Null urls, and urls without ``://``, have an empty host and path and no
    aliases; null html has no links; repeated rows get a row each; an empty
    table gives no rows; further columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b"))).where("a <> b").distinct()
    links = staged(links, "links")
    parts = staged(connected_components(links), "parts")  # a plain table, so that the joins below can split a large component
    release(links)
    # A node's own host and path are its address, so the rules hold for it too.
    node = F.concat(F.lit("x://"), F.col("node"))
    own = verdict_of(rule_of(host_of(node), path_of(node), rules), rules)
    decided = staged(parts.groupBy("component").agg(F.max(own == "allow").alias("allowed"), F.max(own == "block").alias("blocked")), "decided")
    aliases = parts.join(decided, "component").select("node", "component", F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow").alias("alias_verdict"))
    out = judged.join(aliases, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), "alias_verdict", F.lit("allow")).alias("verdict"), "component")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for the url of every page."""
    return filtered(table(spark, sf_dir, "pages")).drop("component")


def _sql() -> str:
    """The same in SQL: hosts, paths, rules, links and what they reach, all written out anew."""

    def host(u: str) -> str:
        return f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def path(u: str) -> str:
        return f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"

    def node(u: str) -> str:
        dots = f"list_reduce(string_split({path(u)}, '/')[2:], lambda a, s: CASE WHEN s = '.' THEN a WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END, '')"
        clean = f"CASE WHEN contains({path(u)}, '/.') THEN {dots} || CASE WHEN string_split({path(u)}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END ELSE {path(u)} END"
        return f"CASE WHEN contains({u}, '://') THEN {host(u)} || CASE WHEN {clean} = '' THEN '/' ELSE {clean} END || regexp_extract({u}, '(?s)^[^?#]*(\\?[^#]*)', 1) END"

    def rule(h: str, p: str) -> str:
        longest = (("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/"), ("net", "/"))
        return "CASE " + " ".join(f"WHEN ({h} = '{a}' OR ends_with({h}, '.{a}')) AND starts_with({p}, '{b}') THEN '{a}{b}'" for a, b in longest) + " END"

    def groups(pattern: str) -> str:
        return " || ".join(f"regexp_extract(tag, '{pattern}', {k})" for k in (1, 2, 3))

    folder = "regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1)"
    return f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '{TAGS}')) AS tag FROM pages),
named AS (
  SELECT url, CASE WHEN regexp_matches(tag, '{CANONICAL}') THEN {groups(HREF)} WHEN regexp_matches(tag, '{REFRESH}') THEN regexp_extract({groups(CONTENT)}, '{WAIT}', 1) END AS t FROM tags),
targets AS (
  SELECT url, replace(trim(t), '&amp;', '&') AS t FROM named WHERE t <> ''),
whole AS (
  SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t
    WHEN starts_with(t, '?') THEN regexp_extract(url, '(?s)^([^?#]*)', 1) || t
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE CASE WHEN ends_with({folder}, '/') THEN {folder} ELSE {folder} || '/' END || t END AS target
  FROM targets),
links AS (
  SELECT DISTINCT {node('url')} AS a, {node('target')} AS b FROM whole),
edges AS (
  SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(node, other) AS (
  SELECT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
aliased AS (
  SELECT node, bool_or(coalesce(r IN ('example.net/en/', 'org/fr/'), false)) AS allowed, bool_or(coalesce(r IN ('net/', 'example.com/de/'), false)) AS blocked
  FROM (SELECT node, {rule("regexp_extract(other, '(?s)^([^/]*)', 1)", "regexp_extract(other, '(?s)^[^/]*([^?]*)', 1)")} AS r FROM reach) GROUP BY node),
ruled AS (
  SELECT page_id, host, path, node, {rule('host', 'path')} AS rule FROM (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN aliased USING (node)
"""


OP2_SQL = _sql()
