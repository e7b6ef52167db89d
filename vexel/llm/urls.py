"""URL filters: explicit rules, then redirect equivalence.

Explicit rules (host, path prefix) decide where one fits, the longest first. The other pages take part in redirect
equivalence: redirects (``<meta http-equiv=refresh>``), canonical links and any further pairs given are edges between URLs,
and the URLs of a connected component are aliases. A component in which a rule blocks a URL blocks its undecided
aliases, unless a rule allows a URL of the component: an explicit allow has precedence. What stays undecided is allowed.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule, has no aliases and is allowed. URLs
that differ only in their fragment are one URL. Pages that repeat an id or a URL keep their rows. Null html has no edges. Links
are resolved against the URL of their page (``<base>`` is not read), after HTML entities are decoded.
"""

from __future__ import annotations

import html
import re
import string
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, text_batches, write_table


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    after = F.substr(url, F.instr(url, "://") + 3)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)?", 1)).otherwise("")


def fits(rule: UrlRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def explicit(rules: tuple[UrlRule, ...], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A literal CASE: no join."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.host) - len(r.path), r.host, r.path)):
        hit = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits(r, host, path), hit) if out is None else out.when(fits(r, host, path), hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def node_of(url: Column) -> Column:
    """A URL without its fragment, its host in lower case; null for what is no URL."""
    cut = F.regexp_extract(url, r"^[^#]*", 0)
    scheme = F.substring_index(cut, "://", 1)
    tail = F.regexp_extract(F.substr(cut, F.instr(cut, "://") + 3), r"^[^/?]*(.*)$", 1)
    return F.when(F.instr(cut, "://") > 0, F.concat(F.lower(scheme), F.lit("://"), host_of(cut), tail))


_CANONICAL = re.compile(r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical(?=[\"'\s/>])[^>]*>")
_REFRESH = re.compile(r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh(?=[\"'\s/>])[^>]*>")
_HREF = re.compile(r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
_URL = re.compile(r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)")
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def resolved(link: str, base: str) -> str | None:
    """The absolute URL of a link found on page ``base``, entities decoded; null for what cannot be read."""
    link = html.unescape(link)
    if _ABSOLUTE.match(link):
        return link
    try:
        return urllib.parse.urljoin(base, link)
    except ValueError:  # a host in broken brackets
        return None


def declared(url: str, page: str) -> list[str]:
    """The targets of all canonical and refresh tags of a page."""
    found = [m for tags, target in ((_CANONICAL, _HREF), (_REFRESH, _URL)) for t in tags.findall(page) if (m := target.search(t))]
    return [x for m in found if (x := resolved(m[1], url))]


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): the canonical and redirect edges that pages declare, between URL nodes. Only pages with such a word go through Python."""
    text_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(u, x) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in declared(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], ["u", "l"])

    some = pages.where(F.col(html_col).rlike("(?i)canonical|refresh") & F.col(url_col).isNotNull())
    links = some.select(F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h")).mapInArrow(run, "u string, l string")
    links = links.select(node_of(F.col("u")).alias("a"), node_of(F.col("l")).alias("b"))
    return links.where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, component). ``redirects``: further edges (from_url, to_url).

    Pages are read once for edges and once for verdicts; only URLs that take part in an edge are shuffled.
    """
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).where("a is not null and b is not null and a <> b"))
    comp = components(edges)
    found = explicit(rules, host_of(F.col("node")), path_of(F.col("node")))
    told = comp.withColumn("v", found.getField("verdict")).groupBy("component").agg(F.max(F.col("v") == "block").alias("blocked"), F.max(F.col("v") == "allow").alias("allowed"))
    alias = write_table(comp.join(told, "component").select("node", "component", (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("alias_block")), "url-aliases")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")), "path": F.coalesce(path_of(F.col("url")), F.lit("")), "node": node_of(F.col("url"))})
    rows = rows.withColumn("own", explicit(rules, F.col("host"), F.col("path")))
    rows = rows.join(alias, "node", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("alias_block"), F.lit("block")), F.lit("allow"))
    return rows.select("id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("component", "node").alias("component"))


#: The same in DuckDB SQL; recursion over the edges that pages declare. Of HTML's entities it decodes ``&amp;``, of ``..`` it resolves
#: up to four in a row.
SQL = r"""
WITH RECURSIVE p0 AS (SELECT page_id, url, html, instr(url, '://') > 0 AS ok, substr(url, instr(url, '://') + 3) AS rest FROM pages),
p AS (
  SELECT page_id, html,
         CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) ELSE '' END AS path,
         CASE WHEN ok THEN split_part(url, '://', 1) END AS scheme, CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^#]*)', 1) END AS tail
  FROM p0),
pn AS (SELECT *, CASE WHEN host IS NOT NULL AND scheme IS NOT NULL THEN lower(scheme) || '://' || host || tail END AS node FROM p),
tags AS (
  SELECT node, scheme, host, path, regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS l
  FROM pn, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical(?:["''\s/][^>]*)?>')) x(t) WHERE node IS NOT NULL
  UNION ALL
  SELECT node, scheme, host, path, regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
  FROM pn, unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh(?:["''\s/][^>]*)?>')) x(t) WHERE node IS NOT NULL),
l1 AS (SELECT * REPLACE (replace(l, '&amp;', '&') AS l) FROM tags WHERE l <> ''),
l2 AS (
  SELECT node, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l WHEN starts_with(l, '//') THEN scheme || ':' || l
                    WHEN starts_with(l, '/') THEN scheme || '://' || host || l WHEN starts_with(l, '?') THEN scheme || '://' || host || path || l
                    WHEN starts_with(l, '#') THEN NULL ELSE scheme || '://' || host || coalesce(nullif(regexp_extract(path, '^.*/'), ''), '/') || l END AS l,
         regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(l, '//') AS whole
  FROM l1),
l3 AS (
  SELECT node, whole, split_part(l, '://', 1) AS s, regexp_extract(substr(l, instr(l, '://') + 3), '^[^/?#]*') AS h,
         regexp_extract(substr(l, instr(l, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS pa, regexp_extract(l, '[?][^#]*') AS q
  FROM l2 WHERE instr(l, '://') > 0),
l4 AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(pa, '/(\./)+', '/', 'g'), '/\.$', '/'),
         '/[^/]+/\.\.(/|$)', '/'), '/[^/]+/\.\.(/|$)', '/'), '/[^/]+/\.\.(/|$)', '/'), '/[^/]+/\.\.(/|$)', '/') AS plain FROM l3),
e AS (
  SELECT node AS a, lower(s) || '://' || translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || CASE WHEN whole THEN pa ELSE regexp_replace(plain, '^(/\.\.)+(/|$)', '/') END || q AS b FROM l4),
b AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT a AS x, a AS y FROM b UNION SELECT r.x, b.b FROM r JOIN b ON r.y = b.a),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (
  SELECT p.page_id, p.host, p.path, p.node, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS own
  FROM pn p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY ALL),
nodes AS (
  SELECT DISTINCT a AS node, regexp_extract(substr(a, instr(a, '://') + 3), '^[^/?#]*') AS host, regexp_extract(substr(a, instr(a, '://') + 3), '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM b),
told AS (
  SELECT node, arg_max(verdict, length(rhost || rpath)) AS own FROM nodes LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY node),
t AS (
  SELECT r.x AS node, bool_or(told.own = 'block') AND NOT coalesce(bool_or(told.own = 'allow'), false) AS alias_block
  FROM r JOIN told ON told.node = r.y GROUP BY r.x)
SELECT u.page_id, host, path, rule, coalesce(own, CASE WHEN t.alias_block THEN 'block' END, 'allow') AS verdict
FROM u LEFT JOIN t USING (node)
"""
