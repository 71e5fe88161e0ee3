"""Fetched pages: addresses, visible text, links and what they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievery.functions import text, url
from sievery.operators.crawl import crawl
from sievery.plans.registry import Registry, Tables
from sievery.sources import connectors, files
from sievery.storage import Workspace

plan = Registry()
QUERIES, SQL = plan.queries, plan.sql

_HOST = "regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)), '^www[.]', '')"
_PATH = "regexp_extract(url, '(?i)^https?://[^/?#]+([^?#]*)', 1)"
_SPACE = r"[ \t\n\x0B\f\r\x{00A0}\x{FEFF}]+"
_LINKS = """unnest(regexp_extract_all(html, '<a[^>]*href="([^"]+)"', 1))"""


def _decoded(sql: str) -> str:
    for name, value in text.ENTITIES:
        sql = "replace({}, '{}', '{}')".format(sql, name, value.replace("'", "''"))
    return sql


def _squeezed(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '{_SPACE}', ' ', 'g'), ' ')"


@plan.query(f"SELECT page_id, {_HOST} AS host, {_PATH} AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query FROM pages")
def url_parts(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", url.host(u).alias("host"), url.path(u).alias("path"), url.query(u).alias("query"))


@plan.query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '(?i)^https?://', ''), '^www[.]', ''), '(?i)/+(?:apply/autofillWithResume)?(?:/apply)?/?$', '') AS u FROM pages)
SELECT page_id, trim(lower(regexp_replace(regexp_replace(u, '[?#].*$', ''), '/+$', '')), ' ') AS fingerprint FROM a
""")
def fingerprint_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", url.fingerprint_url(F.col("url")).alias("fingerprint"))


@plan.query(f"""
WITH p AS (SELECT page_id, {_HOST} AS host, lower({_PATH}) AS p FROM pages)
SELECT page_id, CASE WHEN host = '' THEN 'invalid' WHEN regexp_matches(p, '^/?$') THEN 'home' WHEN regexp_matches(p, '/(?:feed|rss|sitemap)') THEN 'feed'
    WHEN regexp_matches(p, '/(?:search|tag|category)/') THEN 'listing' WHEN regexp_matches(p, '[.]html?$') THEN 'document' WHEN regexp_matches(p, '/[0-9]+/?$') THEN 'item' ELSE 'other' END AS kind
FROM p
""")
def page_type(t: Tables) -> DataFrame:
    return t.pages.select("page_id", url.page_type(F.col("url")).alias("kind"))


_VISIBLE = "regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?i)<br[ ]*/?>|</(?:p|div|li|h[1-6]|tr|ul|ol)>', '. ', 'g')"
_VISIBLE = _squeezed(_decoded(f"regexp_replace({_VISIBLE}, '<[^>]*>', ' ', 'g')"))


@plan.query(f"SELECT page_id, md5(regexp_replace({_VISIBLE}, '(?:[ ]*[.]){{2,}}', '.', 'g')) AS visible FROM pages")
def strip_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(text.strip_html(F.col("html")).cast("binary")).alias("visible"))


_TITLE = _squeezed(_decoded("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')"))


@plan.query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def title_extract(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.first_tag(F.col("html"), "title").alias("title"))


@plan.query(f"SELECT DISTINCT page_id, {_LINKS} AS link FROM pages")
def extract_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(text.links(F.col("html"))).alias("link"))


@plan.query(f"""
WITH l AS (SELECT DISTINCT page_id, {_LINKS} AS link FROM pages)
SELECT {_HOST.replace('url', 'link')} AS host, count(*) AS links, count(DISTINCT page_id) AS pages FROM l GROUP BY 1
""")
def links_by_host(t: Tables) -> DataFrame:
    found = t.pages.select("page_id", F.explode(text.links(F.col("html"))).alias("link"))
    return found.groupBy(url.host(F.col("link")).alias("host")).agg(F.count(F.lit(1)).alias("links"), F.countDistinct("page_id").alias("pages"))


@plan.query(f"""
WITH RECURSIVE l AS (SELECT DISTINCT url AS source, {_LINKS} AS target FROM pages),
r(node, depth) AS (SELECT url, 0 FROM pages WHERE page_id % 10 = 0 UNION SELECT l.target, r.depth + 1 FROM r JOIN l ON l.source = r.node WHERE r.depth < 3)
SELECT node, min(depth) AS depth FROM r GROUP BY node
""")
def crawl_bfs(t: Tables) -> DataFrame:
    """Depth-bounded discovery from every tenth page, the seeds of the crawl."""
    links = t.pages.select(F.col("url").alias("source"), F.explode(text.links(F.col("html"))).alias("target"))
    return crawl(t.pages.where("page_id % 10 = 0").select(F.col("url").alias("node")), links, 3, Workspace(t.spark))


@plan.query("""
WITH p AS (SELECT page_id FROM pages WHERE page_id % 5 <> 0), old AS (SELECT page_id, page_id % 3 = 0 AS same FROM pages WHERE page_id % 4 <> 0)
SELECT coalesce(p.page_id, old.page_id) AS page_id, CASE WHEN p.page_id IS NULL THEN 'delete' WHEN old.same THEN 'skip' ELSE 'write' END AS action FROM p FULL JOIN old ON p.page_id = old.page_id
""")
def page_manifest(t: Tables) -> DataFrame:
    """Pages against the manifest of an earlier run, which lacks some and has other inputs of others."""
    now = t.pages.where("page_id % 5 <> 0")
    before = files.page_manifest(t.pages.where("page_id % 4 <> 0"), t.pages.limit(0).select("page_id", F.lit("").alias("hash")), "page_id", [F.col("url")])
    old = before.select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("hash")).otherwise("changed").alias("hash"))
    return files.page_manifest(now, old, "page_id", [F.col("url")]).select("page_id", "action")


@plan.query("""
WITH p AS (SELECT page_id, url, page_id % 3 + 1 AS n FROM pages), x AS (SELECT page_id, url, unnest(range(n)) AS i FROM p)
SELECT page_id, CAST(page_id * 10 + i AS VARCHAR) AS external_id, 'Job ' || CAST(i AS VARCHAR) AS title, url || '/' || CAST(i AS VARCHAR) AS source_url FROM x
""")
def board_payloads(t: Tables) -> DataFrame:
    """Payloads of a board, built from pages, mapped to the common columns."""
    jobs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("page_id") % 3), lambda i: F.struct((F.col("page_id") * 10 + i).alias("id"), F.concat(F.lit("Job "), i.cast("string")).alias("title"), F.concat(F.col("url"), F.lit("/"), i.cast("string")).alias("absolute_url")))
    payload = t.pages.select("page_id", F.to_json(F.struct(jobs.alias("jobs"))).alias("payload"))
    return connectors.from_json_provider(payload, "greenhouse").select("page_id", "external_id", "title", "source_url")
