"""Queries over the whole catalogue of rules, with sections of hosts as sites, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, crawl
from ..sources.tables import CRAWLED_SQL, crawled, table
from .crawl import HOST, KO, LINK, NOT_SELF

QUERIES: dict = {}
ORACLES: dict = {}
#: Codes that come from robots files alone.
DERIVED = ("ROBOTS_MISSING", "SITEMAP_NOT_DECLARED", "ROBOTS_NONSTANDARD_UA", "ROBOTS_CDN_MANAGED", "CONTENT_SIGNAL_PRESENT")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def site_of(url: Column) -> Column:
    """The last two labels of a host and the first part of the path."""
    return F.concat(F.regexp_extract(url, r"://(?:[^/]*\.)?([^./]+\.[^./:]+)", 1), F.lit("/"), F.regexp_extract(url, "://[^/]*/([^/?#]*)", 1))


SITE_SQL = r"regexp_extract({0}, '://(?:[^/]*\.)?([^./]+\.[^./:]+)', 1) || '/' || regexp_extract({0}, '://[^/]*/([^/?#]*)', 1)"
#: What is known of a site, from how long its pages are together (b) and how many they are (n); as Spark and as SQL say it.
KNOWN = {
    "complete": "CASE b % 3 WHEN 0 THEN true WHEN 1 THEN false END", "robots_state": "CASE b % 5 WHEN 0 THEN 'unreachable' WHEN 1 THEN 'absent' ELSE 'ok' END", "sitemap_declared": "CAST(b % 2 AS INT)", "sitemaps_live": "CAST(b % 3 AS INT)", "sitemaps_read": "CAST(b % 3 AS INT)",
    "only_in_sitemap": "CAST(b % 4 AS BIGINT)", "only_in_crawl": "CAST(0 AS BIGINT)", "llms_status": "CASE WHEN b % 3 = 0 THEN 200 WHEN b % 3 = 1 THEN 404 END", "probe_404": "CASE WHEN b % 7 < 3 THEN 404 ELSE 200 END", "redirect_hops": "CAST(b % 3 AS INT)",
    "alt_result": "CASE b % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'dns_fail' WHEN 2 THEN 'nonpublic_address' END", "indexability": "CASE b % 4 WHEN 0 THEN 'noindex' WHEN 1 THEN 'unrestricted' WHEN 2 THEN 'unknown' END", "blocked": "b % 3 = 0",
    "hidden_hosts": "CAST(b % 2 AS INT)", "wildcard": "b % 5 = 2", "nonstandard_agents": "CAST(b % 3 AS INT)", "managed": "b % 2 = 0", "content_signals": "CAST(b % 4 AS INT)", "proxied": "b % 6 = 0",
    "over_limit": "b % 2", "foreign_host": "b % 3", "duplicate_urls": "b % 4", "lastmod_invalid": "b % 5", "lastmod_missing": "b % 6", "uniform": "b % 7",
}


def _sites(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    sums = table(spark, sf_dir, "pages").groupBy(site_of(F.col("url")).alias("site")).agg((F.sum(F.coalesce(F.octet_length("html"), F.lit(0))) + shift).alias("b"))
    known = sums.select("site", *[F.expr(e).alias(name) for name, e in KNOWN.items()])
    return known.withColumn("mirrors", F.array(F.struct(F.lit("dev").alias("host"), "indexability", "blocked"))).drop("indexability", "blocked")


def _audit(spark: SparkSession, sf_dir: str, shift: int = 0) -> tuple[DataFrame, DataFrame]:
    sites = _sites(spark, sf_dir, shift)
    facts = catalogue.page_facts(crawl.records(crawled(spark, sf_dir), closed=True), site_of(F.col("url")))
    quality = sites.select("site", *[f.split()[0] for f in catalogue.QUALITY.split(", ")])
    return catalogue.audit(facts, sites, quality), sites


_PAGE = [
    ("NOINDEX", "SEO", "critical", "noindex AND intended"), ("INTENTIONAL_NOINDEX", "SEO", "info", "noindex AND NOT intended"), ("SNIPPET_RESTRICTED", "AEO", "warn", "nosnippet"), ("TITLE_MISSING", "SEO", "critical", "title = ''"),
    ("TITLE_TOO_LONG", "SEO", "info", f"length(title) > CASE WHEN {KO} THEN 30 ELSE 60 END"), ("TITLE_TOO_SHORT", "SEO", "warn", f"title <> '' AND length(title) < CASE WHEN {KO} THEN 10 ELSE 20 END"), ("DESC_MISSING", "SEO", "warn", "description = ''"),
    ("DESC_TOO_LONG", "SEO", "info", "length(description) > 160"), ("DESC_TOO_SHORT", "SEO", "info", "description <> '' AND length(description) < 75"), ("JSONLD_INVALID", "AEO", "warn", "invalid > 0"), ("JSONLD_MISSING", "AEO", "info", "blocks = 0"),
    ("CANONICAL_MISSING", "SEO", "warn", "no_canonical"), ("CANONICAL_NOT_SELF", "SEO", "info", NOT_SELF), ("H1_MISSING", "SEO", "warn", "len(h1) = 0"), ("H1_MULTIPLE", "SEO", "info", "len(h1) > 1"), ("THIN_TEXT", "SEO", "warn", "text_chars < 300"),
    ("LINKS_NOT_IN_HTML", "GEO", "warn", f"is_start AND len(list_filter(links, lambda x: {HOST.format('x')} = {HOST.format('url')})) = 0"), ("SITEMAP_ONLY_PAGES", "GEO", "info", "complete AND NOT linked"),
    ("TITLE_DUPLICATE", "SEO", "warn", "title <> '' AND same_title > 1"), ("DESC_DUPLICATE", "SEO", "warn", "description <> '' AND same_description > 1"),
]
_SITE = [
    ("CRAWL_INCOMPLETE", "SEO", "critical", "NOT complete"), ("ROBOTS_UNREACHABLE", "SEO", "warn", "robots_state = 'unreachable'"), ("ROBOTS_MISSING", "SEO", "warn", "robots_state = 'absent'"), ("SITEMAP_NOT_DECLARED", "SEO", "warn", "robots_state = 'ok' AND sitemap_declared = 0"),
    ("SITEMAP_MISSING", "SEO", "warn", "up AND sitemaps_live = 0"), ("SITEMAP_CRAWL_MISMATCH", "SEO", "warn", "up AND sitemaps_live > 0 AND only_in_sitemap > 0"), ("LLMS_TXT_MISSING", "GEO", "info", "up AND coalesce(llms_status, 0) <> 200"), ("SOFT_404", "SEO", "warn", "up AND probe_404 <> 404"),
    ("REDIRECT_HOPS", "SEO", "info", "up AND redirect_hops > 1"), ("ALT_HOST_UNREACHABLE", "SEO", "warn", "up AND alt_result = 'dns_fail'"), ("ALT_HOST_NONPUBLIC", "SEO", "info", "up AND alt_result = 'nonpublic_address'"), ("MIRROR_NOINDEX", "SEO", "info", "up AND indexability = 'noindex'"),
    ("MIRROR_PRESENT", "SEO", "warn", "up AND coalesce(indexability, '') <> 'noindex' AND blocked"), ("MIRROR_PUBLIC", "SEO", "critical", "up AND indexability = 'unrestricted' AND NOT blocked"), ("MIRROR_INDEXABILITY_UNKNOWN", "SEO", "info", "up AND coalesce(indexability, 'unknown') = 'unknown' AND NOT blocked"),
    ("MIRROR_NONPUBLIC_DNS", "SEO", "info", "up AND hidden_hosts > 0"), ("MIRROR_WILDCARD_DNS", "SEO", "info", "up AND wildcard"), ("NAVER_VERIFY_MISSING", "NEO", "warn", "up"), ("FAQ_MISSING", "AEO", "info", "n > 0 AND faq = 0"), ("ORG_JSONLD_MISSING", "LLMO", "info", "n > 0 AND org = 0"),
    ("ORG_JSONLD_SCATTERED", "LLMO", "info", "org > 1"), ("SITEMAP_LIMIT_EXCEEDED", "SEO", "info", "over_limit > 0"), ("SITEMAP_FOREIGN_HOST", "SEO", "info", "foreign_host > 0"), ("SITEMAP_DUPLICATE_URLS", "SEO", "info", "duplicate_urls > 0"), ("SITEMAP_LASTMOD_INVALID", "SEO", "info", "lastmod_invalid > 0"),
    ("SITEMAP_LASTMOD_MISSING", "SEO", "info", "lastmod_missing > 0"), ("SITEMAP_LASTMOD_UNIFORM", "SEO", "info", "uniform > 0"), ("ROBOTS_NONSTANDARD_UA", "SEO", "info", "nonstandard_agents > 0"), ("ROBOTS_CDN_MANAGED", "GEO", "info", "managed"), ("CONTENT_SIGNAL_PRESENT", "GEO", "info", "content_signals > 0"), ("PROXY_ADDRESS_UNVERIFIED", "SEO", "info", "proxied"),
]


def _findings_sql(shift: int, tag: str) -> str:
    """CTEs s, of sites, and g, of their findings, under names of their own."""
    s, pages, site = f"s{tag}", f"p{tag}", f"m{tag}"
    each = " UNION ALL ".join(f"SELECT site, page_id, url, '{code}' AS code, '{lane}' AS lane, '{severity}' AS severity FROM {pages} WHERE status = 200 AND ({test})" for code, lane, severity, test in _PAGE)
    rules = " UNION ALL ".join(f"SELECT site, '{code}' AS code, '{lane}' AS lane, '{severity}' AS severity FROM {site} WHERE {test}" for code, lane, severity, test in _SITE)
    return f"""{s} AS (SELECT site, {", ".join(f"{e} AS {name}" for name, e in KNOWN.items())} FROM (SELECT {SITE_SQL.format("url")} AS site, sum(coalesce(strlen(html), 0))::BIGINT + {shift} AS b FROM pages GROUP BY 1)),
    {pages} AS (SELECT r.*, s.complete, count(*) OVER (PARTITION BY r.site, r.status = 200, title) AS same_title, count(*) OVER (PARTITION BY r.site, r.status = 200, description) AS same_description FROM r LEFT JOIN {s} s USING (site)),
    f{tag} AS ({each} UNION ALL SELECT site, page_id, url, 'HTTP_ERROR', 'SEO', 'warn' FROM {pages} WHERE status IS NULL OR status >= 400 AND status NOT IN (429, 503) UNION ALL SELECT site, page_id, url, 'HTTP_THROTTLED', 'SEO', 'info' FROM {pages} WHERE status IN (429, 503)),
    sums{tag} AS (SELECT site, count(*) FILTER (status = 200) AS n, count(*) FILTER (status = 200 AND list_contains(types, 'FAQPage')) AS faq, count(*) FILTER (status = 200 AND list_contains(types, 'Organization')) AS org, count(*) FILTER (status = 200 AND text_chars < 300) AS thin, count(*) FILTER (status = 200 AND NOT linked) AS alone FROM r GROUP BY site),
    {site} AS (SELECT *, robots_state <> 'unreachable' AS up FROM (SELECT site, coalesce(n, 0) AS n, coalesce(faq, 0) AS faq, coalesce(org, 0) AS org, s.* EXCLUDE (site) FROM {s} s FULL JOIN sums{tag} USING (site))),
    g{tag} AS (SELECT site, code, lane, CASE WHEN code = 'THIN_TEXT' AND thin > 0.5 * n THEN 'critical' WHEN code = 'SITEMAP_ONLY_PAGES' AND alone >= 0.5 * n THEN 'warn' ELSE severity END AS severity, count(*) AS pages, list(url ORDER BY url, page_id)[1:20] AS urls
        FROM f{tag} JOIN sums{tag} USING (site) GROUP BY ALL UNION ALL SELECT site, code, lane, severity, 0, [] FROM ({rules}))"""


BASE_SQL = f"""WITH {CRAWLED_SQL}, l AS (SELECT {LINK.format("url")} AS own, unnest(links) AS goal, {HOST.format("url")} AS h FROM rec),
    k AS (SELECT DISTINCT {LINK.format("goal")} AS key FROM l WHERE {HOST.format("goal")} = h AND own <> {LINK.format("goal")} UNION SELECT {LINK.format("base")} FROM rec WHERE regexp_matches(url, '^[^:/?#]+://[^/?#]*/?$')),
    r AS (SELECT rec.*, {SITE_SQL.format("url")} AS site, regexp_matches(url, '^[^:/?#]+://[^/?#]*/?$') AS is_start, {LINK.format("url")} IN (SELECT key FROM k) OR {LINK.format("base")} IN (SELECT key FROM k) OR regexp_matches(url, '^[^:/?#]+://[^/?#]*/?$') AS linked FROM rec),
    {_findings_sql(0, "")}"""
BOARD_SQL = """{b} AS (SELECT s.site, place, l.lane, CASE WHEN l.lane = 'reputation' THEN 'na' WHEN min(list_position(['critical', 'warn', 'info'], severity)) = 1 THEN 'bad' WHEN min(list_position(['critical', 'warn', 'info'], severity)) = 2 THEN 'warn'
        WHEN robots_state = 'unreachable' AND l.lane NOT IN ('SEO', 'reputation') THEN 'na' ELSE 'ok' END AS state, count(code) AS findings, coalesce(list_sort(list(code) FILTER (code IS NOT NULL)), []) AS codes,
        CASE WHEN robots_state <> 'unreachable' OR l.lane IN ('SEO', 'reputation') THEN [] WHEN l.lane IN ('AEO', 'LLMO') THEN ['page_content'] ELSE ['crawler_policy'] END AS unassessed
    FROM {s} s, (SELECT unnest(range(7))::INTEGER AS place, unnest(['SEO', 'AEO', 'GEO', 'LLMO', 'NEO', 'KEO', 'reputation']) AS lane) l LEFT JOIN {g} g ON g.site = s.site AND g.lane = l.lane GROUP BY s.site, robots_state, place, l.lane)"""
BOARD = BOARD_SQL.format(b="b", s="s", g="g")


@query(f"{BASE_SQL} SELECT site, code, lane, severity, pages, urls FROM g")
def c15_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)[0]


@query(f"{BASE_SQL}, {BOARD} SELECT site, place, lane, state, findings, codes, unassessed FROM b")
def a22_site_scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.scorecard(*_audit(spark, sf_dir))


@query(f"""{BASE_SQL}, {BOARD}, v AS (SELECT site, count(*) FILTER (state <> 'na') AS assessed, count(*) AS total, coalesce(list(lane ORDER BY lane) FILTER (state = 'na'), []) AS unassessed, coalesce(list(lane ORDER BY lane) FILTER (state <> 'na' AND len(unassessed) > 0), []) AS partial FROM b GROUP BY site)
    SELECT site, assessed, total, unassessed, partial, coalesce(complete, false) AS crawl_complete, coalesce(complete, false) AND len(partial) = 0 AND unassessed = ['reputation'] AS conclusive FROM v JOIN s USING (site)""")
def a23_site_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, sites = _audit(spark, sf_dir)
    return catalogue.lane_coverage(catalogue.scorecard(found, sites), sites)


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits of the same pages with two states of their sites."""
    before, sites = _audit(spark, sf_dir)
    after, later = _audit(spark, sf_dir, 1)
    boards = catalogue.scorecard(before, sites).select("site", "lane", F.col("state").alias("before")).join(catalogue.scorecard(after, later).select("site", "lane", F.col("state").alias("after")), ["site", "lane"])
    blind = later.select("site", (F.col("robots_state") == "unreachable").alias("blind"), (F.col("proxied") & (F.col("robots_state") == "unreachable")).alias("skipped"))
    return catalogue.diff_checks(before, after, boards, blind, DERIVED)


CHECKS_SQL = f"""{BASE_SQL}, {_findings_sql(1, "2")}, {BOARD}, {BOARD_SQL.format(b="b2", s="s2", g="g2")},
    j AS (SELECT coalesce(x.site, y.site) AS site, coalesce(x.code, y.code) AS code, x.severity AS xs, y.severity AS ys, x.pages AS xp, y.pages AS yp FROM g x FULL JOIN g2 y ON x.site = y.site AND x.code = y.code),
    e AS (SELECT j.site, code, CASE WHEN ys IS NULL AND s2.robots_state = 'unreachable' AND (s2.proxied OR code IN {DERIVED}) THEN 'diff.unverified' WHEN ys IS NULL THEN 'diff.resolved' WHEN xs IS NULL THEN 'diff.new' ELSE 'diff.persisting' END AS name, xs, ys, xp, yp FROM j LEFT JOIN s2 USING (site)),
    c AS (SELECT site, name, CASE WHEN name = 'diff.unverified' OR name = 'diff.persisting' AND (ys = 'critical' OR yp > xp) THEN 'warn' WHEN name = 'diff.new' AND ys = 'critical' THEN 'fail' ELSE 'pass' END AS status, code FROM e
        UNION ALL SELECT b.site, 'diff.scorecard', CASE WHEN b.state <> 'na' AND b2.state = 'na' THEN 'warn' WHEN b.state <> 'na' AND list_position(['bad', 'warn', 'ok', 'na'], b2.state) < list_position(['bad', 'warn', 'ok', 'na'], b.state) THEN 'fail' ELSE 'pass' END,
            CASE WHEN b.state <> 'na' AND list_position(['bad', 'warn', 'ok', 'na'], b2.state) < list_position(['bad', 'warn', 'ok', 'na'], b.state) OR b.state <> 'na' AND b2.state = 'na' THEN b.lane END FROM b JOIN b2 USING (site, lane)),
    ch AS (SELECT site, name, ['fail', 'warn', 'pass', 'skip'][min(list_position(['fail', 'warn', 'pass', 'skip'], status))] AS status, coalesce(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), []) AS codes FROM c GROUP BY ALL)"""


@query(f"{CHECKS_SQL} SELECT site, name AS \"check\", status, codes, row_number() OVER (PARTITION BY site ORDER BY list_position(['fail', 'warn', 'pass', 'skip'], status), name)::INTEGER AS place FROM ch")
def c16_diff_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.ordered(_checks(spark, sf_dir))


@query(f"{CHECKS_SQL} SELECT site, CASE WHEN bool_or(status = 'fail') THEN 1 WHEN bool_or(name = 'diff.unverified') THEN 2 ELSE 0 END AS code FROM ch GROUP BY site")
def c16_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _checks(spark, sf_dir)
    return catalogue.exit_codes(checks, checks.where(F.col("check") == "diff.unverified"))
