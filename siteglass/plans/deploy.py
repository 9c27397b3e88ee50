"""Queries of deployment checks: hosts' sections as sites, pages as crawled against what the pages' own table says, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import crawl, deploy, jsonld, robots, strengths
from ..sources.scratch import kept
from ..sources.tables import CRAWLED_SQL, crawled, table
from .catalogue import KNOWN, SITE_SQL, _sites, site_of
from .robots import F_SQL, robots_files

QUERIES: dict = {}
ORACLES: dict = {}
C = f"WITH {CRAWLED_SQL}"
SITE = SITE_SQL.format("url")
#: What judged (j) and found rows (i) come to.
VERDICT = """SELECT site, "check", coalesce(['fail', 'warn', 'pass'][min(w)], 'skip') AS status, count(*) FILTER (f) AS n, coalesce(array_to_string(list_slice(list(item ORDER BY w, item) FILTER (f), 1, 20), ' | '), '') AS evidence
    FROM (SELECT site, "check", list_position(['fail', 'warn', 'pass'], status) AS w, false AS f, NULL AS item FROM j UNION ALL SELECT site, "check", list_position(['fail', 'warn', 'pass'], status), true, item FROM i) GROUP BY site, "check" """
N = "regexp_replace({0}, '#.*$', '')".format


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _shown(checks: DataFrame) -> DataFrame:
    return checks.withColumn("evidence", F.array_join("evidence", " | "))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = crawl.records(crawled(spark, sf_dir), closed=True).withColumns({"site": site_of(F.col("url")), "noindex": ~crawl.indexable()})
    columns = ["site", "page_id", "url", "final_url", "status", "noindex", "title", "description", "canonical", "directives", "jsonld_blocks", "jsonld_invalid", "text_chars", "naver_verified"]
    return kept(read.select(*columns), "live")


@query(rf"""{C}, s AS (SELECT {SITE} AS site, url, status, noindex FROM rec), e AS (SELECT site, url, max(CASE WHEN status = 200 THEN noindex END) AS now FROM s GROUP BY ALL),
    j AS (SELECT site, 'noindex' AS "check", CASE WHEN count(now) = 0 THEN 'fail' ELSE 'pass' END AS status FROM e GROUP BY site),
    i AS (SELECT site, 'noindex' AS "check", CASE WHEN now THEN 'fail' ELSE 'warn' END AS status, url AS item FROM e WHERE coalesce(now, true)) {VERDICT}""")
def c16_noindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, none of which forbids indexing by itself, against their crawl, whose headers do."""
    live = _live(spark, sf_dir)
    return _shown(deploy.noindex_check(live.select("site", "url", F.lit(200).alias("status"), F.lit(False).alias("noindex")), live))


@query(rf"""{C}, p AS (SELECT {SITE} AS site, url, html FROM pages), s AS (SELECT site, min(regexp_extract(url, '://([^/?#]*)', 1)) AS host, sum(strlen(coalesce(html, '')))::BIGINT AS b FROM p GROUP BY site),
    w AS (SELECT p.site, p.url, regexp_extract(p.url, '://([^/?#]*)', 1) = host AS own FROM p JOIN s USING (site)), g AS (SELECT w.*, r.url IS NOT NULL AS fetched, status, noindex, {N("coalesce(base, w.url)")} AS final, {N("CASE WHEN NOT no_canonical THEN coalesce(other_canonical, page_url) END")} AS canon FROM w LEFT JOIN rec r ON r.url = w.url WHERE own),
    c AS (SELECT s.site, count(g.url) AS targets, count(g.url) FILTER (NOT fetched) AS open FROM s LEFT JOIN g USING (site) GROUP BY s.site),
    j AS (SELECT site, 'sitemap.reachable' AS "check", CASE WHEN b % 3 = 0 THEN 'warn' ELSE 'pass' END AS status FROM s UNION ALL SELECT site, x, CASE WHEN open > 0 THEN 'warn' ELSE 'pass' END FROM c, (VALUES ('sitemap.locs'), ('sitemap.noindex'), ('sitemap.canonical')) v(x) WHERE targets > 0 UNION ALL SELECT site, 'sitemap.locs', 'skip' FROM c WHERE targets = 0),
    i AS (SELECT site, 'sitemap.reachable' AS "check", 'fail' AS status, '/sitemap.xml' AS item FROM s WHERE b % 5 = 0 OR b % 7 = 0 UNION ALL SELECT site, 'sitemap.host', 'warn', url FROM w WHERE NOT own UNION ALL SELECT site, 'sitemap.locs', 'fail', url FROM g WHERE fetched AND coalesce(status <> 200, true)
        UNION ALL SELECT site, 'sitemap.noindex', 'fail', url FROM g WHERE status = 200 AND noindex UNION ALL SELECT site, 'sitemap.canonical', 'fail', url FROM g WHERE status = 200 AND ({N("url")} <> final OR coalesce(canon <> final, false))) {VERDICT}""")
def c16_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap for each site that lists its pages as their table has them, of which the crawl reached some elsewhere."""
    pages = table(spark, sf_dir, "pages").withColumn("site", site_of(F.col("url")))
    sites = kept(pages.groupBy("site").agg(F.min(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"), F.sum(F.octet_length(F.coalesce("html", F.lit("")))).alias("b")), "sites")
    files = sites.select("site", F.lit("/sitemap.xml").alias("file"), F.when(F.col("b") % 5 == 0, 404).otherwise(200).alias("status"), (F.col("b") % 7 != 0).alias("parsed"), (F.col("b") % 3 == 0).alias("remaining"))
    return _shown(deploy.sitemap_checks(sites, files, pages.select("site", F.col("url").alias("loc")), _live(spark, sf_dir)))


@query(rf"""{C}, s AS (SELECT {SITE} AS site, page_id, url, status, title, description FROM rec), d AS (SELECT site, url, trim(left(title, 40)) AS dt, CASE WHEN length(title) < 50 THEN trim(description) ELSE '<<TODO' END AS dd FROM s),
    g AS (SELECT site, url, min({{'t': title, 'd': description}}) AS l FROM s WHERE status = 200 GROUP BY ALL), r AS (SELECT d.*, l.t AS t, l.d AS d FROM d LEFT JOIN g USING (site, url)),
    a AS (SELECT site, url, 'title' AS field, dt AS want, t AS got FROM r WHERE t IS NOT NULL AND dt <> '' UNION ALL SELECT site, url, 'description', dd, d FROM r WHERE t IS NOT NULL AND dd NOT IN ('', '<<TODO')),
    t AS (SELECT site, t, count(*) AS n FROM r WHERE t <> '' GROUP BY ALL),
    j AS (SELECT site, 'meta.applied' AS "check", CASE WHEN site IN (SELECT site FROM a) THEN 'pass' ELSE 'warn' END AS status FROM (SELECT DISTINCT site FROM d) UNION ALL SELECT DISTINCT site, 'meta.duplicate', 'pass' FROM t),
    i AS (SELECT site, 'meta.applied' AS "check", 'fail' AS status, field || ' ' || url AS item FROM a WHERE want <> got UNION ALL SELECT site, 'meta.applied', 'warn', 'unread ' || url FROM r WHERE t IS NULL UNION ALL SELECT site, 'meta.duplicate', 'fail', t FROM t WHERE n > 1) {VERDICT}""")
def c16_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that cut titles at 40 characters and keep the descriptions of pages with short ones, against the crawl."""
    live = _live(spark, sf_dir)
    drafts = live.select("site", "url", F.left("title", F.lit(40)).alias("draft_title"), F.when(F.length("title") < 50, F.col("description")).otherwise("<<TODO").alias("draft_description"))
    return _shown(deploy.meta_checks(live.select("site").distinct(), drafts, live))


@query(rf"""{F_SQL}, served AS (SELECT file::VARCHAR AS site, code AS status, coalesce(code = 200, false) AS good, marked, CASE WHEN status < 500 THEN value || chr(10) || 'Sitemap: /s.xml' ELSE value END AS value, CASE WHEN marked THEN older ELSE value END AS older, coalesce(status < 500, false) AS declared
        FROM (SELECT *, CASE WHEN status < 800 THEN 200 ELSE status END AS code, contains(url, '#') OR contains(url, '?') AS marked FROM f)), was AS (SELECT site, trim(x, ' ' || chr(13)) AS line FROM (SELECT site, unnest(string_split(older, chr(10))) AS x FROM served)), lines AS (SELECT site, trim(x, ' ' || chr(13)) AS line FROM (SELECT site, unnest(string_split(value, chr(10))) AS x FROM served WHERE good)),
    j AS (SELECT site, x AS "check", 'pass' AS status FROM served, (VALUES ('robots.status'), ('robots.preserved'), ('robots.policy'), ('robots.sitemap')) v(x)),
    i AS (SELECT site, 'robots.status' AS "check", 'fail' AS status, coalesce(status::VARCHAR, 'none') AS item FROM served WHERE NOT good UNION ALL SELECT site, 'robots.preserved', 'fail', line FROM was WHERE line <> '' AND NOT EXISTS (SELECT 1 FROM lines l WHERE l.site = was.site AND l.line = was.line) UNION ALL SELECT site, 'robots.sitemap', 'fail', 'not declared' FROM served WHERE NOT (good AND declared)
        UNION ALL SELECT served.site, 'robots.policy', 'fail', n.agent || ' ' || o.policy || ' ' || CASE WHEN good THEN n.policy ELSE 'none' END FROM served JOIN pol n ON n.file::VARCHAR = served.site AND n.kind = 'now' JOIN pol o ON n.file = o.file AND n.agent = o.agent AND o.kind = CASE WHEN marked THEN 'older' ELSE 'now' END WHERE o.policy <> CASE WHEN good THEN n.policy ELSE 'none' END) {VERDICT}""")
def c16_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The robots file of each page as a site, served as its URL says and partly with a sitemap, against what was there and was to be deployed: an older file where the URL has a query or a fragment, else the same."""
    status, marked = F.col("status"), F.col("error").isNotNull()
    live = F.when(status < 500, F.concat("value", F.lit("\nSitemap: /s.xml"))).otherwise(F.col("value"))
    f = robots_files(spark, sf_dir).select(F.col("file").cast("string").alias("site"), live.alias("value"), F.when(marked, F.col("older")).otherwise(F.col("value")).alias("before"), F.when(status < 800, 200).otherwise(status).alias("status"))
    f = kept(f, "robots")
    before = f.select("site", F.col("before").alias("value"))
    return _shown(deploy.robots_checks(f.select("site"), f, before, before))


_PATH = r"trim(regexp_extract({0}, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/')".format
_NAME = "left(CASE WHEN {0} = '' THEN 'home' ELSE trim(regexp_replace({0}, '[^A-Za-z0-9._-]+', '-', 'g'), '-') END, 80)".format


@query(rf"""{C}, w AS (SELECT DISTINCT {SITE} AS site, 'jsonld/' || {_NAME(_PATH("url"))} || '.faq.json' AS name, {_NAME(_PATH("url"))} AS slug FROM pages),
    b AS (SELECT {SITE} AS site, {_NAME(_PATH("url"))} AS slug, arg_min(url, page_id) AS url FROM rec WHERE status = 200 GROUP BY ALL),
    o AS (SELECT {SITE} AS site, 'http://' || min(regexp_extract(url, '://([^/?#]*)', 1)) || '/' AS url FROM pages GROUP BY 1)
    SELECT site, name, 'faq' AS kind, url FROM w LEFT JOIN b USING (site, slug) UNION ALL SELECT site, 'jsonld/organization.json', 'organization', url FROM o""")
def j12_package_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages without a manifest: a file for each page by its path, and one for the site, against the pages that the crawl read."""
    pages = table(spark, sf_dir, "pages").withColumn("site", site_of(F.col("url")))
    sites = pages.groupBy("site").agg(F.concat(F.lit("http://"), F.min(F.regexp_extract("url", "://([^/?#]*)", 1))).alias("base"))
    path = F.regexp_replace(urls.part(F.col("url"), 3), "^/+|/+$", "")
    name = F.left(F.when(path == "", "home").otherwise(F.regexp_replace(F.regexp_replace(path, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")), F.lit(80))
    files = pages.select("site", F.concat(F.lit("jsonld/"), name, F.lit(".faq.json")).alias("name")).unionByName(sites.select("site", F.lit("jsonld/organization.json").alias("name"))).distinct()
    files = files.select("site", "name", F.lit("jsonld").alias("kind"), F.lit(True).alias("valid"))
    none = files.select("site", "name", F.lit(None).cast("string").alias("url")).where("false")
    return deploy.targets(files, none, sites, _live(spark, sf_dir)).select("site", "name", "kind", "url")


@query(rf"""{C}, s AS (SELECT {SITE} AS site, page_id, url, status, blocks, invalid, types, html FROM rec JOIN (SELECT page_id, html FROM crawled) USING (page_id)), a AS (SELECT site, page_id, url, CASE WHEN strlen(html) % 2 = 0 THEN 'FAQPage' ELSE 'Organization' END AS type FROM s),
    p AS (SELECT site, url, max({{'s': status, 'b': invalid}}) AS m FROM s GROUP BY ALL), t AS (SELECT DISTINCT site, url, unnest(types) AS type FROM s), k AS (SELECT DISTINCT site, url FROM s WHERE blocks > invalid),
    r AS (SELECT a.*, a.page_id || '.json' AS name, m.b AS broken, CASE WHEN coalesce(m.s <> 200, true) THEN 'page' WHEN k.url IS NULL THEN 'block' END AS step FROM a JOIN p USING (site, url) LEFT JOIN k USING (site, url)),
    bad AS (SELECT site, name, 'type' AS why FROM r WHERE step IS NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.site = r.site AND t.url = r.url AND t.type = r.type) UNION ALL SELECT site, name, 'broken block' FROM r WHERE step IS NULL AND broken > 0),
    c AS (SELECT site, bool_or(step IS NOT NULL) AS stopped FROM r GROUP BY site),
    j AS (SELECT site, 'jsonld.present' AS "check", 'pass' AS status FROM c UNION ALL SELECT site, 'jsonld.type', 'pass' FROM c WHERE NOT stopped UNION ALL SELECT site, 'jsonld.visible', CASE WHEN stopped OR site IN (SELECT site FROM bad) THEN 'skip' ELSE 'pass' END FROM c),
    i AS (SELECT site, 'jsonld.present' AS "check", 'fail' AS status, name || ': ' || step AS item FROM r WHERE step IS NOT NULL UNION ALL SELECT site, 'jsonld.type', 'fail', name || ': ' || why FROM bad) {VERDICT}""")
def c16_jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of one type or another for each page, as its length says, against the blocks that the crawl found there."""
    pages = crawled(spark, sf_dir).withColumn("site", site_of(F.col("url")))
    scripts = F.regexp_extract_all("html", F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), F.lit(1))
    found = pages.select("site", "page_id", "url", F.posexplode(scripts).alias("k", "block")).where(F.try_parse_json("block").isNotNull())
    found = kept(found.select("site", "url", (F.col("page_id") * 1000 + F.col("k")).alias("block_id"), "block"), "blocks")
    aims = pages.select("site", F.concat(F.col("page_id").cast("string"), F.lit(".json")).alias("name"), "url", F.col("page_id").alias("file_id"), F.concat(F.lit('{"@type": "'), F.when(F.octet_length("html") % 2 == 0, "FAQPage").otherwise("Organization"), F.lit('"}')).alias("block"))
    aims = kept(aims.withColumns({"valid": F.lit(True), "manifest": F.lit(False)}), "aims")
    live = _live(spark, sf_dir).withColumnRenamed("jsonld_invalid", "broken")
    said = kept(jsonld.leaves(found, "block_id", "block"), "said")
    texts = live.select("site", "url", F.col("title").alias("text")).dropDuplicates(["site", "url"])
    return _shown(deploy.jsonld_checks(aims.select("site").distinct(), aims.drop("block"), jsonld.leaves(aims, "file_id", "block"), live, found.drop("block"), said, texts))


_KNOWN = ", ".join(f"{KNOWN[k]} AS {k}" for k in ("sitemap_declared", "sitemaps_live", "llms_status", "probe_404", "redirect_hops"))
_RULES = [
    ("NO_NOINDEX", "noidx = 0"), ("SITEMAP_RESPONDS", "sitemaps_live > 0"), ("SITEMAP_DECLARED", "sitemap_declared > 0"), ("AI_SEARCH_ALLOWED", "ai"), ("KOREAN_SEARCH_ALLOWED", "ko"), ("JSONLD_COMMON", "ld > n * 0.5"), ("TEXT_ENOUGH", "shortest >= 300"), ("TITLES_DISTINCT", "titles > 1 AND titles = titled"),
    ("DESCRIPTIONS_DISTINCT", "descs > 1 AND descs = described"), ("CANONICALS", "uncanonical = 0"), ("REAL_404", "probe_404 = 404"), ("FEW_REDIRECTS", "redirect_hops <= 1"), ("LLMS_TXT", "llms_status = 200"), ("NAVER_VERIFIED", "false"),
]


@query(rf"""{F_SQL}, {CRAWLED_SQL}, q AS (SELECT site, sum(strlen(html))::BIGINT AS b, arg_min(page_id, page_id) AS first FROM (SELECT {SITE} AS site, page_id, coalesce(html, '') AS html FROM pages) GROUP BY site), kn AS (SELECT site, first, {_KNOWN} FROM q),
    po AS (SELECT kn.site, bool_and(ends_with(policy, 'allow')) FILTER (agent IN ('OAI-SearchBot', 'Claude-SearchBot', 'PerplexityBot')) AS ai, bool_and(ends_with(policy, 'allow')) FILTER (agent IN ('Yeti', 'Daumoa')) AS ko FROM kn JOIN pol ON pol.file = first AND kind = 'now' GROUP BY kn.site),
    s AS (SELECT {SITE} AS site, count(*) AS n, count(*) FILTER (noindex) AS noidx, count(*) FILTER (blocks > invalid) AS ld, min(text_chars) AS shortest, count(DISTINCT nullif(title, '')) AS titles, count(nullif(title, '')) AS titled, count(DISTINCT nullif(description, '')) AS descs, count(nullif(description, '')) AS described, count(*) FILTER (no_canonical) AS uncanonical FROM rec WHERE status = 200 GROUP BY 1)
    SELECT * FROM (SELECT site, unnest([{", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in _RULES)}]) AS code FROM s LEFT JOIN kn USING (site) LEFT JOIN po USING (site)) WHERE code IS NOT NULL""")
def z06_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths of the crawl's sites; the robots file of a site is that of its first page."""
    first = table(spark, sf_dir, "pages").groupBy(site_of(F.col("url")).alias("site")).agg(F.min("page_id").alias("file"))
    said = robots.policies(robots_files(spark, sf_dir).withColumn("state", F.lit("ok"))).join(first, "file").select("site", "agent", "policy")
    return strengths.strengths(_live(spark, sf_dir), _sites(spark, sf_dir), said).select("site", "code")
