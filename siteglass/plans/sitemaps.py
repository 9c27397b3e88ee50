"""Queries over sitemaps of shops, one for each market segment, made of customers and their orders; and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sitemaps
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _index(locs: Column) -> Column:
    return F.concat(F.lit('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.transform(locs, lambda x: F.concat(F.lit("<sitemap><loc> "), x, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>"))


def _answer(site: Column, url: Column, content: Column, status: int = 200) -> list[Column]:
    return [site.alias("site"), url.alias("url"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("truncated"), content.cast("binary").alias("content")]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers: a site's index of nations (and of itself), theirs of stretches of 500 customers between the first and the last
    (and of a file of another host), theirs of customers, and a customer's list of orders; see FILES_SQL."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit(".example.org")).alias("site"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("key"))
    c = c.withColumns({"stretch": F.floor(F.col("key") / 500), "base": F.concat(F.lit("https://"), "site", F.lit("/"))})
    base = F.col("base")
    name = lambda *parts: F.concat(base, *parts, F.lit(".xml"))
    nations = c.groupBy("site", "base", "nation").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high"))
    roots = nations.groupBy("site", "base").agg(F.sort_array(F.collect_list("nation")).alias("all"))
    root = roots.select(*_answer(F.col("site"), name(F.lit("sitemap")), _index(F.array_append(F.transform("all", lambda n: name(F.lit("n"), n.cast("string"))), name(F.lit("sitemap"))))))
    absent = roots.select(*_answer(F.col("site"), name(F.lit("sitemap_index")), F.lit("<html>"), 404))
    stretches = F.transform(F.sequence("low", "high"), lambda k: name(F.lit("n"), F.col("nation").cast("string"), F.lit("-"), k.cast("string")))
    nation = nations.select(*_answer(F.col("site"), name(F.lit("n"), F.col("nation").cast("string")), _index(F.array_prepend(stretches, F.lit("https://other.example.net/x.xml")))))
    lists = c.groupBy("site", "base", "nation", "stretch").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    stretch = lists.select(*_answer(F.col("site"), name(F.lit("n"), F.col("nation").cast("string"), F.lit("-"), F.col("stretch").cast("string")), _index(F.transform("keys", lambda k: name(F.lit("c"), k.cast("string"))))))
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    lastmod = F.when(F.col("o_totalprice") < 100000, F.lit("")).when(F.col("o_totalprice") < 150000, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "yyyy-MM"))
    o = o.join(c, F.col("o_custkey") == F.col("key"))
    loc = F.concat(F.when(F.col("o_orderpriority").startswith("1"), F.lit("http://other.example.net/")).otherwise(base), F.left("o_orderpriority", F.lit(1)), F.lit("/"), "o_orderstatus", F.lit("?a=1&amp;b=2"))
    entry = F.concat(F.lit("<url><loc>"), loc, F.lit("</loc><image:image><image:loc>x</image:loc></image:image><lastmod>"), lastmod, F.lit("</lastmod></url>"))
    orders = o.groupBy("site", "base", "key").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", entry.alias("entry")))).alias("entries"))
    body = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">'), F.array_join("entries.entry", ""), F.lit("</urlset>"))
    customer = orders.select(*_answer(F.col("site"), name(F.lit("c"), F.col("key").cast("string")), body))
    return root.unionByName(absent).unionByName(nation).unionByName(stretch).unionByName(customer)


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit(".example.org")).alias("site")).distinct()
    usual = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("place"), F.lit(path).alias("path"), F.lit(k == 0).alias("declared")) for k, path in enumerate(sitemaps.USUAL)]))
    return sites.select("site", usual.alias("u")).select("site", "u.place", F.concat(F.lit("https://"), "site", "u.path").alias("url"), "u.declared")


FILES_SQL = """
    c AS (SELECT lower(c_mktsegment) || '.example.org' AS site, c_nationkey AS nation, c_custkey AS key, c_custkey // 500 AS stretch FROM customer),
    n AS (SELECT site, nation, min(stretch) AS low, max(stretch) AS high FROM c GROUP BY ALL),
    o AS (SELECT c.site, c.key, o_orderkey, CASE WHEN o_totalprice < 100000 THEN NULL WHEN o_totalprice < 150000 THEN strftime(CAST(o_orderdate AS DATE), '%Y/%m/%d') ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m') END AS lastmod,
        CASE WHEN o_orderpriority LIKE '1%' THEN 'http://other.example.net/' ELSE 'https://' || site || '/' END || left(o_orderpriority, 1) || '/' || o_orderstatus || '?a=1&b=2' AS loc FROM orders JOIN c ON o_custkey = c.key),
    e AS (SELECT site, 'sitemap' AS parent, row_number() OVER (PARTITION BY site ORDER BY nation) AS pos, 'n' || nation AS child FROM n
        UNION ALL SELECT site, 'sitemap', count(*) + 1, 'sitemap' FROM n GROUP BY site
        UNION ALL SELECT site, 'n' || nation, 1, NULL FROM n
        UNION ALL SELECT site, 'n' || nation, k - low + 2, 'n' || nation || '-' || k FROM (SELECT *, unnest(range(low, high + 1)) AS k FROM n)
        UNION ALL SELECT site, 'n' || nation || '-' || stretch, row_number() OVER (PARTITION BY site, nation, stretch ORDER BY key), 'c' || key FROM c),
    f AS (SELECT site, parent AS name, 200 AS status, 'sitemapindex' AS kind, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT site, 'sitemap_index', 404, NULL, 0 FROM n GROUP BY site UNION ALL SELECT site, 'c' || key, 200, 'urlset', count(*) FROM o GROUP BY ALL),
    walk AS (SELECT site, unnest(['sitemap', 'sitemap_index']) AS name, 0 AS level, [unnest([0, 1])::BIGINT] AS ord FROM n GROUP BY site
        UNION ALL SELECT w.site, e.child, level + 1, list_append(ord, e.pos) FROM walk w JOIN e ON e.site = w.site AND e.parent = w.name WHERE level < 5 AND child IS NOT NULL AND (pos <= {children} OR {children} = 0)),
    once AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY site, name ORDER BY level, ord) = 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY level, ord) AS place FROM once),
    named AS (SELECT DISTINCT e.site, e.child AS name FROM placed p JOIN e ON e.site = p.site AND e.parent = p.name WHERE p.place <= {files} AND e.child IS NOT NULL AND (pos <= {children} OR {children} = 0)),
    found AS (SELECT p.site, CASE WHEN place <= {files} THEN place::INTEGER END AS place, p.name, 'https://' || p.site || '/' || p.name || '.xml' AS url, CASE WHEN place <= {files} THEN status END AS status, CASE WHEN place <= {files} THEN kind END AS kind,
            (CASE WHEN place <= {files} AND kind IS NOT NULL THEN n ELSE 0 END)::INTEGER AS url_count, place <= {files} AND kind IS NOT NULL AS parsed,
            place > {files} OR coalesce(kind = 'sitemapindex' AND {children} > 0 AND n > {children}, false) AS truncated, CASE WHEN place > {files} THEN 'inspection_limit' WHEN status IS NULL THEN 'no_answer' END AS error,
            p.name = 'sitemap' OR m.name IS NOT NULL AS required
        FROM placed p LEFT JOIN f USING (site, name) LEFT JOIN named m ON m.site = p.site AND m.name = p.name WHERE place <= {files} OR m.name IS NOT NULL)
"""


def _sql(files: int, children: int) -> str:
    return f"WITH RECURSIVE {FILES_SQL.format(files=files, children=children)}"


@query(f"{_sql(100, 100)} SELECT site, place, url, status, kind, url_count, parsed, truncated, error, required FROM found")
def s12_sitemap_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemaps.inspected(sitemaps.parsed(answers(spark, sf_dir)), roots(spark, sf_dir))


@query(f"{_sql(500, 0)} SELECT site, count(*) AS discovered, count(place) AS checked, count(*) FILTER (place IS NULL) AS remaining FROM found GROUP BY site")
def s13_sitemap_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemaps.frontier(sitemaps.inspected(sitemaps.parsed(answers(spark, sf_dir)), roots(spark, sf_dir), 500, None))


@query(f"""{_sql(100, 100)}, v AS (SELECT *, regexp_matches(lastmod, '^\\d{{4}}-\\d{{2}}$') AS ok FROM o), t AS (SELECT site, key, lastmod, count(*) AS n FROM v WHERE ok GROUP BY ALL),
    b AS (SELECT site, key, arg_min(lastmod, [-n, strptime(lastmod, '%Y-%m')::DATE - DATE '1970-01-01']) AS top_value, max(n) AS top_count FROM t GROUP BY ALL)
    SELECT site, 'https://' || site || '/c' || key || '.xml' AS url, count(*)::INTEGER AS entries, count(*) FILTER (lastmod IS NULL)::INTEGER AS lastmod_missing, count(*) FILTER (lastmod IS NOT NULL AND NOT ok)::INTEGER AS lastmod_invalid, any_value(top_value) AS top_value, coalesce(any_value(top_count), 0)::INTEGER AS top_count,
        round(coalesce(any_value(top_count), 0) / count(*), 3) AS top_share, count(*) FILTER (loc LIKE 'http://other%')::INTEGER AS foreign_host, (count(*) - count(DISTINCT loc))::INTEGER AS duplicate_urls, false AS over_url_limit FROM v LEFT JOIN b USING (site, key) GROUP BY site, key""")
def x01_sitemap_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = sitemaps.parsed(answers(spark, sf_dir)).where("kind = 'urlset'")
    return sitemaps.quality(read).drop("bytes", "over_size_limit")


@query(f"""{_sql(500, 0)}, k AS (SELECT DISTINCT o.site, loc FROM o JOIN found ON found.site = o.site AND found.name = 'c' || o.key AND found.place IS NOT NULL WHERE loc NOT LIKE 'http://other%'),
    m AS (SELECT site, count(*) AS missing FROM k WHERE loc NOT LIKE '%/O?%' GROUP BY site), b AS (SELECT site, count(*) FILTER (NOT parsed AND NOT (name = 'sitemap_index' AND NOT required) OR truncated) AS failed FROM found GROUP BY site),
    s AS (SELECT site, coalesce(missing, 0) AS missing, failed, CASE length(site) - 12 WHEN 10 THEN NULL WHEN 8 THEN false ELSE true END AS complete FROM b LEFT JOIN m USING (site)),
    r AS (SELECT *, CASE WHEN NOT complete THEN 'page_limit; robots' WHEN failed > 0 THEN 'sitemap_failed' WHEN complete IS NULL AND missing > 0 THEN 'coverage_unknown_urls_lost' ELSE '' END AS reason FROM s)
    SELECT site, reason = '' AS safe, complete IS NOT NULL OR failed > 0 AS verified, reason, missing, failed FROM r""")
def p14_sitemap_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = sitemaps.parsed(answers(spark, sf_dir))
    files = sitemaps.inspected(read, roots(spark, sf_dir), 500, None)
    known = sitemaps.listed(read, files).select("site", F.col("loc").alias("url")).where("url not like 'http://other%'").distinct()
    n = F.length("site") - 12
    sites = roots(spark, sf_dir).select("site").distinct().select("site", F.when(n == 8, False).when(n < 10, True).alias("complete"), F.array(F.lit("page_limit"), F.lit("robots")).alias("reasons"))
    return sitemaps.safety(sites, files, known, known.where("url like '%/O?%'"))


@query("""WITH u AS (SELECT DISTINCT 'https://shop.example.org/' || c_name || '/' || o_orderkey AS loc FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT loc, row_number() OVER (ORDER BY loc) - 1 AS rank, coalesce(sum(strlen(loc) + 40) OVER (ORDER BY loc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins, strlen(loc) + 40 AS size FROM u)
    SELECT rank // 300 AS by_count, begins::BIGINT // (30000 - 240) AS by_bytes, count(*) AS n_urls, min(loc) AS first, sum(size)::BIGINT AS bytes, count(*) <= 300 AND sum(size) <= 30000 AS fits FROM s GROUP BY ALL""")
def k09_sitemap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    loc = F.concat(F.lit("https://shop.example.org/"), "c_name", F.lit("/"), F.col("o_orderkey").cast("string"))
    p = sitemaps.packed(o.select(loc.alias("loc")), per_file=300, most_bytes=30000, longest=200)
    size = F.sum(F.octet_length("loc") + sitemaps.ENTRY)
    return p.groupBy("chunk").agg(F.count("*").alias("n_urls"), F.min("loc").alias("first"), size.alias("bytes"), ((F.count("*") <= 300) & (size <= 30000)).alias("fits")).select("chunk.*", "n_urls", "first", "bytes", "fits")
