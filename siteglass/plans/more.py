"""Queries over shares, comparisons, ranking, sitemaps and parsers, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing, text, urls
from ..functions.stats import rate
from ..operators import audit, compare, measure, shares, sitemaps
from ..sources.tables import OBSERVATIONS_SQL, observations, table

QUERIES: dict = {}
ORACLES: dict = {}
RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
HOST = f"lower(regexp_extract(url, '{RFC}', 2))"
PATH = f"regexp_extract(url, '{RFC}', 3)"
KEY = f"{HOST} || regexp_replace({PATH}, '/+$', '') || CASE WHEN regexp_extract(url, '{RFC}', 4) <> '' THEN '?' || regexp_extract(url, '{RFC}', 4) ELSE '' END"
SITE = "example.org"
O = f"WITH {OBSERVATIONS_SQL}"  # noqa: E741
C = f"""{O}, c AS (SELECT DISTINCT seq, unnest(['https://www.example.org/p' || seq % 7, 'https://news' || question_id % 5 || '.example.com/a', 'http://forum.example.net/t/' || seq % 3]) AS url FROM o WHERE seq % 4 <> 0),
    d AS (SELECT seq, url, regexp_replace(regexp_extract(url, '://([^/]*)', 1), '^www\\.', '') AS domain FROM c), x AS (SELECT * FROM d WHERE domain <> '{SITE}' AND NOT ends_with(domain, '.{SITE}'))"""
CHANNELS = [("example.com", "news"), ("news1.example.com", "press")]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    found = F.array(F.concat(F.lit("https://www.example.org/p"), (s % 7).cast("string")), F.concat(F.lit("https://news"), (F.col("question_id") % 5).cast("string"), F.lit(".example.com/a")), F.concat(F.lit("http://forum.example.net/t/"), (s % 3).cast("string")))
    return observations(spark, sf_dir).where(s % 4 != 0).select("seq", found.alias("cited_urls"))


@query(f"{C} SELECT url, count(*) AS n_runs FROM d WHERE domain = '{SITE}' OR ends_with(domain, '.{SITE}') GROUP BY url")
def a08_owned_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.owned_urls(_citing(spark, sf_dir), SITE)


@query(f"{C} SELECT domain, count(DISTINCT seq) AS n_runs, min(seq) AS first_seq FROM x GROUP BY domain")
def a09_competitor_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.other_domains(_citing(spark, sf_dir), SITE)


@query(f"""{C}, n AS (SELECT DISTINCT seq, CASE WHEN domain = 'news1.example.com' THEN 'press' WHEN ends_with(domain, '.example.com') THEN 'news' ELSE 'other' END AS channel FROM x)
    SELECT channel, count(*) AS n_runs, (SELECT count(DISTINCT seq) FROM x) AS with_sources, round(count(*) / (SELECT count(DISTINCT seq) FROM x), 4) AS share FROM n GROUP BY channel""")
def a10_channel_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.channel_shares(_citing(spark, sf_dir), SITE, spark.createDataFrame(CHANNELS, "suffix string, channel string"))


@query(f"{C} SELECT domain, count(DISTINCT seq) AS n_runs, min(seq) AS first_seq FROM x GROUP BY domain ORDER BY n_runs DESC, first_seq, domain LIMIT 5")
def w03_top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.top(shares.other_domains(_citing(spark, sf_dir), SITE), 5)


@query(f"""{O} SELECT count(*) AS attempts, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome IN ('unmeasured', 'blocked', 'partial')) AS unmeasured, count(*) FILTER (known) AS citation_known,
    count(*) FILTER (outcome = 'error') = 0 AND count(*) FILTER (outcome IN ('unmeasured', 'blocked', 'partial')) = 0 AND count(*) FILTER (known) > 0 AS regression_eligible FROM k""")
def a12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measure.slots(observations(spark, sf_dir).withColumn("all", F.lit(1)), ["all"]).select("attempts", "errors", "unmeasured", "citation_known")
    return out.withColumn("regression_eligible", (F.col("errors") == 0) & (F.col("unmeasured") == 0) & (F.col("citation_known") > 0))


@query("SELECT l_suppkey, count(*) AS n_rows, count(*) FILTER (abs(l_tax - l_discount) > 0.005) AS mismatches FROM lineitem GROUP BY l_suppkey")
def a15_rate_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reported rate is l_tax, the computed one l_discount."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("l_tax") - F.col("l_discount")) > 0.005).alias("mismatches"))


TITLE = "trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))"


@query(f"SELECT count(*) AS crawled, count(DISTINCT CASE WHEN t <> '' THEN t END) AS unique_titles, count(*) FILTER (contains(lower(html), 'application/ld+json')) AS with_jsonld FROM (SELECT {TITLE} AS t, coalesce(html, '') AS html FROM pages)")
def a18_page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.facts(table(spark, sf_dir, "pages"))
    return found.agg(F.count("*").alias("crawled"), F.count_distinct(F.when(F.col("title") != "", F.col("title"))).alias("unique_titles"), F.count_if(F.col("jsonld_count") > 0).alias("with_jsonld"))


STATUS = "[200, 200, 301, 404, 429, 503][1 + event_id % 6]"


@query(f"SELECT {STATUS} AS status, count(*) AS n, CASE WHEN {STATUS} = 429 THEN 'throttled' WHEN {STATUS} >= 400 THEN 'error' ELSE 'ok' END AS kind FROM events GROUP BY ALL")
def a21_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, (200, 200, 301, 404, 429, 503))), (1 + F.col("event_id") % 6).cast("int")).alias("status"))
    kind = F.when(F.col("status") == 429, "throttled").when(F.col("status") >= 400, "error").otherwise("ok")
    return e.groupBy("status").agg(F.count("*").alias("n")).withColumn("kind", kind)


OUTCOMES = ["observed", "partial", "blocked", "unmeasured", "error"]


@query(f"{O} SELECT engine, {', '.join(f'count(*) FILTER (outcome = {chr(39)}{x}{chr(39)}) AS {x}' for x in OUTCOMES)} FROM o GROUP BY engine")
def a33_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("engine").pivot("outcome", OUTCOMES).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def w02_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))


@query(f"{O}, d AS (SELECT date, round(count(*) FILTER (known AND cited) / nullif(count(*) FILTER (known), 0), 4) AS citation_rate FROM k GROUP BY date) SELECT date, citation_rate, round((citation_rate - first_value(citation_rate) OVER (ORDER BY date)) * 100, 1) AS points FROM d")
def w04_baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window is over one row for each day, after the aggregate."""
    days = measure.trend(observations(spark, sf_dir)).select("date", rate(F.col("cited"), F.col("runs")).alias("citation_rate"))
    return days.withColumn("points", F.round((F.col("citation_rate") - F.first("citation_rate").over(Window.orderBy("date"))) * 100, 1))


@query(f"{O}, m AS (SELECT engine, max(date) AS date FROM o GROUP BY engine) SELECT engine, date, count(*) AS n_rows FROM o JOIN m USING (engine, date) GROUP BY ALL")
def w05_latest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = observations(spark, sf_dir).groupBy("engine", "date").agg(F.count("*").alias("n"))
    return days.groupBy("engine").agg(F.max(F.struct("date", "n")).alias("m")).select("engine", "m.date", F.col("m.n").alias("n_rows"))


@query(f"SELECT page_id, {HOST} LIKE '%.net' AS owned, CAST(row_number() OVER (PARTITION BY {HOST} LIKE '%.net' ORDER BY page_id) AS INTEGER) AS turn FROM pages")
def w08_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.endswith(urls.host(F.col("url")), F.lit(".net")).alias("owned"))
    return shares.interleaved(pages, "owned", "page_id")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) WHERE place <= 2")
def w09_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.capped(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", ["turn"], 2).drop("place")


@query(f"{O} SELECT date, count(*) FILTER (mode = 'api') AS api, count(*) FILTER (mode = 'manual') AS manual, arg_min(fingerprint, seq) FILTER (reservation) AS label FROM o GROUP BY date")
def w13_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    return rows.groupBy("date").agg(F.count_if(F.col("mode") == "api").alias("api"), F.count_if(F.col("mode") == "manual").alias("manual"), F.min_by("fingerprint", F.when(F.col("reservation"), F.col("seq"))).alias("label"))


HALVES = f"{O}, a AS (SELECT * FROM k WHERE day(date) <= 15), b AS (SELECT * FROM k WHERE day(date) > 15)"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = observations(spark, sf_dir)
    return rows.where("dayofmonth(date) <= 15"), rows.where("dayofmonth(date) > 15")


@query(f"""{HALVES}, x AS (SELECT engine || '/' || seq % 37 AS code, count(*) AS n FROM a WHERE seq % 37 <> 3 GROUP BY 1), y AS (SELECT engine || '/' || seq % 37 AS code, count(*) AS n FROM b WHERE seq % 37 <> 5 GROUP BY 1)
    SELECT code, coalesce(x.n, 0) AS n_before, coalesce(y.n, 0) AS n_after, CASE WHEN y.n IS NULL THEN 'resolved' WHEN x.n IS NULL THEN 'new' ELSE 'persisting' END AS state FROM x FULL JOIN y USING (code)""")
def j04_code_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    code = F.concat("engine", F.lit("/"), (F.col("seq") % 37).cast("string")).alias("code")
    return compare.codes(a.where("seq % 37 <> 3").select(code), b.where("seq % 37 <> 5").select(code))


FIELDS = ["engine", "mode", "outcome", "coverage", "cited"]


@query(f"""{HALVES}, x AS (SELECT question_id, {', '.join(f'(arg_max({{v: CAST({f} AS VARCHAR)}}, seq)).v AS {f}' for f in FIELDS)} FROM a GROUP BY 1), y AS (SELECT question_id, {', '.join(f'(arg_max({{v: CAST({f} AS VARCHAR)}}, seq)).v AS {f}' for f in FIELDS)} FROM b GROUP BY 1)
    {' UNION ALL '.join(f"SELECT '{f}' AS field, count(*) FILTER (x.{f} IS NOT NULL AND y.{f} IS NOT NULL) AS compared, count(*) FILTER (x.{f} <> y.{f}) AS changed, count(*) FILTER (x.{f} IS NULL OR y.{f} IS NULL) AS unknown FROM x JOIN y USING (question_id)" for f in FIELDS)}""")
def j05_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (measure.last_write_wins(x, ["question_id"]) for x in _halves(spark, sf_dir))
    return compare.controls(a, b, "question_id", FIELDS)


@query(f"{HALVES} (SELECT seq % 7919 AS key, 'gone' AS state FROM a EXCEPT SELECT seq % 7919, 'gone' FROM b) UNION ALL (SELECT seq % 7919, 'new' FROM b EXCEPT SELECT seq % 7919, 'new' FROM a)")
def j06_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    key = (F.col("seq") % 7919).alias("key")
    return compare.presence(a.select(key), b.select(key), "key")


@query(f"""{HALVES}, x AS (SELECT engine, count(*) FILTER (known AND cited) AS h, count(*) FILTER (known) AS n FROM a GROUP BY 1), y AS (SELECT engine, count(*) FILTER (known AND cited) AS h, count(*) FILTER (known) AS n FROM b GROUP BY 1)
    SELECT engine, coalesce(x.h, 0) AS hits_before, coalesce(x.n, 0) AS known_before, coalesce(y.h, 0) AS hits_after, coalesce(y.n, 0) AS known_after, CASE WHEN x.n > 0 AND y.n > 0 THEN round((y.h / y.n - x.h / x.n) * 100, 1) END AS points FROM x FULL JOIN y USING (engine)""")
def j07_engine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (measure.slots(x, ["engine"]) for x in _halves(spark, sf_dir))
    return compare.points(a, b, "engine", "cited", "citation_known")


@query(f"""{HALVES}, x AS (UNPIVOT (SELECT engine, CAST(count(*) FILTER (outcome = 'observed') AS VARCHAR) AS runs, CAST(count(*) FILTER (outcome = 'error') AS VARCHAR) AS errors FROM a GROUP BY 1) ON runs, errors INTO NAME field VALUE old),
    y AS (UNPIVOT (SELECT engine, CAST(count(*) FILTER (outcome = 'observed') AS VARCHAR) AS runs, CAST(count(*) FILTER (outcome = 'error') AS VARCHAR) AS errors FROM b GROUP BY 1) ON runs, errors INTO NAME field VALUE new)
    SELECT engine, field, old, new FROM x FULL JOIN y USING (engine, field) WHERE old IS DISTINCT FROM new""")
def j11_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (measure.slots(x, ["engine"]) for x in _halves(spark, sf_dir))
    return compare.stats(a, b, "engine", ["runs", "errors"])


@query(f"""WITH s AS (SELECT DISTINCT {KEY} AS key FROM pages WHERE page_id % 3 <> 0), c AS (SELECT DISTINCT {KEY} AS key FROM pages WHERE page_id % 3 <> 1)
    (SELECT key, 'sitemap' AS side FROM s WHERE key NOT IN (SELECT key FROM c)) UNION ALL (SELECT key, 'crawl' FROM c WHERE key NOT IN (SELECT key FROM s))""")
def j16_sitemap_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return sitemaps.against_crawl(pages.where("page_id % 3 <> 0"), pages.where("page_id % 3 <> 1"))


@query(f"""WITH k AS (SELECT page_id, {HOST} AS host, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS parts FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^([^:]*://[^/]*)', 1) || '/' WHEN 1 THEN regexp_extract(url, '^([^:]*://[^/]*)', 1) || '/en/' ELSE url END AS url FROM pages)),
    known AS (SELECT host, array_to_string(parts, '/') AS trail, min(page_id) AS parent_id FROM k GROUP BY ALL), s AS (SELECT page_id, host, parts, unnest(range(len(parts))) AS depth FROM k)
    SELECT page_id, CAST(depth AS INTEGER) AS depth, parent_id FROM s JOIN known ON s.host = known.host AND known.trail = coalesce(array_to_string(s.parts[1:depth], '/'), '')""")
def j19_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin, i = F.regexp_extract("url", "^([^:]*://[^/]*)", 1), F.col("page_id") % 4
    return sitemaps.breadcrumbs(table(spark, sf_dir, "pages").select("page_id", F.when(i == 0, F.concat(origin, F.lit("/"))).when(i == 1, F.concat(origin, F.lit("/en/"))).otherwise(F.col("url")).alias("url")))


@query(f"SELECT count(*) AS entries, count(*) FILTER (lastmod IS NULL) AS missing, count(*) FILTER (page_id % 5 = 1) AS invalid, count(*) FILTER ({HOST} <> 'www.example.org') AS foreign_host, count(*) - count(DISTINCT url) AS duplicates FROM (SELECT url, page_id, CASE WHEN page_id % 4 <> 0 THEN 'x' WHEN page_id % 5 = 1 THEN 'x' END AS lastmod FROM pages)")
def x01_sitemap_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    lastmod = F.when(i % 5 == 1, "2024-02-30").when(i % 4 != 0, "2024-02-28T10:00:00Z")
    return sitemaps.hygiene(table(spark, sf_dir, "pages").select(F.col("url").alias("loc"), lastmod.alias("lastmod")), "www.example.org")


@query("SELECT user_id, CAST(max(ts) AS DATE) AS latest, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-03-01') AS age, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-03-01') > 30 AS stale, CAST(max(ts) AS DATE) + 14 AS due FROM events GROUP BY user_id")
def n05_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("latest"))
    age = F.date_diff(F.lit("2024-03-01").cast("date"), "latest").cast("long")
    return latest.select("user_id", "latest", age.alias("age"), (age > 30).alias("stale"), F.date_add("latest", 14).alias("due"))


@query("SELECT doc_id, contains(lower(coalesce(text, '')), 'the') OR contains(lower(coalesce(text, '')), 'und ') AS hit FROM documents")
def t24_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", parsing.terms_hit(["the", "und ", "x"], F.col("text")).alias("hit"))


@query(f"SELECT page_id, {KEY} AS key, NOT regexp_matches(lower({PATH}), '\\.(css|js|png|jpg|jpeg|gif|svg|webp|ico|pdf|zip|mp4|mp3|woff|woff2|xml|json|txt)$') AS is_page FROM pages")
def u09_link_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.link_key(u).alias("key"), urls.is_page(u).alias("is_page"))


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(coalesce(text, ''), '[가-힣]')) >= greatest(1.0, length(coalesce(text, '')) * 0.15) THEN 'ko' ELSE 'en' END AS script, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) = coalesce(text, '') AS squeezed FROM documents")
def t07_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.script(x).alias("script"), (text.squeezed(x) == x).alias("squeezed"))


@query("SELECT o_orderpriority AS engine, count(*) AS calls, round(sum(o_totalprice) / 1000000, 2) AS cost FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*), NULL FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def a48_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of an engine; an engine without a price has none, which is not zero."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("engine"), "o_totalprice")
    priced = F.col("engine") != "1-URGENT"
    return orders.groupBy("engine").agg(F.count("*").alias("calls"), F.round(F.sum(F.when(priced, F.col("o_totalprice"))) / 1000000, 2).alias("cost"))
