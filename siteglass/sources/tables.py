"""The driver's tables, and observations made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENGINES = ["view", "signup", "purchase", "error", "click"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an observation of a question (user) on an engine (event type); see OBSERVATIONS_SQL for the same in SQL."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        F.to_date("ts").alias("date"),
        (F.col("user_id") % 20).alias("question_id"),
        F.col("event_type").alias("engine"),
        (i % 3 + 1).cast("int").alias("run_no"),
        F.when(i % 4 == 0, (i % 5 + 1).cast("int")).alias("planned_runs"),
        F.when(i % 2 == 0, "manual").otherwise("api").alias("mode"),
        F.when(i % 5 == 0, "en-US").otherwise("ko-KR").alias("locale"),
        F.lit("web").alias("surface"),
        F.when(i % 3 == 0, "signed_out").otherwise("unknown").alias("login"),
        F.when(i % 6 == 0, F.lit(None).cast("boolean")).otherwise(i % 2 == 1).alias("search_enabled"),
        F.sha2(F.concat_ws("\n", F.when(i % 17 == 0, "old").otherwise("brand"), (F.col("user_id") % 20).cast("string")), 256).alias("fingerprint"),
        (i % 13 == 0).alias("reservation"),
        F.when(i % 11 == 0, "error").when(i % 11 == 1, "unmeasured").when(i % 11 == 2, "blocked").when(i % 11 == 3, "partial").otherwise("observed").alias("outcome"),
        (i % 7 != 0).alias("answer_complete"),
        F.when(i % 9 == 0, F.lit(None).cast("string")).when(i % 4 == 1, "partial").otherwise("complete").alias("coverage"),
        F.when(i % 10 == 0, F.lit(None).cast("boolean")).otherwise(F.col("value") > 50).alias("cited"),
        F.when(i % 8 == 0, F.lit(None).cast("boolean")).otherwise(i % 3 == 0).alias("mentioned"),
        F.when(i % 12 == 0, F.lit(None).cast("boolean")).otherwise(i % 5 < 2).alias("organic"),
        F.when(i % 23 == 0, "c1").alias("campaign_id"),
        F.when(i % 2 == 1, F.concat(F.lit("m"), (i % 3).cast("string"))).alias("model"),
        F.when(i % 29 == 0, "s1").alias("session_id"),
        i.alias("seq"),
    )


OBSERVATIONS_SQL = """
    o AS (SELECT CAST(ts AS DATE) AS date, user_id % 20 AS question_id, event_type AS engine, CAST(event_id % 3 + 1 AS INTEGER) AS run_no,
        CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 5 + 1 AS INTEGER) END AS planned_runs,
        CASE WHEN event_id % 2 = 0 THEN 'manual' ELSE 'api' END AS mode, CASE WHEN event_id % 5 = 0 THEN 'en-US' ELSE 'ko-KR' END AS locale, 'web' AS surface,
        CASE WHEN event_id % 3 = 0 THEN 'signed_out' ELSE 'unknown' END AS login,
        CASE WHEN event_id % 6 <> 0 THEN event_id % 2 = 1 END AS search_enabled,
        sha256(CASE WHEN event_id % 17 = 0 THEN 'old' ELSE 'brand' END || chr(10) || CAST(user_id % 20 AS VARCHAR)) AS fingerprint,
        event_id % 13 = 0 AS reservation,
        CASE event_id % 11 WHEN 0 THEN 'error' WHEN 1 THEN 'unmeasured' WHEN 2 THEN 'blocked' WHEN 3 THEN 'partial' ELSE 'observed' END AS outcome,
        event_id % 7 <> 0 AS answer_complete,
        CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'partial' ELSE 'complete' END AS coverage,
        CASE WHEN event_id % 10 <> 0 THEN value > 50 END AS cited, CASE WHEN event_id % 8 <> 0 THEN event_id % 3 = 0 END AS mentioned,
        CASE WHEN event_id % 12 <> 0 THEN event_id % 5 < 2 END AS organic,
        CASE WHEN event_id % 23 = 0 THEN 'c1' END AS campaign_id, CASE WHEN event_id % 2 = 1 THEN 'm' || event_id % 3 END AS model, CASE WHEN event_id % 29 = 0 THEN 's1' END AS session_id, event_id AS seq FROM events),
    k AS (SELECT *, outcome = 'observed' AND answer_complete AND (coalesce(coverage, 'unknown') = 'complete' OR coalesce(cited, false)) AND cited IS NOT NULL AS known FROM o)
"""


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as an audit's crawl: with statuses, header directives, redirects, and some marks that pages lack; see CRAWLED_SQL."""
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    more = [
        F.when(i % 4 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type": "'), F.when(i % 8 == 0, "FAQPage").otherwise("Organization"), F.when(i % 16 == 4, F.lit('", "a": {"@type": ["Thing", "Place"]}}</script>')).otherwise(F.lit('"}</script>')))),
        F.when(i % 20 == 3, F.lit('<script type="application/ld+json">{"@type": </script>')),
        F.when(i % 5 == 0, F.concat(F.lit('<meta name="description" content="About &quot;'), (i % 30).cast("string"), F.when(i % 25 == 0, F.repeat(F.lit(" &amp; more"), 30)).otherwise(""), F.lit('">'))),
        F.when(i % 21 == 1, F.lit('<meta name=googlebot content="nosnippet; noarchive">')),
        F.when(i % 6 == 0, F.concat(F.lit('<link rel="canonical" href="'), F.when(i % 12 == 0, "/elsewhere").otherwise(F.col("url")), F.lit('">'))),
        F.when(i % 7 == 0, F.lit("<h1>Another</h1>")),
        F.when(i % 9 == 4, F.concat(F.lit("<a href='//"), F.regexp_extract("url", "://([^/]*)", 1), F.lit("/seen/"), (i % 50).cast("string"), F.lit("#x'>seen</a>"))),
        F.when(i % 11 == 2, F.lit("<a href=/bare?a=1&amp;b=2>bare</a>")),
    ]
    return p.select(
        i,
        F.when(i % 9 == 5, F.concat(F.regexp_extract("url", "^([^:]*://[^/]*)", 1), F.lit("/seen/"), (i % 50).cast("string"))).otherwise(F.col("url")).alias("url"),
        F.when(i % 10 == 7, F.concat("url", F.lit("/moved"))).alias("final_url"),
        F.when(i % 13 == 0, 404).when(i % 13 == 1, 503).when(i % 13 == 2, F.lit(None).cast("int")).when(i % 13 == 3, 500).otherwise(200).alias("status"),
        F.when(i % 9 == 0, "noindex").when(i % 9 == 1, "googlebot: none").when(i % 9 == 2, "otherbot: noindex, nofollow").alias("x_robots"),
        (i % 18 != 0).alias("intended_indexable"),
        F.concat(F.coalesce("html", F.lit("")), *[F.coalesce(x, F.lit("")) for x in more]).alias("html"),
    )


def decoded(sql: str) -> str:
    """SQL with DECODED[x] written out: x with the references that pages have decoded."""
    while "DECODED[" in sql:
        a = sql.rindex("DECODED[")
        b, open_ = a + 8, 1
        while open_:
            open_ += {"[": 1, "]": -1}.get(sql[b], 0)
            b += 1
        x = sql[a + 8 : b - 1]
        for reference, character in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
            x = f"replace({x}, '{reference}', '{character}')"
        sql = sql[:a] + x + sql[b:]
    return sql


CRAWLED_SQL = decoded(r"""
    crawled AS (SELECT page_id, CASE WHEN page_id % 9 = 5 THEN regexp_extract(url, '^([^:]*://[^/]*)', 1) || '/seen/' || page_id % 50 ELSE url END AS url,
        CASE WHEN page_id % 10 = 7 THEN url || '/moved' END AS final_url,
        CASE page_id % 13 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN NULL WHEN 3 THEN 500 ELSE 200 END AS status,
        page_id % 9 IN (0, 1) AS noindex, page_id % 21 = 1 AS nosnippet, page_id % 18 <> 0 AS intended,
        coalesce(html, '') || CASE WHEN page_id % 4 = 0 THEN '<script type="application/ld+json">{"@type": "' || CASE WHEN page_id % 8 = 0 THEN 'FAQPage' ELSE 'Organization' END || CASE WHEN page_id % 16 = 4 THEN '", "a": {"@type": ["Thing", "Place"]}}</script>' ELSE '"}</script>' END ELSE '' END
            || CASE WHEN page_id % 20 = 3 THEN '<script type="application/ld+json">{"@type": </script>' ELSE '' END
            || CASE WHEN page_id % 5 = 0 THEN '<meta name="description" content="About &quot;' || page_id % 30 || CASE WHEN page_id % 25 = 0 THEN repeat(' &amp; more', 30) ELSE '' END || '">' ELSE '' END
            || CASE WHEN page_id % 21 = 1 THEN '<meta name=googlebot content="nosnippet; noarchive">' ELSE '' END
            || CASE WHEN page_id % 6 = 0 THEN '<link rel="canonical" href="' || CASE WHEN page_id % 12 = 0 THEN '/elsewhere' ELSE url END || '">' ELSE '' END
            || CASE WHEN page_id % 7 = 0 THEN '<h1>Another</h1>' ELSE '' END
            || CASE WHEN page_id % 9 = 4 THEN '<a href=''//' || regexp_extract(url, '://([^/]*)', 1) || '/seen/' || page_id % 50 || '#x''>seen</a>' ELSE '' END
            || CASE WHEN page_id % 11 = 2 THEN '<a href=/bare?a=1&amp;b=2>bare</a>' ELSE '' END AS html FROM pages),
    plain AS (SELECT *, coalesce(final_url, url) AS base, regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>', '', 'g') AS bare FROM crawled),
    rec AS (SELECT page_id, url, base, status, noindex, nosnippet, intended,
        trim(regexp_replace(DECODED[regexp_extract(bare, '(?is)<title[^>]*>(.*?)</title>', 1)], '\s+', ' ', 'g')) AS title,
        CASE WHEN page_id % 5 = 0 THEN 'About "' || page_id % 30 || CASE WHEN page_id % 25 = 0 THEN repeat(' & more', 30) ELSE '' END ELSE '' END AS description,
        CASE WHEN page_id % 12 = 0 THEN regexp_extract(base, '^([^:]*://[^/?#]*)', 1) || '/elsewhere' END AS other_canonical, page_id % 6 <> 0 AS no_canonical,
        (SELECT url FROM pages p WHERE p.page_id = plain.page_id) AS page_url,
        list_transform(regexp_extract_all(bare, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), lambda x: trim(regexp_replace(DECODED[regexp_replace(x, '<[^>]*>', '', 'g')], '\s+', ' ', 'g'))) AS h1,
        list_transform(list_transform(regexp_extract_all(bare, '(?is)<a\s[^>]*href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda h: DECODED[trim(h, '"''')]), lambda x: regexp_replace(
            CASE WHEN starts_with(x, '//') THEN regexp_extract(base, '^([^:]*:)', 1) || x WHEN starts_with(x, '/') THEN regexp_extract(base, '^([^:]*://[^/?#]*)', 1) || x ELSE x END, '#.*$', '')) AS links,
        CAST(length(trim(regexp_replace(DECODED[regexp_replace(bare, '<[^>]*>', '', 'g')], '\s+', ' ', 'g'))) AS INTEGER) AS text_chars,
        CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 20 = 3 THEN 1 ELSE 0 END AS blocks,
        CASE WHEN page_id % 20 = 3 THEN 1 ELSE 0 END AS invalid,
        CASE WHEN page_id % 8 = 0 THEN 'FAQPage' WHEN page_id % 4 = 0 THEN 'Organization' END AS type,
        CASE WHEN page_id % 8 = 0 THEN ['FAQPage'] WHEN page_id % 16 = 4 THEN ['Organization', 'Place', 'Thing'] WHEN page_id % 4 = 0 THEN ['Organization'] ELSE [] END AS types FROM plain)
""")
