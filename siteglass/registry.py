"""All queries over the driver's tables, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, urls
from .functions.stats import wilson_sql
from .operators import audit, measure
from .plans import catalogue, crawl, deploy, inputs, jobs, jsonld, lines, more, planning, reports, research, review, robots, scope, sitemaps
from .sources.tables import ENGINES, OBSERVATIONS_SQL, observations, table

FLAGSHIP = "a04_rates"
QUERIES: dict = {}
ORACLES: dict = {}
O = f"WITH {OBSERVATIONS_SQL}"  # noqa: E741
COUNTS = """count(*) AS attempts, count(*) FILTER (outcome = 'observed') AS runs, count(*) FILTER (outcome = 'error') AS errors,
    count(*) FILTER (outcome IN ('unmeasured', 'blocked', 'partial')) AS unmeasured, count(*) FILTER (known) AS citation_known,
    count(*) FILTER (known AND cited) AS cited, count(*) FILTER (outcome = 'observed' AND mentioned IS NOT NULL) AS mention_known,
    count(*) FILTER (outcome = 'observed' AND coalesce(mentioned, false)) AS mention_hits,
    count(*) FILTER (outcome = 'observed' AND organic IS NOT NULL) AS organic_known, count(*) FILTER (outcome = 'observed' AND coalesce(organic, false)) AS organic_visible"""
RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
HOST = f"lower(regexp_extract(url, '{RFC}', 2))"
SECTION = f"regexp_extract(regexp_extract(url, '{RFC}', 3), '^/*([^/]*)', 1)"
TITLE = "trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir)


LAST = """SELECT arg_max(x, seq) AS r FROM (SELECT o AS x, * FROM o) GROUP BY date, question_id, engine, run_no, mode, surface, locale, login, search_enabled, campaign_id, model, session_id"""


@query(f"{O}, l AS ({LAST}) SELECT r.date AS date, r.question_id AS question_id, r.engine AS engine, r.run_no AS run_no, r.campaign_id AS campaign_id, r.model AS model, r.session_id AS session_id, r.seq AS seq, r.outcome AS outcome FROM l")
def w01_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.last_write_wins(_obs(spark, sf_dir)).select("date", "question_id", "engine", "run_no", "campaign_id", "model", "session_id", "seq", "outcome")


@query(f"""{O}, l AS ({LAST}), c AS (SELECT r.* FROM l) SELECT seq, outcome FROM c x WHERE NOT reservation OR NOT EXISTS (SELECT 1 FROM c y WHERE y.outcome = 'observed' AND x.date = y.date AND x.question_id = y.question_id
    AND x.fingerprint = y.fingerprint AND x.engine = y.engine AND x.run_no = y.run_no AND x.mode = y.mode AND x.campaign_id IS NOT DISTINCT FROM y.campaign_id)""")
def s02_current_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.current(_obs(spark, sf_dir)).select("seq", "outcome")


@query(f"{O} SELECT engine, {COUNTS} FROM k GROUP BY engine")
def a01_engine_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.slots(_obs(spark, sf_dir), ["engine"])


@query(f"{O} SELECT engine, count(*) AS questions, CAST(sum(hit) AS BIGINT) AS hit_questions FROM (SELECT engine, question_id, max(cited::INT) AS hit FROM k WHERE known GROUP BY ALL) GROUP BY engine")
def a02_question_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.question_hits(_obs(spark, sf_dir), ["engine"])


@query(f"{O} SELECT date, engine, count(DISTINCT question_id) AS questions, count(DISTINCT CASE WHEN cited THEN question_id END) AS hit_questions FROM k WHERE known GROUP BY ALL")
def a03_distinct_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.question_hits(_obs(spark, sf_dir), ["date", "engine"])


@query(f"{O}, s AS (SELECT engine, {COUNTS} FROM k GROUP BY engine) SELECT engine, citation_known, cited, CASE WHEN citation_known > 0 THEN round(cited / citation_known, 4) END AS citation_rate, CASE WHEN mention_known > 0 THEN round(mention_hits / mention_known, 4) END AS mention_rate, CASE WHEN organic_known > 0 THEN round(organic_visible / organic_known, 4) END AS organic_rate FROM s")
def a04_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.rates(_obs(spark, sf_dir), ["engine"])


@query(f"{O} SELECT engine, mode, surface, locale, login, search_enabled, {COUNTS} FROM k GROUP BY ALL")
def a05_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.slots(_obs(spark, sf_dir), measure.COHORT)


@query(f"{O} SELECT date, count(*) FILTER (known) AS runs, count(*) AS attempts, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'unmeasured') AS unmeasured, count(*) FILTER (known AND cited) AS cited FROM k GROUP BY date")
def a06_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.trend(_obs(spark, sf_dir))


@query(f"{O} SELECT question_id, engine, {COUNTS} FROM k GROUP BY ALL")
def a07_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.slots(_obs(spark, sf_dir), ["question_id", "engine"])


@query(f"""{O}, e AS (SELECT date, engine, question_id, mode, surface, locale, max(coalesce(planned_runs, run_no)) AS planned, count(*) FILTER (outcome = 'observed') AS completed, count(*) FILTER (known) AS confirmed FROM k GROUP BY ALL)
    SELECT date, engine, question_id, CAST(sum(planned) AS BIGINT) AS planned, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(confirmed) AS BIGINT) AS confirmed, CAST(greatest(0, sum(planned) - sum(completed)) AS BIGINT) AS unmeasured FROM e GROUP BY ALL""")
def a11_plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.plan_coverage(_obs(spark, sf_dir))


@query(f"{O} SELECT condition, value, count(*) AS n_rows FROM (SELECT unnest([{{'condition': 'engine', 'value': engine}}, {{'condition': 'mode', 'value': mode}}, {{'condition': 'surface', 'value': surface}}, {{'condition': 'locale', 'value': locale}}, {{'condition': 'login', 'value': login}}], recursive := true) FROM o) GROUP BY ALL")
def a13_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.conditions(_obs(spark, sf_dir))


@query(f"{O} SELECT engine, count(*) FILTER (fingerprint = sha256('brand' || chr(10) || CAST(question_id AS VARCHAR))) AS compatible_rows, count(*) FILTER (fingerprint <> sha256('brand' || chr(10) || CAST(question_id AS VARCHAR))) AS excluded_rows FROM o GROUP BY engine")
def j02_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = spark.range(20).select(F.col("id").alias("question_id"), text.fingerprint(F.lit("brand"), F.col("id").cast("string")).alias("fingerprint"), F.lit("brand").alias("kind"))
    return measure.compatible(_obs(spark, sf_dir), questions).groupBy("engine").agg(F.count_if("compatible").alias("compatible_rows"), F.count_if(~F.col("compatible")).alias("excluded_rows"))


@query(f"""{O} SELECT seq, reservation, outcome FROM o x WHERE NOT reservation OR NOT EXISTS (SELECT 1 FROM o y WHERE y.outcome = 'observed' AND x.date = y.date AND x.question_id = y.question_id
    AND x.fingerprint = y.fingerprint AND x.engine = y.engine AND x.run_no = y.run_no AND x.mode = y.mode AND x.campaign_id IS NOT DISTINCT FROM y.campaign_id)""")
def j03_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.without_fulfilled(_obs(spark, sf_dir)).select("seq", "reservation", "outcome")


LOW, HIGH = wilson_sql("cited", "citation_known")


@query(f"{O}, s AS (SELECT mode, {COUNTS} FROM k GROUP BY mode) SELECT mode, citation_known, cited, CASE WHEN citation_known > 0 THEN round(cited / citation_known, 4) END AS citation_rate, {LOW} AS low, {HIGH} AS high FROM s")
def a25_pooled_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.pooled(_obs(spark, sf_dir), ["mode"])


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _obs(spark, sf_dir)
    return rows.where("dayofmonth(date) <= 15"), rows.where("dayofmonth(date) > 15")


@query(f"""{O}, a AS (SELECT question_id, count(*) FILTER (known) AS known_before, count(*) FILTER (known AND cited) AS cited_before, count(*) FILTER (outcome = 'error') AS errors_before FROM k WHERE day(date) <= 15 GROUP BY 1),
    b AS (SELECT question_id, count(*) FILTER (known) AS known_after, count(*) FILTER (known AND cited) AS cited_after, count(*) FILTER (outcome = 'error') AS errors_after FROM k WHERE day(date) > 15 GROUP BY 1),
    j AS (SELECT question_id, coalesce(known_before, 0) AS known_before, coalesce(cited_before, 0) AS cited_before, coalesce(errors_before, 0) AS errors_before, coalesce(known_after, 0) AS known_after, coalesce(cited_after, 0) AS cited_after, coalesce(errors_after, 0) AS errors_after FROM a FULL JOIN b USING (question_id)),
    c AS (SELECT *, CASE WHEN least(known_before, known_after) >= 5 AND errors_before + errors_after = 0 THEN round(cited_after / known_after - cited_before / known_before, 4) END AS change FROM j)
    SELECT *, CASE WHEN change IS NULL THEN 'not_comparable' WHEN change >= 0.10 THEN 'improved' WHEN change <= -0.10 THEN 'regressed' ELSE 'steady' END AS verdict FROM c""")
def c17_metric_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.verdicts(*_halves(spark, sf_dir), ["question_id"])


@query(f"""{O}, a AS (SELECT engine, count(*) AS n_before FROM o WHERE day(date) <= 15 GROUP BY 1), b AS (SELECT engine, count(*) AS n_after FROM o WHERE day(date) > 15 GROUP BY 1)
    SELECT engine, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after, CASE WHEN n_before IS NULL THEN 'new' WHEN n_after IS NULL THEN 'lost' ELSE 'kept' END AS state FROM a FULL JOIN b USING (engine)""")
def j08_count_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.outer_counts(*_halves(spark, sf_dir), "engine")


@query("""WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'view'), m AS (SELECT user_id, CAST(ts AS DATE) AS date, max(event_id) AS snapshot FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT a.user_id, a.date, m.snapshot FROM a ASOF LEFT JOIN m ON a.user_id = m.user_id AND a.date >= m.date""")
def j09_asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    audits = e.where("event_type = 'view'").select("user_id", "date").distinct()
    return measure.as_of(audits, e.where("event_type = 'purchase'").groupBy("user_id", "date").agg(F.max("event_id").alias("snapshot")), "user_id", "date", "snapshot")


PERF = "SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey, CAST(l_quantity AS BIGINT) AS clicks, CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity * 10 END AS BIGINT) AS impressions, l_discount * 100 + 1 AS position FROM lineitem"


def _performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    shown = F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_quantity") * 10).cast("long")
    return line.select(F.to_date("l_shipdate").alias("date"), "l_suppkey", F.col("l_quantity").cast("long").alias("clicks"), shown.alias("impressions"), (F.col("l_discount") * 100 + 1).alias("position"))


@query(f"""WITH p AS ({PERF}), s AS (SELECT l_suppkey, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, sum(position * impressions) FILTER (impressions > 0) AS weighted, count(*) FILTER (impressions <= 0) AS zero_rows FROM p GROUP BY 1)
    SELECT l_suppkey, clicks, impressions, CASE WHEN impressions > 0 THEN round(clicks / impressions, 6) END AS ctr, CASE WHEN impressions > 0 THEN round(weighted / impressions, 4) END AS position, zero_rows FROM s""")
def a14_search_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.performance(_performance(spark, sf_dir), ["l_suppkey"])


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT CAST(date AS DATE) AS date FROM (SELECT unnest(generate_series((SELECT min(date) FROM d), (SELECT max(date) FROM d), INTERVAL 1 DAY)) AS date) WHERE CAST(date AS DATE) NOT IN (SELECT date FROM d)")
def a16_date_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.date_gaps(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")))


@query(f"SELECT question_id, engine, run_no FROM (SELECT n_nationkey AS question_id FROM nation), (SELECT unnest({ENGINES}) AS engine), (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS run_no)")
def j17_plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.protocol(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("question_id")), ENGINES, 5)


@query(f"SELECT page_id, {HOST} AS host, regexp_replace(regexp_replace({HOST}, '^www\\.', ''), '\\.$', '') AS bare, {SECTION} AS section, lower(regexp_extract(url, '{RFC}', 1)) || '://' || {HOST} || CASE WHEN regexp_extract(url, '{RFC}', 3) = '' THEN '/' ELSE regexp_extract(url, '{RFC}', 3) END || CASE WHEN regexp_matches(url, '^[^#]*\\?') THEN '?' || regexp_extract(url, '{RFC}', 4) ELSE '' END AS normal FROM pages")
def u01_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.bare(urls.host(u)).alias("bare"), urls.section(u).alias("section"), urls.normalize(u).alias("normal"))


@query(f"SELECT page_id, {HOST} = 'example.org' OR ends_with({HOST}, '.example.org') AS owned FROM pages")
def u06_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.owned(urls.host(F.col("url")), F.lit("example.org")).alias("owned"))


@query(f"SELECT page_id, {TITLE} AS title, len(regexp_extract_all(coalesce(html, ''), '(?i)<h1[\\s>]')) AS h1_count, len(regexp_extract_all(coalesce(html, ''), '(?is)<a\\s[^>]*href=[\"'']([^\"'']*)[\"'']')) AS n_links FROM pages")
def s14_page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.facts(table(spark, sf_dir, "pages")).select("page_id", "title", F.col("h1_count").cast("long").alias("h1_count"), F.size("links").cast("long").alias("n_links"))


@query(f"SELECT title, count(*) AS n_pages FROM (SELECT {TITLE} AS title FROM pages) WHERE title <> '' GROUP BY title HAVING count(*) > 1")
def a17_dup_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicates(audit.facts(table(spark, sf_dir, "pages")), "title")


@query(f"SELECT {HOST} AS host, {SECTION} AS section, count(*) AS n_pages FROM pages GROUP BY ALL")
def a20_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sections(table(spark, sf_dir, "pages"))


@query(f"SELECT host, section, page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY host, section ORDER BY length(url), page_id) AS n FROM (SELECT {HOST} AS host, {SECTION} AS section, page_id, url FROM pages)) WHERE n = 1")
def w06_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.representatives(table(spark, sf_dir, "pages"))


@query(f"SELECT page_id, {HOST} AS host, CAST(row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) AS INTEGER) AS turn FROM pages")
def w07_host_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.spread_hosts(table(spark, sf_dir, "pages"))


@query("SELECT conv_id, turn, contains(lower(text), 'the') AS hit FROM conversations")
def t09_brand_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.brand_hit(F.col("text"), ["the"]).alias("hit"))


@query(f"SELECT page_id, CASE WHEN length(title) < 50 THEN 'short' WHEN length(title) > 60 THEN 'long' ELSE 'ok' END AS verdict FROM (SELECT page_id, {TITLE} AS title FROM pages)")
def t08_length_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.facts(table(spark, sf_dir, "pages")).select("page_id", text.length_verdict(F.col("title"), "title").alias("verdict"))


for part in (more, crawl, planning, jsonld, jobs, robots, research, sitemaps, scope, catalogue, inputs, lines, reports, deploy, review):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
