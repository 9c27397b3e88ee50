"""Queries over inputs that are held to constraints, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints
from ..sources import forms
from ..sources.tables import ENGINES, table

QUERIES: dict = {}
ORACLES: dict = {}
SITE = "example.org"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: The cells of a form, each an expression that Spark and SQL read alike, over an event's value (v), day (d), user (u) and type (t).
CELLS = {
    "date": "CASE WHEN v < 1 THEN '2024-02-30' WHEN v < 2 THEN '2024/01/01' ELSE d END", "query_id": "concat('q', CAST(u AS STRING))", "query_text": "CASE WHEN v >= 3 AND v < 4 THEN 'old' WHEN v > 60 THEN concat(' text, of \"', CAST(u AS STRING), '\" ') ELSE '' END",
    "type": "CASE WHEN v >= 4 AND v < 5 THEN 'brand' WHEN v > 50 THEN 'NonBrand' ELSE '' END", "engine": "CASE WHEN v >= 5 AND v < 6 THEN 'other' ELSE upper(t) END", "run_no": "CASE WHEN v >= 6 AND v < 7 THEN '0' WHEN v >= 7 AND v < 8 THEN 'x' WHEN v < 40 THEN '1' ELSE ' 2' END",
    "cited": "CASE WHEN v >= 8 AND v < 10 THEN 'maybe' WHEN v < 45 THEN 'Y' ELSE 'no' END", "login_state": "CASE WHEN v >= 10 AND v < 12 THEN 'odd' WHEN v < 30 THEN '' ELSE 'signed_in' END", "search_enabled": "CASE WHEN v >= 12 AND v < 14 THEN '?' WHEN v < 30 THEN 'y' ELSE '' END",
    "answer_complete": "CASE WHEN v >= 14 AND v < 16 THEN '?' WHEN v >= 18 AND v < 20 THEN 'n' ELSE '' END", "citation_coverage": "CASE WHEN v >= 16 AND v < 18 THEN 'most' WHEN v >= 18 AND v < 22 THEN 'complete' WHEN v >= 22 AND v < 24 THEN 'not_applicable' ELSE '' END",
    "cited_urls": "CASE WHEN v < 35 THEN concat('https://a.example.org/', t, '; nothing, https://www.Other.com/', CAST(u AS STRING)) ELSE '' END", "competitor_domains": "CASE WHEN v > 30 THEN 'www.rival.com | example.org' ELSE '' END", "note": "CASE WHEN v > 20 THEN 'seen' ELSE '' END",
}


def form_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): events as filled forms of at most 250 records each."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("v"), F.date_format("ts", "yyyy-MM-dd").alias("d"), F.col("user_id").alias("u"), F.col("event_type").alias("t"))
    quoted = [F.concat(F.lit('"'), F.replace(F.expr(x), F.lit('"'), F.lit('""')), F.lit('"')) for x in CELLS.values()]
    rows = e.select(F.floor(F.col("event_id") / 250).alias("part"), "event_id", F.concat_ws(",", *quoted).alias("record"))
    whole = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("event_id", "record"))).alias("records"))
    body = F.concat(F.lit("﻿" + ",".join(CELLS) + "\r\n"), F.array_join("records.record", "\r\n\r\n"))
    return whole.select(F.concat(F.lit("form-"), F.lpad(F.col("part").cast("string"), 6, "0"), F.lit(".csv")).alias("file"), body.alias("content"))


FORMS_SQL = f"""
    e AS (SELECT event_id, value AS v, strftime(ts, '%Y-%m-%d') AS d, user_id AS u, event_type AS t FROM events),
    cells AS (SELECT 'form-' || lpad((event_id // 250)::VARCHAR, 6, '0') || '.csv' AS file, row_number() OVER (PARTITION BY event_id // 250 ORDER BY event_id) + 1 AS line, u, v, t, {", ".join(f"trim({x}) AS {name}" for name, x in CELLS.items())} FROM e),
    judged AS (SELECT *, CASE WHEN v < 2 THEN 'date' WHEN u >= 100 THEN 'query_id' WHEN query_text = 'old' THEN 'query_text' WHEN type = 'brand' THEN 'type' WHEN engine = 'other' THEN 'engine' WHEN run_no NOT IN ('1', '2') THEN 'run_no' WHEN cited = 'maybe' THEN 'cited' WHEN login_state = 'odd' THEN 'login_state'
        WHEN search_enabled = '?' THEN 'search_enabled' WHEN answer_complete = '?' THEN 'answer_complete' WHEN citation_coverage = 'most' THEN 'citation_coverage' WHEN citation_coverage = 'complete' AND answer_complete = 'n' THEN 'complete_without_answer' WHEN citation_coverage = 'not_applicable' THEN 'cited_without_coverage' END AS problem FROM cells)
"""


def _forms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = spark.range(100).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("id"), F.concat(F.lit('text, of "'), F.col("id").cast("string"), F.lit('"')).alias("text"), F.lit("nonbrand").alias("type"))
    return forms.imported(forms.measurements(forms.records(form_files(spark, sf_dir)), asked, tuple(ENGINES), SITE))


@query(f"WITH {FORMS_SQL} SELECT file, line, problem FROM judged WHERE problem IS NOT NULL")
def s03_form_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir)[1]


@query(f"""WITH {FORMS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY date, u, t, run_no, login_state, search_enabled ORDER BY file DESC, line DESC) AS n FROM judged WHERE problem IS NULL)
    SELECT file, line, date, query_id, lower(t) AS engine, run_no::INTEGER AS run_no, v < 45 AS cited, CASE WHEN v < 35 THEN 'https://a.example.org/' || t || ' https://www.other.com/' || u ELSE '' END AS cited_urls,
        concat_ws(' ', CASE WHEN v > 30 THEN 'rival.com' END, CASE WHEN v < 35 THEN 'other.com' END) AS competitors, concat_ws(' ', CASE WHEN v > 20 THEN 'seen' END, CASE WHEN v < 35 THEN '[no URL: nothing]' END, CASE WHEN v >= 35 AND v < 45 THEN '[cited URL not noted]' END) AS note,
        CASE WHEN v < 30 THEN 'signed_out' ELSE 'signed_in' END AS login_state, CASE WHEN v < 45 THEN true END AS answer_complete, CASE WHEN citation_coverage <> '' THEN citation_coverage WHEN v < 45 THEN 'partial' ELSE 'unknown' END AS citation_coverage FROM k WHERE n = 1""")
def s03_form_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _forms(spark, sf_dir)[0]
    return good.select("file", "line", "date", "query_id", "engine", "run_no", "cited", F.array_join("cited_urls", " ").alias("cited_urls"), F.array_join("competitors", " ").alias("competitors"), "note", "login_state", "answer_complete", "citation_coverage")


def _all(df: DataFrame, place: list[str], rules: list[constraints.Constraint]) -> DataFrame:
    return constraints.violations(df, place, rules)


def _either(test: str, value: str, other: str) -> Column:
    return F.expr(f"CASE WHEN {test} THEN {value} ELSE {other} END")


@query("""WITH o AS (SELECT event_id, value AS v, user_id AS u, event_type AS t, CASE WHEN value < 20 THEN 'o' || user_id || '-' || floor(value)::INTEGER ELSE 'e' || event_id END AS id FROM events), d AS (SELECT id FROM o GROUP BY id HAVING count(*) > 1),
    p AS (SELECT event_id, unnest([CASE WHEN v < 1 THEN 'no_channel' END, CASE WHEN id IN (SELECT id FROM d) THEN 'repeated_id' END, CASE WHEN u >= 100 THEN 'unknown_question' END, CASE WHEN t = 'error' AND v >= 1 THEN 'unknown_channel' END, CASE WHEN u >= 100 OR v > 90 THEN 'other_text' END, CASE WHEN v < 2 THEN 'no_text' END,
        CASE WHEN v >= 3 AND v < 5 THEN 'bad_time' END, CASE WHEN v >= 5 AND v < 6 THEN 'bad_outcome' END, CASE WHEN v >= 6 AND v < 9 THEN 'private_url' END, CASE WHEN v >= 9 AND v < 10 THEN 'bad_position' END]) AS problem FROM o)
    SELECT event_id, problem FROM p JOIN o USING (event_id) WHERE problem IS NOT NULL AND NOT (problem = 'other_text' AND v < 2)""")
def s22_observation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "value AS v", "user_id AS u", "event_type AS t")
    rows = e.select(
        "event_id", "v", F.expr("CASE WHEN v < 20 THEN concat('o', u, '-', CAST(floor(v) AS INT)) ELSE concat('e', event_id) END").alias("id"), F.expr("concat('q', u)").alias("query_id"), F.expr("CASE WHEN v >= 2 THEN concat('text ', u, CASE WHEN v > 90 THEN '?' ELSE '' END) END").alias("query_text"),
        F.expr("CASE WHEN v < 1 THEN ' ' ELSE t END").alias("channel"), F.expr("CASE WHEN v >= 5 AND v < 6 THEN 'seen' WHEN v > 60 THEN 'error' ELSE 'observed' END").alias("outcome"), F.expr("CASE WHEN v >= 3 AND v < 4 THEN '2024-01-01T10:00' WHEN v >= 4 AND v < 5 THEN '2024-02-30T10:00Z' ELSE '2024-01-01T10:00+09:00' END").alias("observed_at"),
        F.expr("CASE WHEN v >= 6 AND v < 7 THEN 'http://127.0.0.1/' WHEN v >= 7 AND v < 8 THEN 'http://host/' WHEN v > 60 THEN NULL ELSE 'https://a.example.org/' END").alias("url"), F.expr("CASE WHEN v >= 8 AND v < 9 THEN 'ftp://a.example.org/' ELSE 'https://b.example.org/x' END").alias("evidence_url"), F.expr("CASE WHEN v >= 9 AND v < 10 THEN 0 WHEN v > 30 THEN 3 END").alias("position"),
    )
    asked = spark.range(100).selectExpr("concat('q', id) AS id", "concat('text ', id) AS text")
    channels = e.where("t <> 'error'").select(F.col("t").alias("channel")).distinct().unionByName(spark.range(1).select(F.lit(" ").alias("channel")))
    return _all(rows, ["event_id"], constraints.observations(asked, channels))


@query("""WITH q AS (SELECT doc_id, n_chars AS n, lang, source, left(text, 12) AS id FROM documents), d AS (SELECT id FROM q WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1),
    p AS (SELECT doc_id, unnest([CASE WHEN trim(coalesce(id, '')) = '' THEN 'no_id' END, CASE WHEN source IS NULL THEN 'no_intent_id' END, CASE WHEN n % 7 = 0 THEN 'bad_terms' END, CASE WHEN n % 11 = 0 THEN 'bad_sections' END, CASE WHEN id IN (SELECT id FROM d) THEN 'repeated_id' END, CASE WHEN n % 5 = 4 THEN 'bad_priority' END, CASE WHEN lang = 'de' THEN 'bad_type' END]) AS problem FROM q)
    SELECT doc_id, problem FROM p WHERE problem IS NOT NULL""")
def s26_brief_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.left("text", F.lit(12)).alias("id"), F.lit("text").alias("text"), F.col("source").alias("intent_id"), F.lit("guide").alias("page_type"), F.when(n % 7 == 0, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array().cast("array<string>")).alias("terms"),
        F.when(n % 11 != 0, F.array(F.lit("a"))).alias("required_sections"), F.when(n % 5 > 0, (n % 5).cast("int")).alias("priority"), F.when(F.col("lang") == "de", "other").when(F.col("lang") == "en", "brand").alias("type"),
    )
    return _all(rows, ["doc_id"], constraints.brief_questions())


@query("""WITH i AS (SELECT DISTINCT source AS intent FROM documents WHERE source IS NOT NULL AND n_chars > 4000)
    SELECT page_id, problem FROM (SELECT page_id, unnest([CASE WHEN page_id IN (SELECT page_id FROM pages WHERE html IS NULL) OR page_id NOT IN (SELECT doc_id FROM documents WHERE source IS NOT NULL) THEN 'no_intent' END,
        CASE WHEN (SELECT any_value(source) FROM documents WHERE doc_id = page_id) NOT IN (SELECT intent FROM i) THEN 'unknown_intent' END, CASE WHEN contains(url, '#') THEN 'private_url' END, CASE WHEN NOT regexp_matches(url, '^https?://m\\.[^/]*') OR regexp_extract(url, '://([^/]*)', 1) <> (SELECT min(regexp_extract(url, '://([^/]*)', 1)) FROM pages WHERE contains(url, '://m.')) THEN 'other_host' END]) AS problem FROM pages) WHERE problem IS NOT NULL""")
def s26_brief_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a brief, for the intents of documents of their number; the site is the first host of mobile pages."""
    docs = table(spark, sf_dir, "documents")
    intents = docs.where("source is not null and n_chars > 4000").select(F.col("source").alias("intent_id")).distinct()
    own = docs.groupBy("doc_id").agg(F.any_value("source").alias("intent_id"))
    pages = table(spark, sf_dir, "pages")
    first = pages.where("contains(url, '://m.')").agg(F.min(F.regexp_extract("url", "://([^/]*)", 1)).alias("host")).first()["host"]
    rows = pages.join(own, F.col("page_id") == F.col("doc_id"), "left").select("page_id", "url", F.when(F.col("html").isNotNull(), F.col("intent_id")).alias("intent_id"))
    return _all(rows, ["page_id"], constraints.brief_pages(intents, f"https://{first}/"))


@query("""SELECT event_id, problem FROM (SELECT event_id, unnest([CASE WHEN event_type = 'error' THEN 'bad_url' END, CASE WHEN value < 3 THEN 'bad_pointer' END, CASE WHEN value >= 3 AND value < 6 THEN 'no_expected' END, CASE WHEN value >= 6 AND value < 9 THEN 'bad_expected' END, CASE WHEN value >= 9 AND value < 12 THEN 'blank_expected' END,
        CASE WHEN value >= 12 AND value < 15 THEN 'not_finite' END, CASE WHEN event_type = 'click' THEN 'no_evidence' END, CASE WHEN event_type = 'view' AND value > 50 THEN 'blank_type' END]) AS problem FROM events) WHERE problem IS NOT NULL""")
def s27_ledger_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, t = F.col("value"), F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(t == "error", "e.org/x").otherwise(" https://e.org/x").alias("url"), F.when(v < 1, "/").when(v < 2, "offers/price").when(v >= 3, "/offers/price").alias("pointer"),
        F.when((v >= 9) & (v < 12), " ").when((v >= 12) & (v < 15), "1e999").otherwise(v.cast("string")).alias("expected"), F.when((v >= 3) & (v < 6), "absent").when((v >= 6) & (v < 7), "null").when((v >= 7) & (v < 9), "object").when((v >= 9) & (v < 12), "string").otherwise("number").alias("kind"),
        F.when(t != "click", "page 3").alias("evidence"), F.when((t == "view") & (v > 50), " ").when(t == "purchase", "Product").alias("type"),
    )
    return _all(rows, ["event_id"], constraints.ledger())


@query("""WITH p AS (SELECT page_id AS n, regexp_extract(url, '://([^/]*)/([^/?#]*)', 2) AS id, url, html FROM pages), d AS (SELECT id FROM p GROUP BY id HAVING count(*) > 1)
    SELECT n AS page_id, problem FROM (SELECT n, unnest([CASE WHEN trim(id) = '' THEN 'bad_id' END, CASE WHEN id IN (SELECT id FROM d) THEN 'repeated_id' END, CASE WHEN contains(url, '#') THEN 'private_url' END, CASE WHEN trim(coalesce(left(html, 600), '')) = '' OR length(left(html, 600)) > 500 THEN 'bad_intent' END, CASE WHEN trim(coalesce(html, '')) = '' OR length(html) > 100000 THEN 'bad_body' END,
        CASE WHEN coalesce(strlen(html) % 150 > 100, true) THEN 'too_many_claims' END, CASE WHEN length(url) > 40 THEN 'bad_updated_at' END]) AS problem FROM p) WHERE problem IS NOT NULL""")
def s29_review_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]*)/([^/?#]*)", 2).alias("id"), "url", F.left("html", F.lit(600)).alias("intent"), F.col("html").alias("body"), (F.octet_length("html") % 150).alias("n_claims"), F.col("url").alias("updated_at"))
    return _all(rows, ["page_id"], constraints.review_pages())
