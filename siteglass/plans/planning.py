"""Queries that plan and review, over observations, pages and orders, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measure, planning
from ..sources.tables import OBSERVATIONS_SQL, observations, table

QUERIES: dict = {}
ORACLES: dict = {}
O = f"WITH {OBSERVATIONS_SQL}"  # noqa: E741
WORDS = "coalesce(nullif(regexp_extract(url, '^[^:]*://[^/?#]*/([^/?#]*)', 1), ''), 'home')"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, intent): the first segment of a page's path."""
    segment = F.regexp_extract("url", "^[^:]*://[^/?#]*/([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", "url", F.when(segment == "", "home").otherwise(segment).alias("intent"))


@query(f"{O} SELECT engine, count(*) AS attempts, count(*) FILTER (known) AS known FROM k WHERE date = (SELECT max(date) FROM k WHERE date <= DATE '2024-01-20') AND date <= DATE '2024-01-20' GROUP BY engine")
def p05_latest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planning.latest_day(observations(spark, sf_dir), until="2024-01-20")
    return rows.groupBy("engine").agg(F.count("*").alias("attempts"), F.count_if(measure.citation_known()).alias("known"))


@query(f"{O} SELECT seq, CASE WHEN coverage = 'complete' OR cited THEN cited END AS cited FROM o WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'")
def p11_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.coerced(planning.latest_day(observations(spark, sf_dir), True, "2024-01-05", "2024-01-25")).select("seq", "cited")


@query(f"{O} SELECT seq FROM k WHERE mode IN ('manual', 'browser') AND login = 'signed_out' AND search_enabled AND surface = 'web' AND known")
def p12_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("mode", F.when(F.col("seq") % 2 == 1, "manual").otherwise(F.col("mode")))
    return planning.comparable(rows, ["web"]).select("seq")


ORACLES["p12_comparable"] = f"{O} SELECT seq FROM k WHERE (mode IN ('manual', 'browser') OR seq % 2 = 1) AND login = 'signed_out' AND search_enabled AND surface = 'web' AND known"


@query(f"""{O}, q AS (SELECT DISTINCT question_id, sha256('brand' || chr(10) || question_id) AS fingerprint, question_id % 4 = 0 AS core FROM o),
    r AS (SELECT question_id, fingerprint, count(*) AS runs, count(*) FILTER (NOT cited) AS misses FROM k WHERE known AND login = 'signed_out' AND search_enabled GROUP BY ALL)
    SELECT q.question_id, core, coalesce(runs, 0) AS runs, coalesce(misses, 0) AS misses, 3 - core::INTEGER - (coalesce(misses, 0) > 0)::INTEGER AS priority FROM q LEFT JOIN r USING (question_id, fingerprint)""")
def a44_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    q = rows.select("question_id").distinct().select("question_id", F.sha2(F.concat_ws("\n", F.lit("brand"), F.col("question_id").cast("string")), 256).alias("fingerprint"), (F.col("question_id") % 4 == 0).alias("core"))
    known = rows.where(measure.citation_known() & (F.col("login") == "signed_out") & F.col("search_enabled"))
    return planning.priorities(q, known).select("question_id", "core", "runs", "misses", "priority")


@query(f"""{O}, c AS (SELECT date, concat_ws('|', engine, mode, surface, locale, login, coalesce(search_enabled::VARCHAR, '?'), question_id) AS name, count(*) FILTER (outcome = 'observed') AS observed, count(*) AS attempts FROM o GROUP BY ALL)
    SELECT date, sha256(array_to_string(list_sort(list(name || '|' || observed || '|' || attempts)), chr(10))) AS signature, count(*) AS cohorts FROM c GROUP BY date""")
def a26_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.cohort_signatures(observations(spark, sf_dir), ["date"])


@query("""WITH s AS (SELECT c_custkey AS question_id, e.engine, r.run_no FROM customer, (SELECT unnest(['view', 'click']) AS engine) e, (SELECT unnest([1, 2, 3]) AS run_no) r)
    SELECT question_id, engine, run_no FROM s ORDER BY question_id, engine, run_no LIMIT 1000""")
def j18_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"))
    return planning.capped_protocol(measure.protocol(q, ["view", "click"], 3), ["question_id", "engine", "run_no"], 1000)[0]


@query("SELECT count(*) * 6 AS slots, greatest(0, count(*) * 6 - 1000) AS omitted FROM customer")
def j18_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"))
    return planning.capped_protocol(measure.protocol(q, ["view", "click"], 3), ["question_id", "engine", "run_no"], 1000)[1]


@query(f"""{O}, r AS (SELECT CASE WHEN engine = 'view' THEN 'web' WHEN engine = 'click' THEN 'app' ELSE 'other' END AS surface, CASE WHEN engine = 'click' THEN 'blocked' ELSE outcome END AS outcome FROM o),
    c AS (SELECT surface, count(*) FILTER (outcome = 'observed') AS observed FROM r GROUP BY surface)
    SELECT s.surface, coalesce(observed, 0) AS observed, CASE WHEN observed > 0 THEN 'observed' ELSE 'unmeasured' END AS status, CASE WHEN observed IS NULL THEN 'never tried' WHEN observed = 0 THEN 'no usable answer' END AS reason
    FROM (SELECT unnest(['web', 'app', 'maps']) AS surface) s LEFT JOIN c ON c.surface = s.surface""")
def j29_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = F.when(F.col("engine") == "view", "web").when(F.col("engine") == "click", "app").otherwise("other")
    rows = observations(spark, sf_dir).select(surface.alias("surface"), F.when(F.col("engine") == "click", "blocked").otherwise(F.col("outcome")).alias("outcome"))
    return planning.surface_coverage(spark.createDataFrame([("web",), ("app",), ("maps",)], "surface string"), rows)


@query(f"SELECT intent, min(page_id % 3)::INTEGER AS priority, min(page_id) AS first, list(page_id ORDER BY page_id) AS questions FROM (SELECT page_id, {WORDS} AS intent FROM pages) GROUP BY intent")
def a39_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _urls(spark, sf_dir).select("intent", (F.col("page_id") % 3).cast("int").alias("priority"), F.col("page_id").alias("place"), F.col("page_id").alias("question_id"))
    return planning.intents(q)


@query(f"SELECT url, list_sort(list(DISTINCT intent)) AS intents FROM (SELECT regexp_extract(url, '^([^:]*://[^/]*)', 1) AS url, {WORDS} AS intent FROM pages) GROUP BY url HAVING count(DISTINCT intent) > 1")
def j23_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.conflicts(_urls(spark, sf_dir).select(F.regexp_extract("url", "^([^:]*://[^/]*)", 1).alias("url"), "intent"))


@query(f"""WITH p AS (SELECT page_id, {WORDS} AS intent FROM pages), r AS (SELECT DISTINCT intent, unnest(['H1', 'h2', 'H9']) AS heading FROM p UNION ALL SELECT 'nowhere', 'H1'), f AS (SELECT intent, 'h' || page_id % 5 AS heading FROM p)
    SELECT intent, heading, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.intent = r.intent AND f.heading = lower(r.heading)) THEN 'present' WHEN r.intent IN (SELECT intent FROM f) THEN 'missing' ELSE 'unknown' END AS state FROM r""")
def j25_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _urls(spark, sf_dir)
    required = p.select("intent").distinct().select("intent", F.explode(F.array(F.lit("H1"), F.lit("h2"), F.lit("H9"))).alias("heading")).unionByName(spark.createDataFrame([("nowhere", "H1")], "intent string, heading string"))
    return planning.heading_gaps(required, p.select("intent", F.concat(F.lit("H"), (F.col("page_id") % 5).cast("string")).alias("heading")))


@query(f"""WITH p AS (SELECT {WORDS} AS intent, page_id % 3 = 0 AS owned, page_id % 5 = 0 AS has_table, CASE WHEN page_id % 7 <> 0 THEN page_id % 2 = 0 END AS has_faq FROM pages),
    l AS (SELECT intent, owned, 'has_table' AS feature, has_table AS has FROM p UNION ALL SELECT intent, owned, 'has_faq', has_faq FROM p)
    SELECT intent, feature FROM l GROUP BY ALL HAVING bool_or(NOT owned AND has) AND bool_or(CASE WHEN owned THEN has END) = false""")
def j26_feature_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    pages = _urls(spark, sf_dir).select("intent", (i % 3 == 0).alias("owned"), (i % 5 == 0).alias("has_table"), F.when(i % 7 != 0, i % 2 == 0).alias("has_faq"))
    return planning.feature_gaps(pages, ["has_table", "has_faq"])


@query("""WITH d AS (SELECT c_custkey::VARCHAR AS url, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'about' END AS description FROM customer), l AS (SELECT c_custkey::VARCHAR AS url, CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE c_name END AS title, 'about' AS description FROM customer WHERE c_custkey % 7 <> 0),
    x AS (SELECT url, 'title' AS field, title AS want FROM d UNION ALL SELECT url, 'description', description FROM d)
    SELECT x.url, field, CASE WHEN l.url IS NULL THEN 'unverified' WHEN want IS NOT DISTINCT FROM CASE WHEN field = 'title' THEN l.title ELSE l.description END THEN 'applied' ELSE 'differs' END AS state FROM x LEFT JOIN l USING (url) WHERE want IS NOT NULL""")
def j31_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    drafts = c.select(k.cast("string").alias("url"), F.col("c_name").alias("title"), F.when(k % 2 == 0, "about").alias("description"))
    live = c.where(k % 7 != 0).select(k.cast("string").alias("url"), F.when(k % 5 == 0, "old").otherwise(F.col("c_name")).alias("title"), F.lit("about").alias("description"), F.lit(True).alias("seen"))
    return planning.drafts_applied(drafts, live, ["title", "description"])


@query("""SELECT page_id::VARCHAR AS url, CASE WHEN page_id % 5 = 0 THEN 'unverified' WHEN page_id % 7 = 0 THEN 'newly_noindex' ELSE 'kept' END AS state FROM pages WHERE page_id % 4 <> 0""")
def j32_noindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    return planning.new_noindex(p.select(i.cast("string").alias("url"), (i % 4 == 0).alias("noindex")), p.where(i % 5 != 0).select(i.cast("string").alias("url"), (i % 7 == 0).alias("noindex")))


@query("""WITH f AS (SELECT p_brand AS code, CASE min(p_size % 3) WHEN 0 THEN 'critical' WHEN 1 THEN 'warn' ELSE 'info' END AS severity, count(*) AS pages FROM part GROUP BY p_brand), r AS (SELECT 'Brand#11' AS code, 3 AS rank, 'titles' AS step UNION ALL SELECT 'Brand#11', 7, 'later' UNION ALL SELECT 'Brand#12', 1, 'robots')
    SELECT code, severity, pages, coalesce(rank, 99) AS rank, step, CASE severity WHEN 'critical' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END AS weight FROM f LEFT JOIN (SELECT code, min(rank) AS rank, arg_min(step, rank) AS step FROM r GROUP BY code) USING (code)""")
def j34_roadmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = F.min(F.col("p_size") % 3)
    found = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code")).agg(F.when(least == 0, "critical").when(least == 1, "warn").otherwise("info").alias("severity"), F.count("*").alias("pages"))
    rules = spark.createDataFrame([("Brand#11", 7, "later"), ("Brand#11", 3, "titles"), ("Brand#12", 1, "robots")], "code string, rank int, step string")
    return planning.roadmap(found, rules)


@query("""WITH e AS (SELECT c_custkey AS id, lower(c_name) AS text FROM customer WHERE c_custkey % 3 <> 0)
    SELECT n.id, CASE WHEN e.text = n.p THEN 'same' WHEN e.text IS NOT NULL THEN 'changed' WHEN n.p IN (SELECT text FROM e) THEN 'text_taken' ELSE 'new' END AS state
    FROM (SELECT c_custkey AS id, lower(CASE WHEN c_custkey % 5 = 0 THEN 'Other ' || c_custkey WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN (SELECT c_name FROM customer WHERE c_custkey = 1) ELSE c_name END) AS p FROM customer) n LEFT JOIN e ON e.id = n.id""")
def j36_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    one = c.where(k == 1).select(F.col("c_name").alias("one"))
    new = c.join(F.broadcast(one)).select(k.alias("id"), F.when(k % 5 == 0, F.concat(F.lit("Other  "), k.cast("string"))).when((k % 3 == 0) & (k % 2 == 0), F.col("one")).otherwise(F.concat(F.lit(" "), "c_name")).alias("text"))
    return planning.reconciled(new, c.where(k % 3 != 0).select(k.alias("id"), F.col("c_name").alias("text")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 1 WHEN o_orderkey % 2 = 1 THEN 2 ELSE 3 END AS priority, CASE WHEN o_orderkey % 2 = 1 THEN (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0)::INTEGER ELSE 0 END AS depends_on FROM orders""")
def j40_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return planning.backlog(table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 2 == 1, "page").otherwise("finding").alias("kind"), F.when(k % 50 == 0, "critical").when(k % 2 == 0, "info").alias("severity")))


@query("SELECT count(*) FILTER (user_id % 5 = 0) AS fail, count(*) FILTER (user_id % 5 IN (1, 2)) AS warn, count(*) FILTER (user_id % 5 = 3) AS pass, count(*) FILTER (user_id % 5 = 4) AS skip, CASE WHEN count(*) FILTER (user_id % 5 = 0) > 0 THEN 1 WHEN count(*) FILTER (user_id % 5 = 4) > 0 THEN 2 ELSE 0 END AS exit_code FROM events")
def a28_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 5
    return planning.tally(table(spark, sf_dir, "events").select(F.when(u == 0, "fail").when(u == 3, "pass").when(u == 4, "skip").otherwise("warn").alias("status")))


FACTS = """f AS (SELECT l_orderkey % 500 AS url, '/' || l_linenumber AS pointer, max(l_suppkey)::VARCHAR AS expected FROM lineitem GROUP BY ALL), v AS (SELECT url, pointer, CASE WHEN url % 5 = 0 THEN 'x' ELSE expected END AS value FROM f WHERE url % 7 <> 0 AND pointer <> '/' || url % 4),
    s AS (SELECT f.url, f.pointer, CASE WHEN v.value = expected THEN 'agree' WHEN v.value IS NOT NULL THEN 'mismatch' WHEN f.url IN (SELECT url FROM v) THEN 'missing' ELSE 'unverified' END AS state, f.url % 2 = 0 AS packed_agrees FROM f LEFT JOIN v USING (url, pointer))"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    f = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("url"), F.concat(F.lit("/"), F.col("l_linenumber").cast("string")).alias("pointer")).agg(F.max("l_suppkey").cast("string").alias("expected"))
    live = f.where((u % 7 != 0) & (F.col("pointer") != F.concat(F.lit("/"), (u % 4).cast("string")))).select("url", "pointer", F.when(u % 5 == 0, "x").otherwise(F.col("expected")).alias("value"))
    return planning.fact_states(f, live, f.select("url", "pointer", F.when(u % 2 == 0, F.col("expected")).alias("value")))


@query(f"WITH {FACTS} SELECT * FROM s")
def j30_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)


@query(f"""WITH {FACTS}, t AS (SELECT count(*) FILTER (state = 'agree') AS agree, count(*) FILTER (state = 'mismatch') AS mismatch, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'unverified') AS unverified, count(*) FILTER (state = 'missing' AND packed_agrees) AS claimed_missing FROM s)
    SELECT *, CASE WHEN mismatch + claimed_missing > 0 THEN 'fail' WHEN missing + unverified > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM t""")
def a29_fact_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.fact_verdict(_facts(spark, sf_dir))


@query("SELECT count(*) AS requested, count(*) FILTER (event_id % 4 = 0) AS searched, count(*) FILTER (event_id % 4 = 1) AS omitted, count(*) FILTER (event_id % 4 = 2) AS failed, count(*) FILTER (event_id % 4 = 3) AS invalid, CASE WHEN count(*) FILTER (event_id % 4 = 0) = count(*) THEN 'complete' WHEN count(*) FILTER (event_id % 4 = 0) > 0 THEN 'partial' ELSE 'failed' END AS status FROM events")
def a47_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("searched", "omitted", "failed", "invalid")))
    return planning.discovery_coverage(table(spark, sf_dir, "events").select(F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("state")))


@query("""WITH s AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'complete' WHEN user_id % 4 = 1 THEN 'blocked' WHEN event_id % 3 = 0 AND user_id % 4 = 2 THEN 'complete' ELSE 'pending' END AS status, event_id % 5 AS cited_count FROM events),
    g AS (SELECT user_id, count(*) AS slots, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'complete' AND cited_count = 0) AS without_citations FROM s GROUP BY user_id)
    SELECT *, CASE WHEN complete = slots THEN 'complete' WHEN blocked = slots THEN 'blocked' WHEN complete > 0 THEN 'partial' ELSE 'pending' END AS state FROM g""")
def a38_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 4
    status = F.when(u == 0, "complete").when(u == 1, "blocked").when((F.col("event_id") % 3 == 0) & (u == 2), "complete").otherwise("pending")
    return planning.cycle_status(table(spark, sf_dir, "events").select("user_id", status.alias("status"), (F.col("event_id") % 5).alias("cited_count")), ["user_id"])


@query("""WITH h AS (SELECT l_orderkey AS page, l_linenumber AS place, 'Part ' || l_suppkey % 3 || '!' AS heading FROM lineitem)
    SELECT page, place, heading, 'part-' || left(substr(heading, 6), 1) || CASE WHEN n > 1 THEN '-' || (n - 1) ELSE '' END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY page, heading ORDER BY place) AS n FROM h)""")
def w11_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("place"), F.concat(F.lit("Part "), (F.col("l_suppkey") % 3).cast("string"), F.lit("!")).alias("heading"))
    return planning.ordinals(h, "page", "place")


@query("""WITH c AS (SELECT user_id AS intent, 'h' || event_id % 9 AS heading, min(event_id) AS place FROM events GROUP BY ALL), u AS (SELECT * FROM c WHERE heading <> 'h' || intent % 9)
    SELECT intent, heading, n::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY place, heading) AS n FROM u) WHERE n <= 3""")
def w12_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("intent"), F.concat(F.lit("h"), (F.col("event_id") % 9).cast("string")).alias("heading"), F.col("event_id").alias("place"))
    return planning.proposals(c, c.select("intent", F.concat(F.lit("h"), (F.col("intent") % 9).cast("string")).alias("heading")).distinct())


@query("SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 30")
def l09_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.limited(table(spark, sf_dir, "pages").select("page_id", "url"), ["url", "page_id"], 30)[0]


@query("SELECT greatest(0, count(*) - 30) AS remaining FROM pages")
def p18_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.limited(table(spark, sf_dir, "pages").select("page_id", "url"), ["url", "page_id"], 30)[1]


@query("SELECT l_orderkey AS url, l_linenumber AS field, l_suppkey % 97 = 0 AS regression, (SELECT count(*) > 200 FROM lineitem) AS truncated FROM lineitem ORDER BY l_suppkey % 97 = 0 DESC, url, field LIMIT 200")
def l04_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.ordered_changes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("url"), F.col("l_linenumber").alias("field"), (F.col("l_suppkey") % 97 == 0).alias("regression")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS source_no, CASE WHEN o_orderkey % 3 = 0 THEN 'explicit' WHEN o_orderkey % 2 = 0 THEN 'log' ELSE 'queue' END AS outcome FROM orders""")
def o01_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    part = lambda test, name: table(spark, sf_dir, "orders").where(test).select(k.alias("id"), F.lit(name).alias("outcome"))
    return planning.merged_sources(part(k % 3 == 0, "explicit"), part(k % 2 == 0, "log"), part(F.lit(True), "queue"))


@query("SELECT event_id, list_distinct_in_order AS merged FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN [event_type, 'a', 'b'] ELSE [event_type, 'a'] || CASE WHEN event_id % 3 = 1 THEN ['c'] ELSE [] END END AS list_distinct_in_order FROM events)")
def o05_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 3
    first = F.array(F.col("event_type"), F.lit("a"), F.col("event_type"))
    second = F.when(i == 0, F.array(F.lit("a"), F.lit("b"))).when(i == 1, F.array(F.lit("c"), F.lit("a")))
    return table(spark, sf_dir, "events").select("event_id", planning.ordered_union(first, second).alias("merged"))


@query("""WITH c AS (SELECT event_type AS engine, 'm' || user_id % 3 AS model, count(*) AS calls FROM events GROUP BY ALL)
    SELECT engine, model, calls, CASE WHEN model <> 'm2' THEN round(((2.5::DOUBLE * 5000 + 10.0::DOUBLE * 700) / 1000000 + 0.01::DOUBLE * 3) * calls, 4) END AS least, CASE WHEN model <> 'm2' THEN round(((2.5::DOUBLE * 15000 + 10.0::DOUBLE * 700) / 1000000 + 0.01::DOUBLE * 3) * calls, 4) END AS most FROM c""")
def n11_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    calls = e.groupBy(F.col("event_type").alias("engine"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model")).agg(F.count("*").alias("calls"))
    prices = e.select(F.col("event_type").alias("engine")).distinct().select("engine", F.explode(F.array(F.lit("m0"), F.lit("m1"))).alias("model"), F.lit(2.5).alias("price_in"), F.lit(10.0).alias("price_out"), F.lit(0.01).alias("price_search"))
    return planning.cost_range(calls, prices)


@query(f"{O} SELECT engine AS kind, max(date) AS last, date_diff('day', DATE '2024-02-10', max(date) + 14)::INTEGER AS due_in, date_diff('day', DATE '2024-02-10', max(date) + 14) < 0 AS overdue FROM o GROUP BY engine")
def z12_days_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.days_left(observations(spark, sf_dir).select(F.col("engine").alias("kind"), "date"), F.lit("2024-02-10").cast("date"))


@query(f"{O} SELECT question_id, engine, count(*) AS runs, count(*) FILTER (coalesce(cited, false) AND outcome = 'observed') AS hits, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome IN ('unmeasured', 'blocked', 'partial')) AS unusable FROM o GROUP BY ALL")
def a32_collector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.collector_tally(observations(spark, sf_dir))


@query("SELECT count(*) FILTER (user_id % 3 = 0) AS pending, count(*) FILTER (user_id % 3 = 1) AS claimed, count(*) FILTER (user_id % 3 = 2) AS complete, count(*) FILTER (user_id % 3 = 1 AND event_id % 2 = 0) AS to_reconcile FROM events")
def a37_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 3
    return planning.queue_status(table(spark, sf_dir, "events").select(F.when(u == 0, "pending").when(u == 1, "claimed").otherwise("complete").alias("status"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("submitted_at")), ["pending", "claimed", "complete"])


@query(f"{O} SELECT c.channel, CASE WHEN c.channel IN (SELECT engine FROM o WHERE outcome = 'observed' AND engine <> 'click') THEN 'observed' ELSE 'unmeasured' END AS state FROM (SELECT unnest(['view', 'click', 'maps']) AS channel) c")
def a40_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where("engine <> 'click'").withColumnRenamed("engine", "channel")
    return planning.channel_states(spark.createDataFrame([("view",), ("click",), ("maps",)], "channel string"), rows)


@query("""SELECT s_suppkey AS site, list_sort(list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'page_limit' END, CASE WHEN s_suppkey % 3 = 0 THEN 'robots_unreachable' END, CASE WHEN s_suppkey % 5 = 0 THEN 'sitemap_failed' END, CASE WHEN s_suppkey % 7 = 0 THEN 'body_truncated' END], lambda x: x IS NOT NULL)) AS reasons,
    s_suppkey % 2 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS complete FROM supplier""")
def a41_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    mark = lambda n: F.when(k % n == 0, 1).otherwise(0)
    return planning.coverage_reasons(table(spark, sf_dir, "supplier").select(k.alias("site"), mark(2).alias("remaining"), F.when(k % 3 == 0, "unreachable").otherwise("ok").alias("robots_state"), mark(5).alias("failed_sitemaps"), mark(7).alias("truncated")))


@query("SELECT o_orderkey AS page, count(*) FILTER (l_linenumber % 3 <> 0) AS issues, count(*) FILTER (l_linenumber % 3 = 0) AS manual FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_suppkey % 2 = 0) ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def a45_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "lineitem").where("l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") % 3 == 0).alias("manual"))
    return planning.review_counts(issues, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page")))


@query("SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'brand' WHEN event_id % 4 = 0 THEN 'draft' END AS excluded FROM events")
def p13_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.question_scope(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "brand").otherwise("nonbrand").alias("kind"), F.when(F.col("event_id") % 4 == 0, "<<TODO ask>>").otherwise("what").alias("text")))


@query("SELECT url, min(page_id) AS place FROM (SELECT page_id, 'https://h.org/' || page_id % 40 AS url FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, url FROM pages) WHERE starts_with(url, 'https://h.org/') GROUP BY url ORDER BY place, url LIMIT 30")
def p16_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    own = p.where(i % 3 != 0).select(i.alias("place"), F.concat(F.lit("https://h.org/"), (i % 40).cast("string")).alias("url"))
    return planning.review_candidates(own.unionByName(p.select(i.alias("place"), "url")), "https://h.org")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'no_url' WHEN c_custkey % 5 = 1 THEN 'not_crawled' WHEN c_custkey % 2 = 0 THEN 'not_ok' END AS skipped FROM customer""")
def j20_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    items = c.select(k.alias("id"), F.when(k % 5 != 0, k.cast("string")).alias("url"))
    return planning.faq_targets(items, c.where(k % 5 != 1).select(k.cast("string").alias("url"), F.when(k % 2 == 0, 404).otherwise(200).alias("status")))


@query("""SELECT user_id AS url, coalesce(list_sort(list(DISTINCT event_id) FILTER (event_id % 50 = 0)), []) AS hits, coalesce(list_sort(list(DISTINCT event_id) FILTER (event_id % 70 = 0)), []) AS runs FROM events GROUP BY user_id""")
def j21_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.col("event_id").alias("id"))
    return planning.research_ids(e, e.where("id % 50 = 0"), e.where("id % 70 = 0"))


@query(f"""{O}, u AS (SELECT seq, date, question_id, engine, unnest(['http://a/' || seq % 3, 'http://b/']) AS url FROM o WHERE mode <> 'api' AND search_enabled AND outcome = 'observed' AND answer_complete AND fingerprint = sha256('brand' || chr(10) || question_id))
    SELECT seq, url, left(sha256(strftime(date, '%Y-%m-%d') || '|' || question_id || '|' || engine || '|' || seq || '|' || url), 16) AS id FROM u""")
def s23_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("mode", F.when(F.col("seq") % 2 == 1, "manual").otherwise("api"))
    q = rows.select("question_id").distinct().select("question_id", F.sha2(F.concat_ws("\n", F.lit("brand"), F.col("question_id").cast("string")), 256).alias("fingerprint"), F.lit("brand").alias("kind"))
    cited = F.array(F.concat(F.lit("http://a/"), (F.col("seq") % 3).cast("string")), F.lit("http://b/"), F.lit("http://b/"))
    return planning.from_log(rows.withColumn("cited_urls", cited), q).select("seq", "url", "id")


ORACLES["s23_evidence"] = ORACLES["s23_evidence"].replace("WHERE mode <> 'api' AND", "WHERE seq % 2 = 1 AND")


@query("SELECT o_orderkey AS slot, CASE WHEN o_orderkey % 5 = 0 THEN 'gone' ELSE 'missing' END AS state FROM orders WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 7 = 0)")
def r08_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return planning.stale_slots(o.where(k % 7 != 0).select(k.alias("slot")), o.where(k % 5 != 0).select(k.alias("slot")), ["slot"])
