"""Queries over texts that are read line by line, and over a log that grows by batches; and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines
from ..functions.markup import read
from ..operators import measure
from ..sources import scratch
from ..sources.tables import OBSERVATIONS_SQL, observations, table
from ..streaming import log

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, text): a report of each part: front matter, a table of what it is, a decoy in a fence, and links."""
    fence = F.when(F.col("p_size") % 2 == 0, "```").otherwise("~~~~")
    text = [
        F.lit("---"), F.concat(F.lit("name: part-"), F.col("p_partkey").cast("string")), F.concat(F.lit('description: "'), "p_name", F.lit('"')), F.when(F.col("p_size") > 25, "name: again"), F.lit("---"),
        F.concat(F.lit("# "), "p_name", F.lit(" #")), fence, F.lit("# not a heading\n| no | table |\n|---|---|\n[no](link)"), F.when(F.col("p_size") > 10, fence), F.lit("| field | value |"), F.when(F.col("p_size") > 15, "|:---|---:|").otherwise("|---|"),
        F.concat(F.lit("| brand | "), "p_brand", F.lit(" |")), F.concat(F.lit("| type \\| kind | "), "p_type"), F.lit("\n## See `[code](x)` and [the part](https://e.org/"), F.concat(F.lit("[brand]("), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(")")),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", *text).alias("text"))


@query("""WITH p AS (SELECT *, p_size > 25 AS again, p_size > 10 AS closed, p_size > 15 AS ruled FROM part)
    SELECT p_partkey, CASE WHEN closed THEN p_name || ' > See `[code](x)` and [the part](https://e.org/' ELSE p_name END AS headings, CASE WHEN closed THEN '[brand](' || replace(p_brand, '#', '-') || ')' ELSE '' END AS links,
        CASE WHEN closed AND ruled THEN 'field,value;brand,' || p_brand || ';type \\| kind,' || p_type ELSE '' END AS tables, 'part-' || p_partkey || CASE WHEN again THEN ',' || p_name || ',again' ELSE ',' || p_name END AS front_matter, CASE WHEN again THEN '4 repeated name' ELSE '' END AS problems FROM p""")
def s33_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(_reports(spark, sf_dir), lines.markdown, lines.MARKDOWN, "text")
    join = lambda c, of, by: F.array_join(F.transform(c, of), by)
    rows = lambda t: F.concat(F.array(t["header"]), t["rows"])
    return m.select(
        "p_partkey", join("headings", lambda h: h["text"], " > ").alias("headings"), join("links", lambda x: F.concat(F.lit("["), x["label"], F.lit("]("), x["target"], F.lit(")")), " ").alias("links"),
        join("tables", lambda t: F.array_join(F.transform(rows(t), lambda r: F.array_join(r, ",")), ";"), "\n").alias("tables"), join("front_matter", lambda f: f["value"], ",").alias("front_matter"), F.array_join("problems", ",").alias("problems"),
    )


@query("""WITH p AS (SELECT page_id, html, strlen(html) % 8 AS n, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS l FROM pages WHERE html IS NOT NULL), x AS (SELECT page_id, n, len(l) AS k FROM p)
    SELECT page_id, concat_ws(',', CASE WHEN n = 0 THEN 'html_document' END, CASE WHEN n = 1 THEN 'empty' END, CASE WHEN n = 2 THEN 'h1_missing' WHEN n = 3 THEN 'h1_not_first' END, CASE WHEN n IN (4, 5) THEN 'summary_missing' END, CASE WHEN n >= 5 AND k > 0 THEN 'relative_links' END,
        CASE WHEN n = 6 THEN 'non_http_links' END, CASE WHEN n >= 2 AND n < 5 OR n = 7 THEN 'malformed_links' END, CASE WHEN n >= 2 AND n <= 5 AND NOT (n = 5 AND k > 0) THEN 'no_links' WHEN n = 7 AND k = 0 THEN 'no_links' END) AS notes FROM x""")
def t16_llms_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on an llms.txt of each page, made of its title and links."""
    n = F.octet_length("html") % 8
    links = F.transform(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)), lambda x: F.concat(F.lit("- [a page]("), F.translate(x, "() ", "___"), F.lit("): about it")))
    title = F.concat(F.lit("# "), F.regexp_extract("html", "<title>([^<]*)<", 1))
    body = [
        F.when(n == 0, " \n<HTML lang=en>"), F.when(n == 3, "some words"), F.when(n >= 3, title), F.when(n == 2, "no heading"), F.when(n == 4, "a paragraph"), F.when((n == 3) | (n >= 6), "> a summary"), F.when(n >= 2, "- [before a section](x)"), F.when(n >= 2, "## Pages"),
        F.when(n >= 5, F.array_join(links, "\n")), F.when(n == 6, "* [mail](mailto:a@b.c)"), F.when((n >= 2) & (n < 5) | (n == 7), "- [broken](two words)"), F.lit("```\n- [fenced](y)\n~~~"),
    ]
    made = table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.concat_ws("\n", *body).alias("text"))
    out = read(made, lambda x: {"notes": lines.llms_notes(x)}, lines.LLMS, "text")
    return out.select("page_id", F.array_join(F.transform("notes", lambda x: x["code"]), ",").alias("notes"))


@query(r"""WITH t AS (SELECT conv_id, turn, role, text, trim(regexp_replace(split_part(text, chr(10), 1), '^[\s>*-]+', '')) AS first, length(text) % 3 AS n FROM conversations)
    SELECT conv_id, turn, 'What of ' || role || CASE n WHEN 0 THEN '?' ELSE '？' END AS heading, CASE WHEN n = 1 THEN false ELSE length(first) >= 20 END AS candidate FROM t WHERE n < 2
    UNION ALL SELECT conv_id, turn, 'And then?', length(trim(regexp_replace(split_part(text, chr(10), 1), '^[\s>*-]+', ''))) >= 20 FROM t""")
def t20_question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions put over each turn: one that it answers, one that a placeholder does, one that ends before, and one after a statement."""
    n = F.length("text") % 3
    head = F.concat(F.lit("## What of "), "role", F.when(n == 0, "? ##").when(n == 1, "？").otherwise("."))
    body = [head, F.when(n == 1, "> [Insert the relevant real service here] TODO"), F.when(n == 0, F.concat(F.lit(" \n> "), "text")).otherwise(F.col("text")), F.lit("###### And then?"), F.concat(F.lit("* "), "text"), F.lit("# ?x")]
    made = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("\n", *body).alias("text"))
    out = read(made, lines.question_answers, lines.ANSWERS, "text")
    return out.select("conv_id", "turn", F.explode("questions").alias("q")).select("conv_id", "turn", "q.heading", "q.candidate")


@query(f"""WITH {OBSERVATIONS_SQL}, l AS (SELECT r.* FROM (SELECT arg_max(x, seq) AS r FROM (SELECT o AS x, * FROM o) GROUP BY date, question_id, engine, run_no, mode, surface, locale, login, search_enabled, campaign_id, model, session_id))
    SELECT seq, outcome FROM l x WHERE NOT reservation OR NOT EXISTS (SELECT 1 FROM l y WHERE y.outcome = 'observed' AND x.date = y.date AND x.question_id = y.question_id AND x.fingerprint = y.fingerprint AND x.engine = y.engine AND x.run_no = y.run_no AND x.mode = y.mode AND x.campaign_id IS NOT DISTINCT FROM y.campaign_id)""")
def r01_log_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log merged in batches, the latest events first and one batch twice, gives what it gives as a whole."""
    rows = observations(spark, sf_dir)
    at = scratch.folder(spark, "log")
    parts = [rows.where(F.col("seq") % 3 == k) for k in range(3)]
    for number, batch in ((0, parts[2]), (1, parts[0]), (1, parts[0]), (2, parts[1].unionByName(parts[0]))):
        log.merge(batch, number, at)
    return measure.without_fulfilled(log.state(spark, at)).select("seq", "outcome")
