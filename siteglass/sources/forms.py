"""Forms that people filled in: CSV records with their line numbers, and measurements of them with what is wrong with each.

Files are read whole as bytes by Spark, wherever they lie, and split into records by tasks, since a cell may hold line feeds and a record's
number counts records, the header being 1. A file that is not UTF-8 gives one record without cells and the problem unreadable. Blank lines are no records.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, text, urls
from .scratch import kept

# fixed values: states of a login, and how far a person saw an answer's citations
LOGINS = ("signed_out", "signed_in", "unknown")
COVERAGES = ("complete", "partial", "unknown", "not_applicable")
RECORD = "file string, line long, cells map<string,string>, problem string"
#: Fields that tell measurements apart; of those that agree in all, the last counts.
KEY = ("date", "query_id", "engine", "run_no", "surface", "locale", "login_state", "search_enabled", "campaign_id", "model", "session_id")


def records(files: DataFrame) -> DataFrame:
    """(file, line, cells, problem) of files (file, content). A record that is too long keeps the cells that have names, one that is too short lacks cells."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string())
        for b in batches:
            for name, raw in ((n.as_py(), c.as_py()) for n, c in zip(b.column(0), b.column(1), strict=True)):  # one file at a time, a batch may be large
                try:
                    rows = list(csv.DictReader(io.StringIO((raw or b"").decode("utf-8-sig"), newline="")))
                    out = [(name, k, [(c, v or "") for c, v in r.items() if isinstance(c, str)], None) for k, r in enumerate(rows, 2)]
                except (UnicodeDecodeError, csv.Error):
                    out = [(name, 0, [], "unreadable")]
                for a in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 10_000], strict=True), kinds, strict=True)], ["file", "line", "cells", "problem"])

    return files.select("file", F.col("content").cast("binary").alias("content")).mapInArrow(work, RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files under a path."""
    return records(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))


def _cell(name: str) -> Column:
    return F.trim(F.coalesce(F.try_element_at("cells", F.lit(name)), F.lit("")))


def measurements(rows: DataFrame, questions: DataFrame, engines: tuple[str, ...], site: str) -> DataFrame:
    """rows (records) with the fields of a measurement and problem: null, or the first thing that is wrong.

    questions are (id, text, type). A cited answer without a coverage is partial, and complete as an answer; a blank login is signed_out. Addresses that are none go to the note.
    """
    known = questions.select(F.col("id").alias("query_id"), F.col("text").alias("_text"), F.lower("type").alias("_type"))
    c = _cell
    run = F.when(F.regexp_like(c("run_no"), F.lit(r"^[+-]?\d+$")), c("run_no").try_cast("int"))
    r = rows.select("file", "line", "problem", "cells", c("date").alias("date"), c("query_id").alias("query_id"), F.lower(c("engine")).alias("engine"), F.coalesce(run, F.lit(0)).alias("run_no")).join(known, "query_id", "left")
    r = r.withColumns({name: text.yes_no(c(name)) for name in ("cited", "brand_mentioned", "search_enabled", "answer_complete", "organic_visible")})
    tokens = text.multi(c("cited_urls"))
    r = r.withColumns({"_urls": F.transform(tokens, lambda t: F.struct(t.alias("raw"), urls.entered(t).alias("url")))})
    r = r.withColumns({
        "cited_urls": F.array_distinct(F.filter(F.transform("_urls", lambda x: x["url"]), lambda u: u.isNotNull())),
        "_dropped": F.transform(F.filter("_urls", lambda x: x["url"].isNull()), lambda x: x["raw"]),
        "login_state": F.when(c("login_state") == "", "signed_out").otherwise(c("login_state")),
        "citation_coverage": F.when(c("citation_coverage") != "", c("citation_coverage")).when(F.col("cited"), "partial").otherwise("unknown"),
        "answer_complete": F.when((c("answer_complete") == "") & F.col("cited"), True).otherwise(F.col("answer_complete")),
    })
    named = F.filter(F.transform(text.multi(c("competitor_domains")), urls.domain), lambda d: d != "")
    others = F.transform(F.filter("cited_urls", lambda u: ~urls.owned(urls.host(u), F.lit(site))), urls.domain)
    note = F.concat_ws(" ", F.nullif(c("note"), F.lit("")), F.when(F.size("_dropped") > 0, F.concat(F.lit("[no URL: "), F.array_join("_dropped", " "), F.lit("]"))), F.when(F.col("cited") & (F.size("cited_urls") == 0), "[cited URL not noted]"))
    # a blank or unclear cell of a yes or no is null in both; which it is decides whether it is wrong
    unclear = lambda name: (c(name) != "") & text.yes_no(c(name)).isNull()
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(parsing.strict_date(F.col("date")).isNull(), "date")
        .when(F.col("_text").isNull(), "query_id")
        .when((c("query_text") != "") & (c("query_text") != F.col("_text")), "query_text")
        .when((c("type") != "") & (F.lower(c("type")) != F.col("_type")), "type")
        .when(~F.col("engine").isin(*engines), "engine")
        .when(F.col("run_no") < 1, "run_no")
        .when(F.col("cited").isNull(), "cited")
        .when(~F.col("login_state").isin(*LOGINS), "login_state")
        .when(unclear("search_enabled"), "search_enabled")
        .when(unclear("answer_complete"), "answer_complete")
        .when(~F.col("citation_coverage").isin(*COVERAGES), "citation_coverage")
        .when(F.col("cited") & (F.col("citation_coverage") == "complete") & ~F.coalesce(F.col("answer_complete"), F.lit(False)), "complete_without_answer")
        .when(F.col("cited") & (F.col("citation_coverage") == "not_applicable"), "cited_without_coverage")
    )
    return r.select(
        "file", "line", problem.alias("problem"), "date", "query_id", "engine", "run_no", "cited", F.col("brand_mentioned").alias("mentioned"), "cited_urls",
        F.array_remove(F.array_distinct(F.concat(named, others)), site).alias("competitors"), note.alias("note"), "login_state", "search_enabled", "answer_complete", "citation_coverage", "organic_visible",
        F.when(c("surface") == "", F.col("engine")).otherwise(c("surface")).alias("surface"), *[c(name).alias(name) for name in ("locale", "campaign_id", "model", "session_id", "raw_response_reference")],
    )


def imported(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(measurements without problems, of each key the last by file and line; problems by file and line)."""
    read = kept(read, "forms")
    good = read.where("problem is null").drop("problem")
    rest = [c for c in good.columns if c not in KEY]
    key = [F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"}).alias("_key")]
    last = good.groupBy(*key).agg(F.max_by(F.struct(*KEY, *rest), F.struct("file", "line")).alias("m")).select("m.*")
    return last, read.where("problem is not null").select("file", "line", "problem")
