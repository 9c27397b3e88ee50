"""Operators over crawled pages: facts, duplicates, sections, links and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from .planning import numbered


def facts(pages: DataFrame) -> DataFrame:
    """Title, headings, language, links and markers of each page; a single pass of patterns, no Python."""
    html = F.coalesce("html", F.lit(""))
    title = text.squeezed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select(
        "page_id",
        "url",
        title.alias("title"),
        F.regexp_count(html, F.lit(r"(?i)<h1[\s>]")).alias("h1_count"),
        F.regexp_extract(html, r"(?is)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1).alias("lang"),
        F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"']"), F.lit(1)).alias("links"),
        F.regexp_count(html, F.lit(r"(?i)application/ld\+json")).alias("jsonld_count"),
        F.regexp_like(html, F.lit(r"(?is)<meta[^>]*name=[\"']robots[\"'][^>]*noindex")).alias("noindex"),
        F.regexp_like(html, F.lit(r"(?is)<link[^>]*rel=[\"']canonical[\"']")).alias("has_canonical"),
    )


def duplicates(found: DataFrame, field: str) -> DataFrame:
    """Values that two or more pages share, with the number of pages."""
    return found.where(F.col(field) != "").groupBy(field).agg(F.count("*").alias("n_pages")).where("n_pages > 1")


def sections(pages: DataFrame) -> DataFrame:
    return pages.groupBy(urls.host(F.col("url")).alias("host"), urls.section(F.col("url")).alias("section")).agg(F.count("*").alias("n_pages"))


def representatives(pages: DataFrame) -> DataFrame:
    """The page with the shortest URL of each host and section, ties to the smaller id."""
    by = [urls.host(F.col("url")).alias("host"), urls.section(F.col("url")).alias("section")]
    return pages.groupBy(*by).agg(F.min(F.struct(F.length("url").alias("n"), "page_id", "url")).alias("m")).select("host", "section", "m.page_id", "m.url")


def spread_hosts(pages: DataFrame) -> DataFrame:
    """turn: 1 for the first page of its host, 2 for the second, and so on; sorting by it takes every host's first before any second."""
    return numbered(pages.select("page_id", urls.host(F.col("url")).alias("host")), ["host"], "page_id")
