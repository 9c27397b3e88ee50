"""Operators over the addresses that answers cite: the site's own, other domains, channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.stats import rate
from .planning import numbered


def cited(rows: DataFrame) -> DataFrame:
    """rows (seq, cited_urls) as (seq, url, domain), each URL of a run once."""
    each = rows.select("seq", F.explode(F.array_distinct("cited_urls")).alias("url"))
    return each.withColumn("domain", urls.domain(F.col("url")))


def owned_urls(rows: DataFrame, site: str) -> DataFrame:
    return cited(rows).where(urls.owned(F.col("domain"), F.lit(site))).groupBy("url").agg(F.count("*").alias("n_runs"))


def other_domains(rows: DataFrame, site: str) -> DataFrame:
    """Runs that cite each domain other than the site's, with the first such run."""
    other = cited(rows).where(~urls.owned(F.col("domain"), F.lit(site)))
    return other.groupBy("domain").agg(F.count_distinct("seq").alias("n_runs"), F.min("seq").alias("first_seq"))


def top(counts: DataFrame, n: int) -> DataFrame:
    """The n largest counts, ties to what came first; Spark keeps n rows for each task."""
    return counts.orderBy(F.desc("n_runs"), "first_seq", "domain").limit(n)


def channel_shares(rows: DataFrame, site: str, channels: DataFrame) -> DataFrame:
    """channels (suffix, channel): runs with a domain of each channel over runs with any third-party domain; a run counts once for each channel.

    Distinct domains, a small table, are classified by their own suffixes, so both joins are on equal keys; runs are joined with the result.
    """
    other = cited(rows).where(~urls.owned(F.col("domain"), F.lit(site))).select("seq", "domain").distinct()
    labels = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    named = other.select("domain").distinct().select("domain", F.posexplode(suffixes).alias("at", "suffix")).join(channels, "suffix")
    of = named.groupBy("domain").agg(F.min_by("channel", "at").alias("channel"))
    each = other.join(of, "domain", "left").select("seq", F.coalesce("channel", F.lit("other")).alias("channel")).distinct()
    total = each.agg(F.count_distinct("seq").alias("with_sources"))  # one row
    counts = each.groupBy("channel").agg(F.count("*").alias("n_runs"))
    return counts.join(F.broadcast(total)).select("channel", "n_runs", "with_sources", rate(F.col("n_runs"), F.col("with_sources")).alias("share"))


def capped(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; the cap is the feature."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def interleaved(rows: DataFrame, kind: str, order: str) -> DataFrame:
    """turn: the row's number within its kind, so that sorting by (turn, kind) takes kinds in turn. order is an integer; see planning.numbered."""
    return numbered(rows, [kind], order)
