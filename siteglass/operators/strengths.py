"""What a site does well: positive rules over the same facts as an audit's findings, for many sites at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: agents whose policies a strength speaks of
AI_SEARCH = ("OAI-SearchBot", "Claude-SearchBot", "PerplexityBot")
KOREAN_SEARCH = ("Yeti", "Daumoa")
TEXT_CHARS = 300


def rules() -> list[tuple[str, Column]]:
    """(code, test) over one row a site, in the order of a report. What was not observed is no strength."""
    c, n = F.col, F.col("n")
    return [
        ("NO_NOINDEX", c("noindex") == 0), ("SITEMAP_RESPONDS", c("sitemaps_live") > 0), ("SITEMAP_DECLARED", c("sitemap_declared") > 0),
        ("AI_SEARCH_ALLOWED", c("ai_search") == len(AI_SEARCH)), ("KOREAN_SEARCH_ALLOWED", c("korean_search") == len(KOREAN_SEARCH)),
        ("JSONLD_COMMON", 2 * c("jsonld") > n), ("TEXT_ENOUGH", c("thin") == 0), ("TITLES_DISTINCT", ~c("titles_shared") & (c("titles") > 1)),
        ("DESCRIPTIONS_DISTINCT", ~c("descriptions_shared") & (c("descriptions") > 1)), ("CANONICALS", c("canonicals") == n), ("REAL_404", c("probe_404") == 404),
        ("FEW_REDIRECTS", c("redirect_hops") <= 1), ("LLMS_TXT", c("llms_status") == 200), ("NAVER_VERIFIED", c("naver") > 0),
    ]


def strengths(facts: DataFrame, sites: DataFrame, policies: DataFrame) -> DataFrame:
    """(site, place, code) of sites with a page of status 200: facts and sites as for the audit, policies (site, agent, policy). Shared titles and descriptions are counted value by value, so that no site is a group of its pages."""
    ok = facts.where("status = 200")
    sums = ok.groupBy("site").agg(
        F.count("*").alias("n"), F.count_if(F.array_contains("directives", "noindex")).alias("noindex"), F.count_if(F.coalesce(F.col("jsonld_blocks"), F.lit(0)) > F.coalesce("jsonld_invalid", F.lit(0))).alias("jsonld"),
        F.count_if(F.coalesce(F.col("text_chars"), F.lit(0)) < TEXT_CHARS).alias("thin"), F.count_if(F.coalesce("canonical", F.lit("")) != "").alias("canonicals"), F.count_if("naver_verified").alias("naver"),
    )
    for field in ("title", "description"):
        values = ok.where(F.coalesce(field, F.lit("")) != "").groupBy("site", field).agg(F.count("*").alias("times"))
        shared = values.groupBy("site").agg(F.count("*").alias(f"{field}s"), F.bool_or(F.col("times") > 1).alias(f"{field}s_shared"))
        sums = sums.join(shared, "site", "left").fillna(0, [f"{field}s"]).fillna(False, [f"{field}s_shared"])
    allowed = F.endswith("policy", F.lit("allow"))
    count = lambda agents: F.count_distinct(F.when(allowed & F.col("agent").isin(*agents), F.col("agent")))
    said = policies.groupBy("site").agg(count(AI_SEARCH).alias("ai_search"), count(KOREAN_SEARCH).alias("korean_search"))
    known = sites.select("site", "sitemaps_live", "sitemap_declared", "probe_404", "redirect_hops", "llms_status")
    row = sums.join(known, "site", "left").join(said, "site", "left")
    each = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(i).alias("place"), F.lit(code).alias("code"))) for i, (code, test) in enumerate(rules())]))
    return row.select("site", F.explode(each).alias("x")).select("site", "x.*")
